"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and normalisation contracts, as a Java and RE2 class.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_statistics(df: DataFrame) -> DataFrame:
    """The same rows in a plan without size estimates.

    A checkpoint keeps the estimate of its plan, and that of a join is the product of
    its sides; over many rounds those numbers grow to millions of digits.
    """
    spark = df.sparkSession
    try:
        plain = spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False)
    except (AttributeError, TypeError, Py4JError):  # no such method in this Spark: only planning is slower then
        return df
    return DataFrame(plain, spark)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the cluster's ``spark.checkpoint.dir``, or one in the warehouse where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    Cuts the lineage and survives lost executors.
    """
    shared_folder(df.sparkSession)
    return without_statistics(df.checkpoint(eager=True))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names clash without regard to case)."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


#: Share of the rows from which a join key counts as hot: at most 1,024 keys.
HOT = 1 / 1024


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str, rows: int) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and the number ``n`` of left rows of it.

    Keys of more than ``HOT`` of all ``rows`` (at most ``1 / HOT`` of them) are broadcast, so
    that none of them is one task's; the others are shuffled.
    """
    hot = F.col(n) >= max(2, rows * HOT)
    heavy, light = F.broadcast(right.where(hot).drop(n)), right.where(~hot).drop(n)
    return left.join(heavy, key).unionByName(left.join(F.broadcast(right.where(hot).select(key)), key, "left_anti").join(light, key))


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id falls into bucket of the empty text (0)."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that each part holds about ``limit`` bytes of text, or one row."""
    n, start = batch.num_rows, 0
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    size = 0
    for i, x in enumerate(lengths):
        if size and size + x > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(x)
    yield batch.slice(start, n - start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared checkpoint folder, and its path; for tables too wide for :func:`cut`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    _TABLES.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Paths of the tables of :func:`written` that this driver has not deleted.
_TABLES: list[str] = []


def tables() -> list[str]:
    return list(_TABLES)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`written`."""
    _TABLES.remove(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
