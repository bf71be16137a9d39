import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import xxhash

from rillflow.llm import common, packing, queries

SF = "/root/testdata/sf0.001"


def test_stages_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns
        assert 0 < docs.count() <= before, name
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == before
    assert pieces.count() == corpus_pipeline.run(spark, SF).count()


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_returns_its_whole_table(spark, name):
    rows = queries.queries()[name](spark, SF)
    table, key = ("pages", "page_id") if name == "op8_html" else ("documents", "doc_id")
    whole = spark.read.parquet(f"{SF}/{table}.parquet")
    assert rows.select(key).distinct().count() == whole.count()


def plain_fingerprint(text):
    words = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_pipeline_against_plain_python(spark, odd_texts, tmp_path):
    """Kept ids, texts and pieces of the whole pipeline, stage by stage in plain Python; without labels only the base rules act."""
    from tokenizers import Tokenizer

    from test_rules_html_pii import plain_counts

    mails = [(200 + i, f"{t} write to joe.{i}@mail.example.com or call +1 (743) 555-38{i:02d} now", "en", "s", 1) for i, t in enumerate([odd_texts[16 + k][1] + " " + odd_texts[30 + k][1] for k in range(6)])]
    rows = [r for r in odd_texts if r[0] is not None and r[1] != "another text for the same id"] + mails
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    kept = []
    for r in rows:
        c = plain_counts(r[1])
        if not (c[0] < 50 or 100 * c[4] > 50 * c[0]):
            kept.append(r)
    first = {}
    for d, t, *_ in sorted(kept, key=lambda r: r[0]):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t), (d, t))
    docs = sorted(first.values())
    prints = [plain_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = [x for i, x in enumerate(docs) if find(i) == i]
    assert 20 < len(docs) < len(kept)

    before = common.tables()
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert common.tables() == before  # nothing that it wrote is left
    assert {r.doc_id for r in pieces} == {d for d, _ in docs}
    tok = Tokenizer.from_file(queries.vocabulary())
    by = defaultdict(list)
    for r in pieces:
        by[r.doc_id].append(r)
    for d, t in docs:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        own = sorted(by[d], key=lambda r: r.piece)
        if d < 200:
            assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(k, r.start, r.length, zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())) for k, r in enumerate(own)]
            assert sum(r.length for r in own) == len(ids)
        else:  # personal data has changed
            assert own[0].ids_crc32 != zlib.crc32(np.array(ids[: own[0].length], "<u4").tobytes())
    used = Counter()
    for r in pieces:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= packing.CAPACITY


def test_main_text_of_the_small_pages(spark):
    """The articles of the small table, cut out by their marks."""
    import html

    whole = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op8_html(spark, SF).collect():
        page = whole[r.page_id] or ""
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
        blocks = re.split("\0", re.sub(r"</?(?:p|br|h1|h2|ul|li|blockquote)>", "\0", re.sub(r"</?b>", "", article[1] if article else "")))
        assert r.text == "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
