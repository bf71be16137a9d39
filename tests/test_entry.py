"""The driver's contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 45


def test_entry_runs(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["row", "col", "dir", "acc"] and rows.count() == 1500


def test_imports_without_the_training_data_subpackage(tmp_path):
    there = tmp_path / "repo"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; names = e.queries(); assert names and not any(n.startswith('op') for n in names) and 'pipeline' not in names"
    subprocess.run([sys.executable, "-c", code], cwd=there, check=True)


def test_nothing_else_imports_the_subpackage():
    for top in ("rillflow", "tests"):
        for folder, _, names in os.walk(os.path.join(ROOT, top)):
            if os.path.basename(folder) in ("llm", "__pycache__"):
                continue
            for name in names:
                text = open(os.path.join(folder, name), encoding="utf-8", errors="ignore").read() if name.endswith(".py") else ""
                assert "rillflow" + ".llm" not in text and "from ." + "llm" not in text, name


def test_results_match_the_sql(spark):
    """A few queries against DuckDB at the smallest scale."""
    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in os.listdir(sf):
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    for name in ("flagship", "d8_holes", "watershed", "strahler", "river_tree_seeds", "mask_seeds", "dmm", "cotat", "cotat_threshold", "cotat_mufp", "upstream_neighbours", "huac", "compare_flowdir_cascade", "windrose_emd"):
        frame = entry.queries()[name](spark, sf)
        found = db.execute(entry.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(frame.columns)
        assert sorted(map(str, (tuple(r[n] for n in names) for r in frame.collect()))) == sorted(map(str, found.fetchall())), name
