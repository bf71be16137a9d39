import random

import pytest

WORDS = ["river", "stone", "the", "of", "and", "bridge", "löwe", "niño", "été", "grass", "valley", "x1", "rain", "cloud", "field", "to"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "a", "en"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) with nulls, blanks, repeated rows, near copies and a very long text."""
    rng = random.Random(7)
    base = prose(rng, 120)
    near = base.replace("river", "stream", 1)
    long = prose(rng, 60_000)
    texts = [None, "", " \t\n\r\x0b\x0c ", "one", "one", "two words", base, base, base + " end", near, base.upper(), base.replace(" ", "\n"), long, "<|endoftext|> a <|endoftext|>", "€😀 漢字" * 30, "###$$$ " * 80]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", None) for i, t in enumerate(texts)]
    rows += [(6, base, "en", "s0", 5), (6, base, "en", "s0", 5), (None, "one", None, None, None), (None, prose(rng, 40), None, None, None), (3, "another text for the same id", "de", "s", 1)]
    rows += [(100 + i, prose(rng, 80), "en", "s", 1) for i in range(30)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    return spark.createDataFrame(odd_texts, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing_docs(odd_docs):
    """The same rows with columns named as the operators' own."""
    from pyspark.sql import functions as F

    names = ["digest", "keep_id", "kept", "rank", "fp", "m", "stratum", "rung", "__digest", "__rank", "counts", "text_hash", "key", "entity", "score"]
    return odd_docs.withColumns({n: F.lit(None if i % 2 else i) for i, n in enumerate(names)})
