import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from rillflow.llm import bpe, exact_dedup, packing
from rillflow.llm.queries import vocabulary


def plain_digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", text or "").encode()).hexdigest()


@pytest.mark.parametrize("support", [1 / 1024, 0.2, 0.02])
def test_decisions_match_brute_force(odd_docs, odd_texts, support):
    groups = defaultdict(list)
    for d, t, *_ in odd_texts:
        groups[plain_digest(t)].append(d)
    got = exact_dedup.decide(odd_docs, support).collect()
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((d, h) for h, ds in groups.items() for d in ds)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((d for d in ids if d is not None), default=None)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter(dict.fromkeys(groups, 1))
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_hot_group_is_settled_map_side(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    heavy = exact_dedup.heavy_hitters(docs.select("doc_id", exact_dedup.digest(docs.text).alias("digest")))
    assert [(r.keep_id, r.group_size) for r in heavy.collect()] == [(0, 1000)]
    got = exact_dedup.decide(docs)
    assert got.count() == 3000 and got.where("kept").count() == 2001


@pytest.mark.parametrize("support", [1 / 1024, 0.05])
def test_keep_first_keeps_rows_whole(clashing_docs, odd_texts, support):
    kept = exact_dedup.keep_first(clashing_docs, support)
    assert kept.columns == clashing_docs.columns
    got = kept.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for d, t, *_ in odd_texts:
        groups[plain_digest(t)].append(d)
    assert Counter(plain_digest(r.text) for r in got) == Counter(dict.fromkeys(groups, 1))
    assert all(r.doc_id == min((d for d in groups[plain_digest(r.text)] if d is not None), default=None) for r in got)


def test_empty_tables(no_docs):
    assert exact_dedup.decide(no_docs).count() == 0
    assert exact_dedup.keep_first(no_docs).count() == 0
    assert bpe.round_trip(no_docs, vocabulary()).count() == 0
    assert packing.pack(no_docs, vocabulary()).count() == 0


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_bpe_is_the_library(odd_docs, odd_texts):
    tok = library()
    ids = [tok.encode(t or "", add_special_tokens=False).ids for _, t, *_ in odd_texts]
    want = Counter((d, len(x), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in x)).hexdigest(), hashlib.sha256(tok.decode(x, skip_special_tokens=False).encode()).hexdigest()) for (d, *_), x in zip(odd_texts, ids))
    assert Counter(map(tuple, bpe.round_trip(odd_docs, vocabulary()).collect())) == want


def test_bpe_on_strange_strings():
    tok, own = library(), bpe.load(vocabulary())
    rng = random.Random(2)
    texts = ["", "aaaa" * 50, "x" * 3000, "a  b\n\n c\t", "I'll he'd 'tis", "<|endoftext|><|endoftext|>", "漢字かな交じり文 ÀÉ", "\x1c\x85\xa0  z", "1234567890" * 30]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x1F300, 0x1F6FF)])) for _ in range(60)) for _ in range(50)]
    for t, got in zip(texts, own.encode_batch(texts)):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids
        assert own.decode(got) == t


def test_packing_places_every_token_once(odd_docs, odd_texts):
    tok, rows = library(), packing.pack(odd_docs, vocabulary(), capacity=64).collect()
    lengths = Counter()
    for d, t, *_ in odd_texts:
        n = len(tok.encode(t or "", add_special_tokens=False).ids) + 1
        lengths[d, n] += 1
    total = sum(n * c for (_, n), c in lengths.items())
    assert sum(r.length for r in rows) == total
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 64
    assert len(by) <= 1.02 * total / 64 + 2


def test_packing_takes_very_long_white_space():
    tok, encode = library(), packing.encoder(vocabulary())
    for text in (" " * 1_100_000 + "x", "hello\n" + " " * 1_100_000 + "x", "a<|endoftext|>" + "\n \t" * 400_000, "the end" + "\u3000" * 1_100_000):
        assert encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_pieces_cut_only_long_documents(odd_docs):
    import zlib

    import numpy as np

    tok = library()
    texts = {r.doc_id: r.text for r in odd_docs.where("doc_id >= 100 OR doc_id = 12").collect()}
    for doc, text in texts.items():
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        rows = sorted(packing.pieces(odd_docs.where(f"doc_id = {doc}"), vocabulary()).collect(), key=lambda r: r.piece) if doc in (12, 100) else []
        for k, r in enumerate(rows):
            assert r.piece == k and (k == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        if rows:
            assert rows[-1].start + rows[-1].length == len(ids)


def stack_matches(opens):
    free, out = [], set()
    for i, gap in enumerate(opens):
        if gap:
            free.append(i)
        elif free:
            out.add((free.pop(), i))
    return out


def test_brackets_are_a_stack():
    import numpy as np

    rng = random.Random(4)
    for _ in range(300):
        opens = [rng.random() < rng.choice([0.3, 0.5, 0.7]) for _ in range(rng.randrange(0, 40))]
        gap, doc = packing.brackets(np.array(opens, bool))
        assert set(zip(gap.tolist(), doc.tolist())) == stack_matches(opens)


def test_ranges_together_match_like_one():
    import numpy as np

    rng = random.Random(5)
    for _ in range(200):
        opens = [rng.random() < 0.5 for _ in range(60)]
        edges = sorted({0, 60, *(rng.randrange(60) for _ in range(5))})
        got, left, places = set(), [], []
        for a, b in zip(edges, edges[1:]):
            gap, doc = packing.brackets(np.array(opens[a:b], bool))
            got |= {(a + i, a + j) for i, j in zip(gap.tolist(), doc.tolist())}
            rest = [i for i in range(a, b) if i - a not in {*gap.tolist(), *doc.tolist()}]
            places.append(([i for i in rest if not opens[i]], [i for i in rest if opens[i]]))
            left.append(tuple(map(len, places[-1])))
        for k, at, part, last, n in packing.across(left).tolist():
            got |= {(places[part][1][last - i], places[k][0][at + i]) for i in range(n)}
        assert got == stack_matches(opens)


def test_sequences_are_near_the_bound(spark, odd_docs):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " a" * rng.randrange(0, 300)) for i in range(3000)], "doc_id long, text string").repartition(4)
    rows = packing.pack(docs, vocabulary(), capacity=256).collect()
    total = sum(r.length for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 256 and sum(n for _, n in p) == max(o + n for o, n in p) for p in by.values())
    assert len(by) <= 1.02 * total / 256 + 1


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "ab" * 500_000], ids=["spaces", "lines", "letters", "pairs"])
def test_a_million_characters_without_words(text):
    assert packing.encoder(vocabulary())(text).tolist() == library().encode(text, add_special_tokens=False).ids


def test_long_pieces_merge_like_the_library():
    tok, own = library(), bpe.load(vocabulary())
    rng = random.Random(7)
    parts = ["the", "ing", "tion", "a", "aa", "b", "ss", "ly", "----", "=="]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.8 else rng.choice("abcdefghij") for _ in range(rng.randrange(200, 1500))) for _ in range(30)]
    texts += ["".join(rng.choice("aab-=") for _ in range(rng.randrange(300, 2500))) for _ in range(30)] + ["x" + "aab" * 5000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))]
    for t in texts:
        assert own.encode_batch([t])[0].tolist() == tok.encode(t, add_special_tokens=False).ids
