from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from rillflow.llm import simhash


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    return [x[:3] for x in plain_groups(rows)]


def plain_groups(rows):
    """(doc_id, fingerprint, component id, any name of the component) of each row."""
    prints = [plain_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    return [(d, f"{p:016x}", min((x for x in ids[root(i)] if x is not None), default=None), root(i)) for i, ((d, _), p) in enumerate(zip(rows, prints))]


def test_odd_rows_match_brute_force(odd_docs, odd_texts):
    got = [tuple(r) for r in simhash.clusters(odd_docs).collect()]
    assert Counter(got) == Counter(plain_components([r[:2] for r in odd_texts]))


def test_every_near_pair_shares_a_key():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(a), dtype=np.uint64)
    found = [set((r << 27 | k).tolist()) for k, r in (simhash.keys_of(a), simhash.keys_of(b))]
    assert len({x >> 27 for x in found[0] & found[1]}) == len(a)


def test_links_and_components_of_clusters_match_brute_force(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**62, 25, dtype=np.uint64)
    near = {int(s ^ sum((np.uint64(1) << np.uint64(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)), np.uint64(0))) for s in seeds for _ in range(40)}
    chain = [int(sum(1 << b for b in range(4 * k))) for k in range(15)]  # each 4 bits from the next
    values = sorted({x - 2**64 if x >= 2**63 else x for x in near | set(chain)})
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    groups = defaultdict(set)
    for v in values:
        groups[got.get(v, v)].add(v)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, v in enumerate(values):
        for w in values[:i]:
            if ((v ^ w) & (2**64 - 1)).bit_count() <= 4:
                parent[root(v)] = root(w)
    want = defaultdict(set)
    for v in values:
        want[root(v)].add(v)
    assert {frozenset(x) for x in groups.values()} == {frozenset(x) for x in want.values()}


def test_large_bucket_goes_block_by_block(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    base = np.uint64(0x0123456789ABCDEF)
    prints = np.unique(np.array([base ^ np.uint64(1 << i) ^ np.uint64(1 << j) for i in range(12) for j in range(12)], np.uint64))
    monkeypatch.setattr(simhash, "PENDING", 50)
    found = simhash.Found()
    simhash.match(prints, np.zeros(len(prints), np.int32), found)
    _, roots = found.contract()
    assert len(set(roots.tolist())) == 1


def test_keep_one_keeps_one_row_of_each_component(clashing_docs, odd_texts):
    kept = simhash.keep_one(clashing_docs)
    assert kept.columns == clashing_docs.columns
    rows = defaultdict(list)
    for (d, _, _, group), t in zip(plain_groups([r[:2] for r in odd_texts]), odd_texts):
        rows[group].append((d is None, d, t[1]))
    got = Counter((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect())
    assert sum(got.values()) == len(rows)
    for members in rows.values():
        least = min((m[:2] for m in members), key=lambda m: (m[0], m[1] or 0))
        assert sum(got[(m[1], m[2])] for m in set(members) if m[:2] == least) == 1


def test_empty_table(no_docs):
    assert simhash.clusters(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0


def test_spark_hash_is_the_contracts(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0]
    assert got & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c d", 42)
