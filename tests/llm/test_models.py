import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from rillflow.llm import hmm, labelled, quality_model, toxicity


def bucket(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def made(seed, n=500):
    """Documents in two moods, with labels: some toxic (rude words), some junk (symbols)."""
    rng = random.Random(seed)
    syllables = ["ba", "ke", "lo", "mi", "nu", "ra", "so", "ti", "vu", "we"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(30, 150))]
        toxic, good = i % 5 == 0, i % 4 != 0
        if toxic:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(["grumblefoo", "zorpling", "quaxbad"]))
        if not good:
            words = [w + rng.choice(["##", "%%", "&&"]) for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = made(1)
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("model,label", [(toxicity, "toxic"), (quality_model, "quality")])
def test_held_out_accuracy(tables, model, label):
    docs, labels = tables
    rows = model.classify(docs, labels).join(labels, "doc_id").collect()
    assert len(rows) == 500
    assert all(r.held_out == (bucket(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r[label] for r in held) >= 0.95 * len(held)


@pytest.mark.parametrize("model", [toxicity, quality_model])
def test_odd_rows(spark, tables, odd_docs, no_docs, model):
    _, labels = tables
    rows = model.classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert model.classify(no_docs, labels).count() == 0
    none = spark.createDataFrame([(None, None, None), (1, None, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in model.classify(odd_docs, none).collect()} == {0.0}


def test_held_out_labels_do_not_matter(spark, tables):
    docs, labels = tables
    flipped = labels.withColumn("toxic", labelled.held_out(labels.doc_id).cast("int").bitwiseXOR(labels.toxic))
    one, two = ({r.doc_id: r.score for r in toxicity.classify(docs, x).collect()} for x in (labels, flipped))
    assert one == two


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    x, bag, y, w = rng.standard_normal((9, 7)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3]), np.array([0, 1, 1, 0]), np.array([1, 2.0, 1, 0.5])
    p = {k: v.astype(float) for k, v in quality_model.start(rng, 7).items()}

    def loss():
        q = quality_model.forward(p, x, bag, 4)["q"]
        return -(w * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum() / w.sum()

    for k, g in quality_model.gradients(p, x, bag, y, w).items():
        i = tuple(0 for _ in p[k].shape)
        at = p[k][i]
        p[k][i] = at + 1e-5
        up = loss()
        p[k][i] = at - 1e-5
        down = loss()
        p[k][i] = at
        assert (up - down) / 2e-5 == pytest.approx(g[i], abs=1e-7)


def test_passages_of_long_texts_are_the_same_in_parts(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["The", "of", "a1", "##", "x\n"]) for _ in range(120_000)).encode()
    one = quality_model.encode([b"", text, b" x"])
    monkeypatch.setattr(quality_model, "CHUNK", 1 << 30)
    two = quality_model.encode([b"", text, b" x"])
    assert np.allclose(one[0], two[0]) and (one[1] == two[1]).all()


def test_forward_is_the_sum_over_state_paths():
    import itertools

    rng = np.random.default_rng(2)
    start, move, emit = rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(4), 2)
    model = hmm.Hmm(start, move, emit)
    seqs = [np.array([0, 3, 2, 1, 1], np.uint16), np.array([2], np.uint16), np.array([1, 0, 1], np.uint16)]
    for s, got in zip(seqs, model.score(seqs)):
        total = 0.0
        for path in itertools.product(range(2), repeat=len(s)):
            p = start[path[0]] * emit[path[0], s[0]]
            for a, b, o in zip(path, path[1:], s[1:]):
                p *= move[a, b] * emit[b, o]
            total += p
        assert got == pytest.approx(math.log10(total))
    first, moves, emits = model.expect(seqs)
    assert first.sum() == pytest.approx(3) and moves.sum() == pytest.approx(6) and emits.sum() == pytest.approx(9)
    # Expected counts by enumeration.
    want = np.zeros((4, 2))
    for s in seqs:
        paths = list(itertools.product(range(2), repeat=len(s)))
        w = np.array([start[p[0]] * emit[p[0], s[0]] * math.prod(move[a, b] * emit[b, o] for a, b, o in zip(p, p[1:], s[1:])) for p in paths])
        for p, x in zip(paths, w / w.sum()):
            for state, o in zip(p, s):
                want[o, state] += x
    assert np.allclose(emits, want)


def test_language_model_scores(odd_docs, odd_texts, tables):
    rows = hmm.score(odd_docs).collect()
    words = lambda t: (t or "").encode().lower().split()
    train = Counter()
    for d, t, *_ in odd_texts:
        if bucket(d, 10):
            train.update([*words(t), b""])
    n, v = train.total(), len(train)
    want = Counter()
    for d, t, *_ in odd_texts:
        tokens = [*words(t), b""]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want[d, bucket(d, 10) == 0, len(tokens), sum(train[w] > 0 for w in tokens), n, round(base, 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)


@pytest.mark.parametrize("broadcast", [hmm.BROADCAST_WORDS, 10])
def test_every_frequent_word_has_its_own_emission(spark, monkeypatch, broadcast):
    monkeypatch.setattr(hmm, "BROADCAST_WORDS", broadcast)
    least = 10
    ids = [i for i in range(100) if bucket(i, 10)][:least]
    docs = [(i, " ".join(f"w{k}x" for k in range(3000)) + " rare") for i in ids[:-1]] + [(ids[-1], " ".join(f"w{k}x" for k in range(3000)))]
    seen, train = [], hmm.train
    monkeypatch.setattr(hmm, "train", lambda rows, unigram: seen.append((unigram, train(rows, unigram))) or seen[-1][1])
    rows = hmm.score(spark.createDataFrame(docs, "doc_id long, text string"), least).collect()
    unigram, model = seen[0]
    assert model.emit.shape == (hmm.STATES, hmm.FIRST_OWN + 3001)  # all but "rare", and the end token
    assert (unigram.mass[hmm.FIRST_OWN :] > 0).all() and np.allclose(model.emit.sum(1), 1)
    assert len(rows) == least and all(math.isfinite(r.score) for r in rows)


def test_word_probabilities_sum_to_one():
    """Over all words of a state: emissions times shares, the unseen type included."""
    counts = {b"the": 40, b"of": 11, b"rain": 5, b"again": 2, b"x": 1}
    words = list(counts)
    cls = hmm.suffixes(words)
    sums = {}
    for w, k in zip(words, cls):
        c, m = sums.get(int(k), (0, 0))
        sums[int(k)] = c + counts[w], m + 1
    unigram = hmm.Unigram(59, 5, sums, hmm.FIRST_OWN)
    model = hmm.Hmm.initial(unigram)
    for state in range(hmm.STATES):
        total = model.emit[state, 0] + sum(model.emit[state, k] * unigram.word(np.array(counts[w])) / unigram.mass[k] for w, k in zip(words, cls))
        assert total == pytest.approx(1)


def test_training_raises_the_likelihood(tables, monkeypatch):
    docs, _ = tables
    scores = []
    for rounds in (0, 4):
        monkeypatch.setattr(hmm.train, "__defaults__", (rounds,))
        scores.append(sum(r.score for r in hmm.score(docs).collect()))
    assert scores[1] > scores[0]


def test_empty_language_model(spark, no_docs):
    assert hmm.score(no_docs).count() == 0
    held = spark.createDataFrame([(None, "only held out words")], "doc_id long, text string")
    row = hmm.score(held).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (5, 0, 0, pytest.approx(0.0))
