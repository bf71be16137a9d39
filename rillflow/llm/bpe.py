"""Byte-level BPE encoding by batched numpy merge rounds, and decoding.

The pieces of many texts are encoded together: their symbols lie in one flat array,
and each round finds the rank of every neighbouring pair by binary search over the
sorted pair keys, takes the lowest rank of each piece, and merges all its occurrences
from the left. Finished pieces leave the array, so late rounds touch few symbols.
Each distinct piece of a batch is encoded once.

A long piece (a text without spaces) merges in many places in a round: a pair may go
ahead of the lowest rank if no lower one stands within the length of the longest token.
What merges earlier can reach it only by growing into it, and no token is that long.

The vocabulary file (a tokenizers JSON) is a parameter. Special tokens in a text are
recognised, as the library does by default. Defined cases: a null text counts as empty:
no ids, the digest of no bytes, and an empty decoded text; very long texts are encoded
whole, with about 40 bytes of memory a byte; repeated rows are encoded each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: The pre-tokenisation pattern of this family of vocabularies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, and the byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shown = set(plain)
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made
        self.of_byte = np.zeros(256, np.int32)
        token = [b""] * self.size
        for text, i in vocab.items():
            token[i] = text.encode("utf-8") if text in self.special else bytes(letters[c] for c in text)
            if len(text) == 1 and text in letters:
                self.of_byte[letters[text]] = i
        for text, i in self.special.items():
            token[i] = text.encode("utf-8")
        self.length = np.array([len(x) for x in token], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.reach = int(self.length[made].max(initial=1))
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        self.pieces = regex.compile(PATTERN).findall
        named = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, named)) + ")").split if named else None

    def cut(self, text: str) -> list[str]:
        """Pieces in text order; a special token is a piece of its own."""
        if not self.split or not any(x in text for x in self.special):
            return self.pieces(text)
        out: list[str] = []
        for i, part in enumerate(self.split(text)):
            out.extend([part] if i % 2 else self.pieces(part))
        return out

    def ranks(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at the places ``at``; the number of merges where there is none."""
        out = np.full(len(at), len(self.keys), np.int32)
        pairs = np.flatnonzero(at + 1 < len(sym))
        pairs = pairs[word[at[pairs]] == word[at[pairs] + 1]]
        key = sym[at[pairs]].astype(np.int64) * self.size + sym[at[pairs] + 1]
        place = np.searchsorted(self.keys, key)
        place[place == len(self.keys)] = 0
        found = self.keys[place] == key
        out[pairs[found]] = self.rank[place[found]]
        return out

    def encode_pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in one flat array, number of ids of each word)."""
        done_ids, done_word = [], []
        raw = [b"" if w in self.special else w.encode("utf-8") for w in words]
        size = np.array([len(x) for x in raw], np.int64)
        sym = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        for i, w in enumerate(words) if self.special else ():
            if w in self.special:
                done_ids.append(np.array([self.special[w]], np.int32))
                done_word.append(np.array([i]))
        none = np.int32(len(self.keys))
        rank = self.ranks(sym, word, np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            count = np.diff(np.r_[first, len(sym)])
            alive = np.repeat(least < none, count)
            if not alive.all():  # words without a pair left are finished
                done_ids.append(sym[~alive])
                done_word.append(word[~alive])
                sym, word, rank = sym[alive], word[alive], rank[alive]
                least, count = least[least < none], count[least < none]
                if not len(sym):
                    break
            limit = np.repeat(least, count)
            long = np.flatnonzero(count > 2 * self.reach)
            for o, n in zip((np.cumsum(count) - count)[long], count[long]):
                limit[o : o + n] = lowest_around(rank[o : o + n], self.reach, none)
            hit = (rank == limit) & (rank < none)
            # Of occurrences that overlap (a run such as x x x), every second one from the left.
            start = np.r_[True, rank[1:] != rank[:-1]]
            if len(long):  # a run is merged as a whole or waits
                run = np.cumsum(start) - 1
                hit &= np.logical_and.reduceat(hit, np.flatnonzero(start))[run]
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[place % 2 == 0]
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, word, rank = sym[stay], word[stay], rank[stay]
            new = at - np.arange(len(at))  # one symbol has gone before each later merge
            for touched in (new, new[new > 0] - 1):
                rank[touched] = self.ranks(sym, word, touched)
        if not done_ids:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        index: dict[str, int] = {}
        places = [np.array([index.setdefault(p, len(index)) for p in self.cut(t)], np.int64) for t in texts]
        flat, size = self.encode_pieces(list(index))
        start = np.cumsum(size) - size
        return [flat[spans(start[at], size[at])] for at in places]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are not UTF-8 become U+FFFD."""
        return self.bytes[spans(self.start[ids], self.length[ids])].tobytes().decode("utf-8", "replace")


def lowest_around(x: np.ndarray, reach: int, none: int) -> np.ndarray:
    """The minimum of x[i - reach], ..., x[i + reach] for each i."""
    width = 2 * reach + 1
    flat = np.full(-(-(len(x) + 2 * reach) // width) * width, none, x.dtype)
    flat[reach : reach + len(x)] = x
    rows = flat.reshape(-1, width)
    before = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[: len(x)], before[width - 1 : width - 1 + len(x)])


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start[i], ..., start[i] + size[i] - 1 for each i in turn."""
    total = int(size.sum())
    before = np.cumsum(size) - size
    return np.arange(total) + np.repeat(start - before, size)


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document doc_id, n_tokens, ids_sha256 and decoded_sha256."""

    def run(batches):
        bpe = load(vocabulary)
        for whole in batches:
            for batch in text_slices(whole):
                ids = bpe.encode_batch([x or "" for x in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(x).encode("utf-8")).hexdigest() for x in ids], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document doc_id and its ids, an array of integers."""

    def run(batches):
        bpe = load(vocabulary)
        for whole in batches:
            for batch in text_slices(whole):
                ids = bpe.encode_batch([x or "" for x in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")
