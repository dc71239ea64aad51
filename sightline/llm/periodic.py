"""Runs of repeating words in a text, found by recompression.

A sequence of words is compressed level by level: a level turns each block of equal symbols into one symbol that knows
symbol and count; where no equal symbols adjoin, it pairs symbols of a left with symbols of a right half of the alphabet. Equal stretches of
words are parsed alike but for their ends, so the longest common extension of two places is found by climbing while
their symbols agree and descending where they differ, in a few steps a level. Texts of a batch are compressed as one
sequence, with a symbol of its own after each, which no extension crosses.

A run of period p and length 2p or more covers two places of the grid 0, p, 2p, ...; so for each p, neighbours in its
grid whose words agree are extended both ways. There are n/p of them, and n log n for a text of n words. What is found
for a multiple of a run's period has the same ends, and the smallest period stays.

Defined cases: a null or empty text has no words and no runs; a null doc_id is no planted text (see planted); very long
texts are compressed alone, whole; rows that repeat are judged one by one; ties for the longest run go to the smallest
start, then period; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD

LEAST = 12
#: Words compressed together, and grid places looked at together.
TOGETHER, PLACES = 200_000, 500_000
RUNS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)
_WORD = re.compile(WORD)


class _Side:
    """The levels of a grammar as seen from left to right, or mirrored: for each place of a level its symbol, what is
    left of its block, its parent and whether it is the parent's first; for each parent its first place."""

    def __init__(self, symbols: list[np.ndarray], parents: list[np.ndarray], blocks: list[bool], mirrored: bool):
        self.symbols = [s[::-1] for s in symbols] if mirrored else symbols
        self.parents = [p[-1] - p[::-1] for p in parents] if mirrored else parents
        self.first, self.begins, self.left = [], [], []
        for parent, block in zip(self.parents, blocks, strict=True):
            first = np.concatenate(([True], parent[1:] != parent[:-1]))
            begins = np.flatnonzero(first)
            self.first.append(first)
            self.begins.append(begins)
            ends = np.append(begins[1:], len(parent))
            self.left.append(ends[parent] - np.arange(len(parent)) if block else None)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a and from b on agree (places that differ, before some unique symbol)."""
        out = np.zeros(len(a), np.int64)
        top = len(self.symbols) - 1
        waiting: list[tuple] = []
        rows, x, y = np.arange(len(a)), a, b
        for level in range(top + 1):
            same = self.symbols[level][x] == self.symbols[level][y]
            if level < top and same.any():
                apart = ~same
                waiting.append((rows[apart], x[apart], y[apart]))
                rows, x, y = rows[same], x[same], y[same]
                ragged = ~(self.first[level][x] & self.first[level][y])
                if ragged.any():
                    # Past what is left of the shorter block, or past the one symbol of a pair.
                    rx, ry, mine = x[ragged], y[ragged], rows[ragged]
                    step = 1 if self.left[level] is None else np.minimum(self.left[level][rx], self.left[level][ry])
                    rx, ry = rx + step, ry + step
                    differ = self.symbols[level][rx] != self.symbols[level][ry]
                    waiting[-1] = tuple(np.concatenate((w, z[differ])) for w, z in zip(waiting[-1], (mine, rx, ry), strict=True))
                    even, on = ~ragged, ~differ
                    rows, x, y = (np.concatenate((u[even], z[on])) for u, z in ((rows, mine), (x, rx), (y, ry)))
                x, y = self.parents[level][x], self.parents[level][y]
            else:
                waiting.append((rows, x, y))
                break
        rows = x = y = np.zeros(0, np.int64)
        for level in range(len(waiting) - 1, -1, -1):
            if len(rows):  # from a level above: the places differ there, so their first parts may agree
                x, y = self.begins[level][x], self.begins[level][y]
                same = np.flatnonzero(self.symbols[level][x] == self.symbols[level][y])
                step = 1 if self.left[level] is None else np.minimum(self.left[level][x[same]], self.left[level][y[same]])
                x[same] += step
                y[same] += step
            rows, x, y = (np.concatenate(z) for z in zip((rows, x, y), waiting[level], strict=True))
        out[rows] = x - a[rows]
        return out


class Grammar:
    """A run-length grammar of a sequence that ends with a symbol of its own; extensions to both sides."""

    def __init__(self, symbols: np.ndarray, seed: int = 1):
        levels, parents, blocks = [symbols.astype(np.int64)], [], []
        fresh = int(symbols.max()) + 1 if len(symbols) else 1
        rng = np.random.default_rng(seed)
        while True:
            s = levels[-1]
            seen = np.zeros(fresh, bool)
            seen[s] = True
            if np.count_nonzero(seen) == len(s):  # no two places agree any more
                break
            begin = np.concatenate(([True], s[1:] != s[:-1]))
            block = not begin.all()
            if block:
                at = np.flatnonzero(begin)
                key, other = s[at], np.diff(np.append(at, len(s)))
                made = other > 1
            else:
                half = (rng.random(fresh) < 0.5)[s]
                pairs = half[:-1] & ~half[1:]
                back = ~half[:-1] & half[1:]
                pairs = back if back.sum() > pairs.sum() else pairs
                begin = np.concatenate(([True], ~pairs))
                at = np.flatnonzero(begin)
                key, made = s[at], np.append(pairs, False)[at]
                other = np.where(made, s[np.minimum(at + 1, len(s) - 1)], 0)
            above = key.copy()
            if made.any():
                joint = np.stack((key[made], other[made]))
                order = np.lexsort(joint)
                sorted_ = joint[:, order]
                change = np.concatenate(([0], (sorted_[:, 1:] != sorted_[:, :-1]).any(axis=0))).cumsum()
                name = np.empty(len(order), np.int64)
                name[order] = fresh + change
                above[made] = name
                fresh += int(change[-1]) + 1
            parents.append(np.cumsum(begin) - 1)
            blocks.append(block)
            levels.append(above)
        self.length = len(symbols)
        self._right = _Side(levels, parents, blocks, False)
        self._left = _Side(levels, parents, blocks, True)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Agreement of what begins at a and at b."""
        return self._right.extension(a, b)

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Agreement of what ends right before a and before b (both > 0)."""
        return self._left.extension(self.length - a, self.length - b)


def _grid(sizes: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places i and periods p, with the text, such that i is a multiple of p within it and i + p is in it too."""
    texts = np.repeat(np.arange(len(sizes)), sizes // 2)
    if not len(texts):
        return
    offsets = np.cumsum(sizes // 2) - sizes // 2
    periods = np.arange(len(texts)) - offsets[texts] + 1
    counts = (sizes[texts] - 1) // periods
    ends = np.cumsum(counts)
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + PLACES, "right")))
        n = counts[at:stop]
        which = np.repeat(np.arange(at, stop), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        yield begins[texts[which]] + k * periods[which], periods[which], texts[which]
        at = stop


def runs(sequences: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """For each sequence of symbols (longs >= 0) its maximal runs with their smallest periods, as rows (start, length,
    period) sorted by start, then period."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    top = max((int(s.max()) for s in sequences if len(s)), default=0) + 1
    # A symbol of its own before the first text and after each.
    whole = np.concatenate([np.array([top]), *(x for i, s in enumerate(sequences) for x in (s, np.array([top + 1 + i])))])
    begins = np.cumsum(sizes + 1) - sizes
    grammar, found = None, []
    for i, p, text in _grid(sizes, begins):
        same = whole[i] == whole[i + p]
        i, p, text = i[same], p[same], text[same]
        if not len(i):
            continue
        grammar = grammar or Grammar(whole)
        start = i - grammar.backward(i, i + p)
        length = i + p + grammar.forward(i, i + p) - start
        good = (length >= np.maximum(least, 2 * p)) & (i - start < p)
        found.append(np.stack((text[good], start[good] - begins[text[good]], length[good], p[good])))
    if not sum(x.shape[1] for x in found):
        return [np.zeros((0, 3), np.int64) for _ in sequences]
    rows = np.concatenate(found, axis=1).T
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    # Of equal stretches the smallest period.
    rows = rows[np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(sequences) + 1))
    return [rows[a:b, 1:] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def repeated(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return edges.cumsum()[:n] > 0


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """Words of every tenth text (by a hash of its id) repeat from some place on, so that there are runs to find."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def as_given(doc_id: int | None, words: list[str]) -> list[str]:
    return words


def _judged(change: Callable[[int | None, list[str]], list[str]], least: int, digests: bool):
    """For mapInArrow: doc_id, text to one row a text."""
    import pyarrow as pa

    def done(ids: list, texts: list[list[str]]):
        names: dict[str, int] = {}
        sequences = [np.array([names.setdefault(w, len(names)) for w in words], np.int64) for words in texts]
        columns: list[list] = [[] for _ in range(7 if digests else 2)]
        for words, found in zip(texts, runs(sequences, least), strict=True):
            gone = repeated(len(words), found)
            kept = " ".join(words if not gone.any() else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            if digests:
                best = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist() if len(found) else [None] * 3
                milli = 1000 * best[1] // best[2] if len(found) else None
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
                row = [len(found), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()]
            else:
                row = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found.tolist()], kept]
            for column, x in zip(columns, row, strict=True):
                column.append(x)
        if digests:
            types = [pa.int64()] * 5 + [pa.string()] * 2
        else:
            types = [pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])), pa.string()]
        arrays = [pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
        names_ = [f.split()[0] for f in RUNS.split(", ")] if digests else ["doc_id", "runs", "collapsed"]
        return pa.RecordBatch.from_arrays(arrays, names=names_)

    def run(batches):
        for batch in batches:
            ids: list = []
            texts: list[list[str]] = []
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = change(doc_id, _WORD.findall(text.as_py() or ""))
                if ids and size + len(words) > TOGETHER:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                size += len(words)
            if ids:
                yield done(ids, texts)

    return run


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def without_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length, period, in words) and collapsed: the words that no run repeats, one space apart."""
    return _given(docs, id_col, text_col).mapInArrow(_judged(as_given, least, False), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def run_digests(docs: DataFrame, change: Callable = planted, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row a text: how many runs, the longest, digests of all and of what stays; texts as change makes them."""
    return _given(docs, id_col, text_col).mapInArrow(_judged(change, least, True), RUNS)
