"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum of w x + sum over factors of ((sum of v x)^2 - sum of v^2 x^2) / 2), so the pairwise
interactions of all features cost time in proportion to the features that a text has.

Learning: about SAMPLE_DOCS labelled documents outside the held-out fifth, chosen by a hash of the id (all, where there
are fewer). Every round, each shard takes one pass of AdaGrad steps from the shared parameters, and these are averaged.

Defined cases: a null text is empty and is scored by its statistics alone; a null label is not learned, of several
labels of one document the mean counts; without labels every score is 0.5; a null n_chars is a feature of its own;
a null doc_id counts as the empty id and has no label; very long texts are scored whole; rows that repeat are scored one
by one, alike; a score of exactly 0.3 is predicted 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BUCKETS, FACTORS = 1 << 13, 4
SAMPLE_DOCS, SHARDS, ROUNDS, BATCH, RATE, DECAY = 20_000, 6, 8, 64, 0.1, 1e-6
THRESHOLD = 0.3
STATISTICS = 20
SIZE = BUCKETS + STATISTICS


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed words, weighted by their logarithmic counts to length 1, then the statistics."""
    text = text or ""
    raw = text.encode()
    tokens = text.split()
    counts = Counter(tokens)
    n, kinds = max(1, len(tokens)), max(1, len(counts))
    tf = np.fromiter(counts.values(), float, len(counts))
    buckets = np.fromiter((zlib.crc32(w.lower().encode()) & BUCKETS - 1 for w in counts), np.int64, len(counts))
    weights = np.log1p(tf)
    weights /= math.sqrt(float(weights @ weights)) or 1.0
    b = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    upper, lower, digit, high = b[65:91].sum(), b[97:123].sum(), b[48:58].sum(), b[128:].sum()
    usual = b[[44, 46, 39, 45, 63, 58, 59]].sum()  # , . ' - ? : ;
    white = b[[32, 9, 10, 11, 12, 13]].sum()
    marks = size - upper - lower - digit - high - white - usual
    bare = sum(c for w, c in counts.items() if not w[0].isalnum() and not w[-1].isalnum())
    tails = sum(c for w, c in counts.items() if len(w) > 1 and not w[-1].isalnum() and not w[-2].isalnum())
    lines = text.split("\n")
    repeats = sum(map(eq, tokens, tokens[1:])) + sum(map(eq, tokens, tokens[2:]))
    known = n_chars is not None
    statistics = [
        1.0, math.log1p(len(tokens)) / 8, len(counts) / n, kinds / n**0.8 / 3, repeats / n, max(counts.values(), default=0) / n, len(text) / n / 12,
        upper / size * 3, digit / size * 5, marks / size * 3, usual / size * 5, high / size * 2, bare / n, tails / n, white / size * 3,
        math.log1p(len(text) / len(lines)) / 8, 1 - len(set(lines)) / len(lines), max(map(len, counts), default=0) ** 0.5 / 8,
        math.log1p(max(0, n_chars)) / 12 if known else 0.0, 0.0 if known else 1.0,
    ]
    return np.concatenate((buckets, BUCKETS + np.arange(STATISTICS))), np.concatenate((weights, statistics))


def linear_time(w: np.ndarray, v: np.ndarray, ids: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores of rows that begin at starts, and their factor sums."""
    vx = v[ids] * x[:, None]
    sums = np.add.reduceat(vx, starts)
    squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
    return np.add.reduceat(w[ids] * x, starts) + ((sums * sums).sum(axis=1) - squares) / 2, sums


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def one_pass(theta: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, float]], seed: int) -> np.ndarray:
    """theta: SIZE x (1 + FACTORS), after a pass of AdaGrad over rows in shuffled batches."""
    theta, seen = theta.copy(), np.full(theta.shape, 1e-2)
    order = np.random.default_rng(seed).permutation(len(rows))
    for at in range(0, len(order), BATCH):
        part = [rows[i] for i in order[at : at + BATCH]]
        lengths = np.array([len(r[0]) for r in part])
        ids, x, y = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part]), np.array([r[2] for r in part])
        z, sums = linear_time(theta[:, 0], theta[:, 1:], ids, x, np.concatenate(([0], lengths.cumsum()[:-1])))
        row = np.repeat(np.arange(len(part)), lengths)
        pull = (sigmoid(z) - y)[row] * x / len(part)
        each = [pull, *(pull * (sums[row, f] - theta[ids, 1 + f] * x) for f in range(FACTORS))]
        slope = np.stack([np.bincount(ids, weights=g, minlength=SIZE) for g in each], axis=1) + DECAY * theta
        seen += slope * slope
        theta -= RATE * slope / np.sqrt(seen)
    return theta


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> np.ndarray:
    """docs: doc_id, text, n_chars. labels: doc_id, quality."""
    theta = np.random.default_rng(0).normal(0, 0.05, (SIZE, 1 + FACTORS))
    theta[:, 0] = 0
    of = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    total = of.count()
    if not total:
        return np.zeros_like(theta)
    draw = F.pmod(F.xxhash64(F.lit("quality"), "id"), F.lit(1 << 20))
    chosen = F.broadcast(of.filter(draw < max(1, min(1 << 20, (sample_docs << 20) // total))))  # about sample_docs rows of 16 bytes
    sample = docs.join(chosen, docs["doc_id"] == F.col("id")).select("text", F.col("n_chars").cast("long").alias("n_chars"), "y", "id")

    def featurise(batches):
        import pyarrow as pa

        for batch in batches:
            made = [features(t, n) for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([m[0].astype(np.int32).tobytes() for m in made], pa.binary()), pa.array([m[1].astype(np.float32).tobytes() for m in made], pa.binary()), batch.column(2), batch.column(3)], names=["ids", "x", "y", "id"])

    rows = cut(sample.mapInArrow(featurise, "ids binary, x binary, y double, id long").repartition(SHARDS, "id"))
    for k in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(theta)

        def step(batches, shared=shared, k=k):
            import pyarrow as pa

            mine = [(i, np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(x, np.float32).astype(float), y) for batch in batches for a, x, y, i in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            mine.sort(key=lambda r: r[0])
            if mine:
                after = one_pass(shared.value, [r[1:] for r in mine], k)
                yield pa.RecordBatch.from_arrays([pa.array([after.tobytes()]), pa.array([len(mine)])], names=["theta", "n"])

        parts = sorted(rows.mapInArrow(step, "theta binary, n long").collect())  # a few shards' parameters
        if not parts:  # none of the labelled documents is there
            return np.zeros_like(theta)
        theta = sum(np.frombuffer(p, float).reshape(theta.shape) * n for p, n in parts) / sum(n for _, n in parts)
        shared.unpersist()
    return theta


def score(docs: DataFrame, theta: np.ndarray) -> DataFrame:
    """docs (doc_id, held_out, text, n_chars) to doc_id, held_out, score."""
    shared = docs.sparkSession.sparkContext.broadcast(theta)

    def run(batches):
        import pyarrow as pa

        w, v = np.ascontiguousarray(shared.value[:, 0]), np.ascontiguousarray(shared.value[:, 1:])
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                made = [features(t, n) for t, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                starts = np.concatenate(([0], np.cumsum([len(m[0]) for m in made])[:-1])).astype(np.int64)
                z, _ = linear_time(w, v, np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]), starts)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigmoid(z))], names=["doc_id", "held_out", "score"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("long").alias("n_chars"))
    theta = fit(docs, labels.select("doc_id", "quality"), **how)
    scored = score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", "n_chars"), theta)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
