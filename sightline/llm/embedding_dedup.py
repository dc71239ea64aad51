"""Embedding near-deduplication by random-hyperplane sign hashing.

Equal vectors are one class. Each class is hashed into several tables; a table's key is the signs of its dot products
with random hyperplanes. Classes that share a key are compared by exact cosine in double precision, in tiles where a
key is common; a pair counts in the first table that it shares, so a vector carries its keys of this table and
earlier ones along. Linked classes are joined to connected components.

Keys have about log2(classes) - 4 bits, and as many tables are used as find a pair at the threshold with chance RECALL.

Defined cases: a vector that is null, empty or zero, or holds null or non-finite components, links with nothing, also
not with its equals; vectors of different lengths never link; a null vec_id gets a row, is never kept and names no
component unless it is alone; rows that repeat link to each other; a cosine of exactly the threshold links; of rows that
share the smallest id of a component, each is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import components, cut, heavy_join, in_groups, tile_groups

THRESHOLD, RECALL, SEED, TILE = 0.9, 0.97, 7, 1024


def tables(classes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key, and tables."""
    bits = min(60, max(6, round(math.log2(max(2, classes))) - 4))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - share)))


def _hash(bits: int, n_tables: int, seed: int, kind: str):
    planes: dict[int, np.ndarray] = {}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            vectors = batch.column(1).to_pylist()
            keys = np.zeros((len(vectors), n_tables), np.int32 if bits < 32 else np.int64)
            by: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by.setdefault(len(v), []).append(i)
            for d, rows in by.items():
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).normal(size=(d, bits * n_tables))
                x = np.array([vectors[i] for i in rows], float)
                signs = ((x / np.abs(x).max(axis=1, keepdims=True)) @ planes[d] > 0).reshape(len(rows), n_tables, bits)
                keys[rows] = signs @ (1 << np.arange(bits, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(v, kind).tobytes() for v in vectors], pa.binary()), pa.array(list(keys), pa.list_(pa.int32() if bits < 32 else pa.int64())), batch.column(2)], names=["cid", "vector", "keys", "n"])

    return run


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    return (a @ b.T) / np.sqrt((a * a).sum(axis=1))[:, None] / np.sqrt((b * b).sum(axis=1))[None, :]


def _compare(threshold: float, kind: str):
    from .simhash import spanning

    def run(batches):
        import pyarrow as pa

        for table in in_groups(batches):
            gid, t, size = (table.column(i).to_numpy() for i in (0, 2, 7))
            edges = np.flatnonzero((np.diff(gid) != 0) | (np.diff(t) != 0) | (np.diff(size) != 0)) + 1
            out: list[list] = [[], [], []]
            for s, e in zip([0, *edges], [*edges, len(gid)], strict=True):
                g = table.slice(s, e - s)
                side, cid, n = (g.column(i).to_numpy() for i in (1, 3, 6))
                x = np.array([np.frombuffer(v, kind) for v in g.column(4).to_pylist()], float)
                keys = np.array(g.column(5).to_pylist())
                add, label = np.zeros(len(cid), np.int64), np.arange(len(cid))
                for left, right in ((side == 2, None), (side == 0, side == 1)):
                    i = np.flatnonzero(left)
                    j = i if right is None else np.flatnonzero(right)
                    for at in range(0, len(i), 256):
                        rows = i[at : at + 256]
                        near = cosines(x[rows], x[j]) >= threshold if len(j) else np.zeros((len(rows), 0), bool)
                        a, b = np.nonzero(near)
                        a, b = rows[a], j[b]
                        ok = a < b if right is None else np.ones(len(a), bool)
                        a, b = a[ok], b[ok]
                        met = keys[a] == keys[b]  # in this table, and in no earlier one
                        ok = met[:, -1] & ~met[:, :-1].any(axis=1)
                        a, b = a[ok], b[ok]
                        np.add.at(add, a, n[b]), np.add.at(add, b, n[a])
                        label = spanning(a, b, len(cid), label)
                for i in np.flatnonzero(add):
                    out[0].append(int(cid[i])), out[1].append(int(add[i])), out[2].append(int(cid[label[i]]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["cid", "links", "to"])

    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE, seed: int = SEED) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept."""
    v = F.col("v")
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False))
    # Single precision is carried as such; cosines are always taken in double.
    given = vectors.select(vector_col).schema[0].dataType
    single = isinstance(given, ArrayType) and isinstance(given.elementType, FloatType)
    kind, sql_kind = ("f4", "float") if single else ("f8", "double")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{sql_kind}>").alias("v")).withColumn("fine", fine)
    good = rows.filter("fine").select("vec_id", "v")
    classes = cut(good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("cid", F.monotonically_increasing_id()))
    n_classes, n_rows = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits, n_tables = tables(n_classes, threshold, recall)
    hashed = cut(classes.select("cid", "v", "n").mapInArrow(_hash(bits, n_tables, seed, kind), f"cid long, vector binary, keys array<{'int' if bits < 32 else 'long'}>, n long"))
    keyed = hashed.select("cid", F.octet_length("vector").alias("d"), F.posexplode("keys").alias("t", "k")).select("cid", "t", F.xxhash64("d", "t", "k").alias("key"))
    groups = tile_groups(keyed, "key", F.col("cid"), tile).select("gid", "side", "t", "cid").join(hashed, "cid").select("gid", "side", "t", "cid", "vector", F.slice("keys", F.lit(1), F.col("t") + 1).alias("keys"), "n", F.octet_length("vector").alias("size"))
    found = cut(groups.repartition("gid").sortWithinPartitions("gid", "t", "size").mapInArrow(_compare(threshold, kind), "cid long, links long, to long"))
    linked = components(found.select(F.col("cid").alias("a"), F.col("to").alias("b")))
    degree = found.groupBy("cid").agg(F.sum("links").alias("links"))
    of = classes.join(degree, "cid", "left").join(linked, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    named = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = cut(of.join(named, "component").select("v", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    alone = rows.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = heavy_join(good, of, "v", F.col("n"), n_rows).select("vec_id", "n_links", "component_id").unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
