"""SimHash near-deduplication: 64-bit fingerprints of word shingles, compared exactly in tiles.

A fingerprint bit is set if it is set in over half of the shingles' hashes. Fingerprints link at radius or fewer
differing bits. Two such fingerprints agree in one of radius + 1 blocks of bits, so tiles are cut from the distinct
fingerprints that share a block, ordered by population count; a tile pair whose counts differ by more than the radius
is skipped, any other is compared by exclusive-or and bit counts. A task hands on the links that span what it found,
never all pairs, and these are joined to connected components.

Defined cases: a null text or one without words has fingerprint 0, which links like any other; a null doc_id gets a row
but never names a component unless it holds null ids alone; rows that repeat share a component; very long texts are taken
whole; a bit set in exactly half of the hashes is 0; of several rows with the smallest id, one stays where one is to
stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, heavy_join, in_groups, keep_rows, tile_groups

SHINGLE, RADIUS, SEED = 3, 2, 42
TILE = 2048
_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII white characters
    if not words:
        return 0
    buffer = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _AT_ONCE):
        hashes = np.array([xxh64_intdigest(buffer[s:e], seed) for s, e in zip(starts[at : at + _AT_ONCE], ends[at : at + _AT_ONCE], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _signed(batches):
    import pyarrow as pa

    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], names=["row_id", "doc_id", "fp"])


def spanning(a: np.ndarray, b: np.ndarray, n: int, label: np.ndarray | None = None) -> np.ndarray:
    """For each of n nodes, the smallest node that links a-b (and those of label) reach."""
    label = np.arange(n) if label is None else label
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
    while (label[label] != label).any():
        label = label[label]
    return label


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (unsigned) and, for each that is linked, another that spans its links. right None: within left."""
    items = np.sort(left) if right is None else np.concatenate((left, right))
    counts = np.bitwise_count(items).astype(np.int64)
    if right is None:
        order = np.argsort(counts, kind="stable")
        items, counts = items[order], counts[order]
        rows, columns = [(i, min(i + 256, len(items))) for i in range(0, len(items), 256)], None
    else:
        m = len(left)
        rows, columns = [(i, min(i + 256, m)) for i in range(0, m, 256)], [(j, min(j + 256, len(items))) for j in range(m, len(items), 256)]
    label = np.arange(len(items))
    for i, i2 in rows:
        for j, j2 in columns or [r for r in rows if r[0] >= i]:
            if counts[j:j2].min() - counts[i:i2].max() > radius or counts[i:i2].min() - counts[j:j2].max() > radius:
                continue
            x, y = np.nonzero(np.bitwise_count(items[i:i2, None] ^ items[None, j:j2]) <= radius)
            x, y = x + i, y + j
            new = (x != y) & (label[x] != label[y])
            if new.any():
                label = spanning(x[new], y[new], len(items), label)
    joined = label != np.arange(len(items))
    return items[joined], items[label[joined]]


def _compare(radius: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for table in in_groups(batches):
            gid, side = table.column(0).to_numpy(), table.column(1).to_numpy()
            fp = table.column(2).to_numpy().view(np.uint64)
            edges = np.flatnonzero(np.diff(gid)) + 1
            starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(gid)]))
            a, b = [], []
            two = starts[(ends - starts) == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            a.append(fp[near]), b.append(fp[near + 1])
            for s, e in zip(starts[(ends - starts) > 2], ends[(ends - starts) > 2], strict=True):
                f, k = fp[s:e], side[s:e]
                for found in ([tile_links(f[k == 2], None, radius)] if (k == 2).any() else []) + ([tile_links(f[k == 0], f[k == 1], radius)] if (k == 0).any() and (k == 1).any() else []):
                    a.append(found[0]), b.append(found[1])
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def near_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that span all pairs of distinct fingerprints (column fp) at radius or fewer differing bits."""
    blocks = radius + 1
    width = -(-64 // blocks)
    block = lambda i: F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(F.col("fp"), i * width).bitwiseAND((1 << min(width, 64 - i * width)) - 1).alias("v"))
    keyed = prints.select("fp", F.explode(F.array(*map(block, range(blocks)))).alias("k")).select("fp", F.xxhash64("k.i", "k.v").alias("key"))
    groups = tile_groups(keyed, "key", F.col("fp"), tile, F.bit_count("fp"), radius).select("gid", "side", "fp")
    return groups.repartition("gid").sortWithinPartitions("gid").mapInArrow(_compare(radius), "a long, b long")


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row for each row of docs: row_id, doc_id, fp, component_id, keep_row (the row that stays of its component)."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    texts = docs.select(row.alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(texts.mapInArrow(_signed, "row_id long, doc_id long, fp long"))
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("row_id").alias("r"))
    nodes = cut(rows.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")))
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    linked = components(cut(near_links(nodes.select("fp"))))
    grouped = nodes.join(linked, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fp"))
    named = grouped.groupBy("component").agg(F.min("first").alias("first"))
    nodes = cut(grouped.drop("first").join(named, "component").select("fp", "n", F.col("first.i").alias("component_id"), F.col("first.r").alias("keep_row")))
    return heavy_join(rows, nodes, "fp", F.col("n"), total).select("row_id", "doc_id", "fp", "component_id", "keep_row")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one of the smallest doc_id, with all its columns."""
    return keep_rows(docs, lambda d, row: simhash(d, id_col, text_col, row).filter("row_id = keep_row"))
