"""Removes repeated passages: every byte covered by a string of LENGTH bytes that also starts in a document with a
smaller id.

Ranking all suffixes at every byte would sort some fourteen times the corpus. Positions are therefore thinned by
content, and what is left is ranked at growing lengths, each rank made by Spark from the pair of the rank before and
the bytes around it, until it is unique to one document or past the threshold:

1. GRAM bytes. Every window of LENGTH bytes has an anchor, the first of its GRAM-byte strings with the least hash, and
   equal windows have equal anchors at equal offsets. The windows of one anchor form a run. Anchors are dealt and
   sorted by Spark by (gram, stretch, id), a stretch being all bytes of a run, LENGTH at least: of equal stretches
   those of a larger id are repeated. A gram that one document holds alone is dropped here, with its run.
2. About 40 bytes. What else meets by a gram is in doubt and is ranked by the bytes that a third of the run's windows
   share; what has no rival in another document is dropped.
3. LENGTH bytes. The rest is ranked by pairs of that rank and the bytes by which each window is longer. A window whose
   rank also has a smaller id is repeated.

No task holds a group: rows of one gram come sorted and are read as a stream, and a chunk of text hands on two entries
of a gram at most when documents within the chunk already meet in it. Later ranks are sums before the shuffle and joins
that Spark may split. Stretches are told apart by 64 bits of their own next to 48 of their gram, the 40 bytes by 128
bits, and the last ranks by the bytes themselves.

Defined cases: a null text is empty; a null id counts as the largest; rows of one id never remove each other's bytes;
rows that repeat get equal results; very long texts are read in sections, with the same result; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

LENGTH, GRAM, SEED = 50, 20, 5
LAST = (1 << 63) - 1
#: Bytes of a long text's sections, and of text whose anchors a task brings together.
SECTION, CHUNK = 1 << 18, 1 << 22
#: Bytes after which sections are hashed: few enough for a core's cache.
AT_ONCE = 1 << 16
#: Grams are dealt in so many slices, one after another, each with a shuffle of its own: less disk, for hashing texts again.
SLICES = 2
_ENTRY = ("h", "c", "doc", "lo", "span", "off")
_PLACE = 24  # bits of a hash that give way to a place
_PLACES = np.uint64((1 << _PLACE) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


class Thinner:
    """Anchors of texts laid one after another."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.length, self.gram, self.width = length, gram, length - gram + 1
        if not 0 < gram <= length or self.width > 256:
            raise ValueError("1 to length bytes for an anchor, at most 255 fewer than length")
        self.byte = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 62, 1 << 63)) | 1
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.places = np.zeros(1, np.uint64)

    def parts(self) -> list[tuple[int, int]]:
        """Offsets of an anchor in its windows, in three parts."""
        cuts = [0, -(-self.width // 3), -(-2 * self.width // 3), self.width]
        return [(a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False)]

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            def powers(b: int) -> np.ndarray:
                steps = np.full(n, b % (1 << 64), np.uint64)
                steps[0] = 1
                return np.multiply.accumulate(steps)

            self.powers, self.inverses = powers(self.base), powers(pow(self.base, -1, 1 << 64))
            self.places = np.arange(n, dtype=np.uint64)

    def anchors(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slices: int = 1, mine: int = 0) -> dict[str, np.ndarray]:
        """data: all bytes; starts, ends of the texts; of the anchors, one slice. h: anchor hash, c: hash of the stretch, doc, lo: first window
        of the run in its text, span: last window - lo, off: anchor - lo."""
        none = {k: np.zeros(0, np.uint64 if k in "hc" else np.int64) for k in _ENTRY}
        n, g, w = len(data), self.gram, self.width
        inside = ends - starts >= self.length
        if not inside.any():
            return none
        if n > 1 << _PLACE:
            raise ValueError(f"{n} bytes at once, more than {1 << _PLACE}")
        self.grow(n + 1)
        summed = np.zeros(n + 1, np.uint64)
        np.cumsum(np.take(self.byte, data) * self.inverses[:n], out=summed[1:])
        hashes = _mix((summed[g:] - summed[:-g]) * self.powers[: n - g + 1])
        # least hash, then first place, of the next `reach` strings: the place stands in the hash's last bits
        least, reach = hashes & ~_PLACES | self.places[: len(hashes)], 1
        while reach < w:
            step = min(reach, w - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        docs, starts, last = np.flatnonzero(inside), starts[inside], ends[inside] - self.length
        new = np.concatenate(([True], least[1:] != least[:-1]))
        new[starts] = True
        heads = np.flatnonzero(new)
        of = np.searchsorted(starts, heads, "right") - 1
        tails = np.minimum(np.concatenate((heads[1:], [len(least)])) - 1, last[of])
        anchor = (least[heads] & _PLACES).astype(np.int64)
        # least hashes are all small: mixed again, they spread evenly
        h = _mix(hashes[anchor] + np.uint64(0x632BE59BD9B4E019))
        own = (of >= 0) & (heads <= tails)  # what begins over a text's end is no window
        if slices > 1:
            own &= (h >> np.uint64(32) & np.uint64(0xFFFF)) % np.uint64(slices) == mine
        h, lo, hi, anchor, of = h[own], heads[own], tails[own], anchor[own], of[own]
        stretch = (summed[hi + self.length] - summed[lo]) * self.powers[lo]
        shape = (hi - lo).astype(np.uint64) * np.uint64(256) + (anchor - lo).astype(np.uint64)
        return {"h": h, "c": _mix(stretch ^ _mix(shape + np.uint64(1))), "doc": docs[of], "lo": lo - starts[of], "span": hi - lo, "off": anchor - lo}


#: What a row says of its windows: met in the shuffle by its gram; repeated; in doubt; only stands for others.
ENTRY, REPEATED, DOUBT, STANDS = 0, 1, 2, 3
_KIND = 40  # bits below it hold the first window's place
_ROWS = "gram long, stretch long, id long, rid long, place long"
_THINNERS: dict[tuple, Thinner] = {}


def _rows(gram, stretch, ids, rid, place):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, stretch, ids, rid, place)], names=["gram", "stretch", "id", "rid", "place"])


def _order(rows: list[np.ndarray]) -> np.ndarray:
    """np.lexsort by the first column, then the next; only rows that share the first are sorted by the rest."""
    order = np.argsort(rows[0])
    first = rows[0][order]
    same = np.concatenate(([False], first[1:] == first[:-1], [False]))
    at = np.flatnonzero(same[1:] | same[:-1])
    shared = order[at]
    order[at] = shared[np.lexsort([x[shared] for x in rows[::-1]])]
    return order


class Meeting:
    """Entries sorted by (gram, stretch, id, rid, place), batch by batch: which repeat the stretch of a smaller id, and
    which meet another document's in their gram. Between batches it keeps the last row and, of a gram that one id alone
    holds so far, that id's rows."""

    def __init__(self):
        self.pending = [np.zeros(0, np.int64)] * 5
        self.last = self.least = None
        self.several = False

    def meet(self, rows: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Rows (those pending come first) and three masks: repeated, in doubt, dropped as the same row again."""
        rows = [np.concatenate(x) for x in zip(self.pending, rows, strict=True)]
        gram, stretch, ids = rows[0], rows[1], rows[2]
        n = len(gram)
        new, same = np.ones(n, bool), np.zeros(n, bool)
        new[1:] = (gram[1:] != gram[:-1]) | (stretch[1:] != stretch[:-1])
        same[1:] = ~new[1:] & (ids[1:] == ids[:-1]) & (rows[3][1:] == rows[3][:-1]) & (rows[4][1:] == rows[4][:-1])
        group = gram >> 16
        goes_on = self.last is not None and self.last[0] >> 16 == group[0]
        if not len(self.pending[0]) and self.last is not None:
            new[0] = self.last[:2] != (gram[0], stretch[0])
            same[0] = self.last == tuple(x[0] for x in rows)
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        least = ids[head]
        if not new[0]:
            least = np.where(head == 0, self.least, least)
        over = ids > least
        heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        several = np.minimum.reduceat(least, heads) != np.maximum.reduceat(least, heads)
        several[0] |= goes_on and self.several
        sizes = np.diff(np.concatenate((heads, [n])))
        doubt = np.repeat(several, sizes) & ~over & ~same
        self.last, self.least, self.several = tuple(x[-1] for x in rows), least[-1], bool(several[-1])
        open_end = slice(n, n) if self.several else slice(heads[-1], n)
        stay = ~over[open_end] & ~same[open_end]
        self.pending = [x[open_end][stay] for x in rows]
        return rows, over & ~same, doubt, same


def _thin(length: int, gram: int, section: int, chunk: int, slices: int = 1, mine: int = 0):
    def flush(found, rid, ids):
        found = {k: np.concatenate([f[k] for f in found]) for k in _ENTRY}
        if not len(found["h"]):
            return
        rid, ids = np.array(rid, np.int64), np.array(ids, np.int64)
        key = (found["h"] >> np.uint64(16) << np.uint64(16) | found["span"].astype(np.uint64) << np.uint64(8) | found["off"].astype(np.uint64)).view(np.int64)
        rows = [key, found["c"].view(np.int64), ids[found["doc"]], rid[found["doc"]], found["lo"]]
        order = _order(rows)
        met = Meeting()
        rows, over, doubt, same = met.meet([x[order] for x in rows])
        kind = np.where(over, REPEATED, np.where(doubt, DOUBT, ENTRY))
        out = [x[~same] for x in (*rows[:4], rows[4] + (kind << _KIND))]
        yield _rows(*out)
        at = np.flatnonzero(doubt)  # of each gram in doubt, two entries of different ids stand for the rest
        if len(at):
            group, who = rows[0][at] >> 16, rows[2][at]
            heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            sizes = np.diff(np.concatenate((heads, [len(at)])))
            other = np.where(who != np.repeat(who[heads], sizes), np.arange(len(at)), len(at))
            two = np.concatenate((at[heads], at[np.minimum.reduceat(other, heads)]))
            yield _rows(*(x[two] for x in rows[:4]), rows[4][two] + (STANDS << _KIND))

    section = min(section, 1 << _PLACE - 1)

    def run(batches):
        thinner = _THINNERS.setdefault((length, gram), Thinner(length, gram))
        rid, ids, found, size = [], [], [], 0
        parts, waiting = [], 0  # (text's number, place of the section, bytes)

        def hashed():
            lengths = np.array([len(x[2]) for x in parts], np.int64)
            ends = lengths.cumsum()
            new = thinner.anchors(np.frombuffer(b"".join(x[2] for x in parts), np.uint8), ends - lengths, ends, slices, mine)
            new["lo"] = new["lo"] + np.array([x[1] for x in parts], np.int64)[new["doc"]]
            new["doc"] = np.array([x[0] for x in parts], np.int64)[new["doc"]]
            found.append(new)

        for batch in batches:
            for r, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = memoryview(t.as_buffer())
                rid.append(r), ids.append(i)
                for at in range(0, max(1, len(text) - length + 1), section):
                    parts.append((len(rid) - 1, at, bytes(text[at : at + section + length - 1])))
                    waiting += len(parts[-1][2])
                    size += len(parts[-1][2])
                    if waiting >= min(section, AT_ONCE):
                        hashed()
                        parts, waiting = [], 0
                    if size >= chunk:
                        if parts:
                            hashed()
                        yield from flush(found, rid, ids)
                        rid, ids, found, size, parts, waiting = [r], [i], [], 0, [], 0
        if parts:
            hashed()
        if found:
            yield from flush(found, rid, ids)

    return run


_SPANS = "kind int, id long, rid long, run long"


def _met(batches):
    """Rows sorted by gram, to repeated and doubtful runs of windows: the first window's place, 8 bits of how many more, 8
    of the anchor's offset. What chunks have settled passes through."""
    import pyarrow as pa

    meeting = Meeting()

    def spans(kind, rows):
        gram, _, ids, rid, place = rows
        run = (place & (1 << _KIND) - 1) << 16 | gram & 0xFFFF
        kind = np.full(len(run), kind, np.int32) if np.isscalar(kind) else kind.astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (kind, ids, rid, run)], names=["kind", "id", "rid", "run"])

    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        kind = rows[4] >> _KIND
        settled = (kind == REPEATED) | (kind == DOUBT)
        if settled.any():
            yield spans(kind[settled], [x[settled] for x in rows])
        if settled.all():
            continue
        rows, over, doubt, _ = meeting.meet([x[~settled] for x in rows])
        own = rows[4] >> _KIND == ENTRY
        yield spans(REPEATED, [x[over & own] for x in rows])
        yield spans(DOUBT, [x[doubt & own] for x in rows])


def _squeezed(batches):
    import pyarrow as pa
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = [squeeze(t.as_buffer().to_pybytes()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["id", "rid", "data"])


_TAGS = [bytes([k]) for k in range(3)]  # of the parts
_CORES = "id long, rid long, anchor long, lo long, hi long, part int, rank binary, before binary, after binary"


def _cores(length: int, parts: list[tuple[int, int]]):
    """For each part of a run in doubt: its rank, a digest of the bytes that all its windows share, and the bytes around."""

    def run(batches):
        import pyarrow as pa
        import zstandard
        from xxhash import xxh3_128_digest

        names = [f.split()[0] for f in _CORES.split(", ")]
        near, far = np.array(parts).T
        open_up, last = zstandard.ZstdDecompressor().decompress, None
        for whole in batches:
            # as many texts at once as have some thousand runs
            ends = np.asarray(whole.column(3).value_lengths()).cumsum()
            cuts = [0, *(np.flatnonzero(np.diff(ends // 8192)) + 1).tolist(), len(ends)]
            for batch in (whole.slice(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False)):
                ids, rids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                if not len(ids):
                    continue
                again = np.concatenate(([last == (ids[0], rids[0])], (ids[1:] == ids[:-1]) & (rids[1:] == rids[:-1])))  # the same row again
                last = ids[-1], rids[-1]
                text_of = np.repeat(np.arange(len(ids)), np.asarray(batch.column(3).value_lengths()))
                packed = batch.column(3).flatten().to_numpy()
                lo = (packed >> 16)[:, None]
                hi, anchor = lo + (packed >> 8 & 255)[:, None], lo + (packed & 255)[:, None]
                first, end = np.maximum(lo, anchor - far), np.minimum(hi, anchor - near)
                fine = (first <= end) & ~again[text_of][:, None]
                at, part = np.nonzero(fine)
                if not len(at):
                    continue
                anchor, of, extra = anchor[at, 0], text_of[at], (far - near)[part]
                a = anchor - near[part]
                b = anchor - far[part] + length
                slices = list(zip(part.tolist(), np.maximum(0, a - extra).tolist(), a.tolist(), b.tolist(), (b + extra).tolist(), strict=True))
                ranks, before, after = [], [], []
                heads = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))).tolist()
                for x, y in zip(heads, [*heads[1:], len(of)], strict=True):
                    text = open_up(batch.column(2)[int(of[x])].as_buffer())
                    for k, p, q, r, t in slices[x:y]:
                        ranks.append(xxh3_128_digest(text[q:r]) + _TAGS[k])
                        before.append(text[p:q])
                        after.append(text[r:t])
                numbers = (ids[of], rids[of], anchor, first[fine], end[fine], part.astype(np.int32))
                yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), *(pa.array(x, pa.binary()) for x in (ranks, before, after))], names=names)

    return run


def with_rivals(rows: DataFrame) -> DataFrame:
    """Adds first, the smallest id of a rank; rows whose rank one id alone holds are dropped. Sums before the shuffle,
    then a join of two tables, of which Spark may split a frequent rank."""
    met = cut(rows.groupBy("rank").agg(F.min("id").alias("first"), F.max("id").alias("final")).filter("first < final").drop("final"))
    return rows.join(met, "rank")


def longer(met: DataFrame, near: int, far: int) -> DataFrame:
    """The windows of one part's runs, ranked by pairs of their rank so far and the bytes by which each is longer."""
    each = met.withColumn("p", F.explode(F.sequence("lo", "hi"))).withColumn("extra", (F.col("anchor") - F.col("p") - near).cast("int"))
    left = F.substring("before", F.octet_length("before") - F.col("extra") + 1, F.col("extra"))
    right = F.substring("after", F.lit(1), (far - near - F.col("extra")).cast("int"))
    place = F.unhex(F.lpad(F.hex("extra"), 2, "0"))
    return each.select("id", "rid", "p", F.concat("rank", place, left, right).alias("rank"))


def _removed(length: int):
    def run(batches):
        import pyarrow as pa
        import zstandard

        open_up = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for data, spans in zip(batch.column(2), batch.column(3), strict=True):
                text = open_up(data.as_buffer().to_pybytes()) if data.is_valid and len(data.as_buffer()) else b""
                kept, gone, runs, end = [], 0, 0, 0
                if spans.is_valid and len(spans.values):
                    packed = np.sort(spans.values.to_numpy())
                    lo = packed >> 8
                    far = np.maximum.accumulate(lo + (packed & 255) + length)
                    heads = np.flatnonzero(np.concatenate(([True], lo[1:] > far[:-1])))
                    for a, b in zip(lo[heads].tolist(), far[np.concatenate((heads[1:], [len(lo)])) - 1].tolist(), strict=True):
                        kept.append(text[end:a])
                        gone, runs, end = gone + b - a, runs + 1, b
                kept.append(text[end:])
                for column, x in zip(out, (len(text), gone, runs, hashlib.sha256(b"".join(kept)).hexdigest()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _squeezed_texts(texts: DataFrame) -> DataFrame:
    return texts.select("id", "rid", "text").mapInArrow(_squeezed, "id long, rid long, data binary")


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, section: int = SECTION, chunk: int = CHUNK, slices: int = SLICES) -> DataFrame:
    """texts: id, rid, text (binary). id, rid, lo, hi: windows of length bytes that start at lo to hi are
    repeated."""
    parts = Thinner(length, gram).parts()
    settled = F.shiftright("place", _KIND).isin(REPEATED, DOUBT)
    dealt = lambda rows: rows.repartition(F.when(settled, F.xxhash64("id", "rid", "place")).otherwise(F.shiftright("gram", 16)))
    thinned = lambda mine: dealt(texts.select("rid", "id", "text").mapInArrow(_thin(length, gram, section, chunk, slices, mine), _ROWS)).sortWithinPartitions("gram", "stretch", "id", "rid", "place")
    runs = []
    for mine in range(slices):
        runs.append(cut(thinned(mine).mapInArrow(_met, _SPANS)))
        release(texts.sparkSession)
    runs = reduce(DataFrame.unionByName, runs)
    doubt = lambda: runs.filter(F.col("kind") == DOUBT).groupBy("id", "rid").agg(F.collect_list("run").alias("runs"))
    cores = cut(_squeezed_texts(texts).join(doubt(), ["id", "rid"]).select("id", "rid", "data", "runs").mapInArrow(_cores(length, parts), _CORES))
    release(texts.sparkSession)
    lo = F.shiftright("run", 16)
    found = [runs.filter(F.col("kind") == REPEATED).select("id", "rid", lo.alias("lo"), (lo + F.shiftright("run", 8).bitwiseAND(255)).alias("hi"))]
    for part, (near, far) in enumerate(parts):
        windows = cut(longer(with_rivals(cores.filter(F.col("part") == part)), near, far))
        last = with_rivals(windows).filter("id > first")
        found.append(cut(last.select("id", "rid", F.col("p").alias("lo"), F.col("p").alias("hi"))))
        del last
        release(texts.sparkSession)
    return reduce(DataFrame.unionByName, found)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, **how: int) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256. A row is told by its id and a
    hash of its text, whose last bit says that the id is null; its spans are collected beside it, at most as many as it has windows."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).bitwiseAND(-2).bitwiseOR(F.col(id_col).isNull().cast("long")).alias("rid"), text.alias("text"))
    spans = repeated_spans(rows, length, gram, **how).groupBy("id", "rid").agg(F.collect_list(F.shiftleft("lo", 8).bitwiseOR(F.col("hi") - F.col("lo"))).alias("spans"))
    joined = _squeezed_texts(rows).join(spans, ["id", "rid"], "left").select("rid", F.when(F.col("rid").bitwiseAND(1) == 0, F.col("id")).alias("doc_id"), "data", "spans")
    return joined.mapInArrow(_removed(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
