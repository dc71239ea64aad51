"""Best-fit packing of token sequences.

Tasks turn texts into token ids. Pieces are ranked by length (a distributed sort with bucketed prefix counts). Pieces of
one length are alike, and so are sequences with one gap, so a superstep of the sweep matches a whole length with the
smallest gaps that hold it, and conflicts are settled by rank: the r-th piece goes to the r-th gap. What the sweep
needs of the corpus is the count for each length, 1,024 numbers at most; it gives back intervals of ranks, which the
pieces look up. The result is that of best-fit decreasing.

Defined cases: a null or empty text is the end token alone; rows that repeat are packed one by one; an empty table
gives no pieces; an added token's string in a text (here <|endoftext|>) is that token, as in the library by default;
very long texts are encoded whole and cut into pieces of full length but for the first; pieces of one length go by a hash
of their document, number and ids, then by these; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked

CAPACITY, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Chunks whose ids a worker keeps, and the longest such chunk.
CACHE, CACHE_CHARS = 400_000, 64
_APART = re.compile(r"(?<=\S) (?=\S)")
_WHITE_RUN = re.compile(r"\s\s")


def default_tokenizer() -> str:
    """The ranks of byte_bpe_50k.json: the same vocabulary and ids, in the form that is encoded fastest."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(path: str) -> dict[str, int]:
    """Tokens that texts are split at before all else: those of the library's file, or of the one beside a rank file."""
    beside = path if path.endswith(".json") else f"{path.removesuffix('.tiktoken')}.json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file).get("added_tokens", [])}


def encode_all(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids of texts with no tokens put around them, by the library that reads the file."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    added = added_tokens(path)
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda texts: [encoding.encode(t, allowed_special="all") if any(a in t for a in added) else encoding.encode_ordinary(t) for t in texts]


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes. The byte-level pre-tokenizer never joins
    characters across a single space between two others, the space going with what follows; so texts are cut there,
    and the ids of short chunks are remembered. Texts that hold an added token are not cut."""

    def __init__(self, path: str):
        self.encode_all, self.added = encode_all(path), tuple(added_tokens(path))
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        chunks = [[t] if any(a in t for a in self.added) else _APART.split(t) if _WHITE_RUN.search(t) else t.split(" ") for t in texts]
        heads = [array("I", x).tobytes() for x in self.encode_all([c[0] for c in chunks])]
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        new = list({c for cs in chunks for c in cs[1:] if c not in known})
        long = []
        for c, ids in zip(new, self.encode_all([" " + c for c in new]), strict=True):
            known[c] = array("I", ids).tobytes()
            if len(c) > CACHE_CHARS:
                long.append(c)
        for head, cs in zip(heads, chunks, strict=True):
            yield head + b"".join(map(known.__getitem__, cs[1:]))
        for c in long:
            del known[c]


_ENCODERS: dict[str, Encoder] = {}


def tokenised(path: str, capacity: int = CAPACITY, end_id: int = END_ID):
    """For mapInArrow: doc_id, text to pieces."""

    def run(batches):
        import pyarrow as pa

        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder, end = _ENCODERS[path], end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[list] = [[], [], [], [], []]
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    ids = memoryview(ids + end)
                    n = len(ids) // 4
                    start, stop = 0, (n - 1) % capacity + 1 if n > capacity else n
                    piece = 0
                    while start < n:
                        for column, x in zip(out, (doc_id, piece, start, stop - start, zlib.crc32(ids[start * 4 : stop * 4])), strict=True):
                            column.append(x)
                        start, stop, piece = stop, stop + capacity, piece + 1
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over runs of like pieces and like gaps: (length, first rank, ranks, first sequence, offset),
    the r-th of which goes to the r-th sequence."""
    runs: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []  # sorted, those with runs
    placed, opened = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                bisect.insort(gaps, gap)
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = gap // length
            full = min(n, left // each)
            for k in range(each if full else 0):
                placed.append((length, rank, full, first, capacity - gap + k * length))
                rank += full
            left -= full * each
            add(gap - each * length, first, full)
            first, n = first + full, n - full
            if left and n:  # fewer than fill one more
                for k in range(left):
                    placed.append((length, rank + k, 1, first, capacity - gap + k * length))
                rank += left
                add(gap - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            add(gap, first, n)
    return placed


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = spark.createDataFrame(sweep(counts, capacity) or [(0, 0, 0, 0, 0)], "length long, rank0 long, n long, sequence0 long, offset long")
    spread = F.shiftright(F.xxhash64("doc_id", "piece", "ids_crc32"), 33) + (1 << 30)
    order = ranked(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], spread, F.lit(0), sum(counts.values()))
    joined = order.join(F.broadcast(plan), "length").filter("rank >= rank0 and rank < rank0 + n")
    return joined.select(*pieces.columns, (F.col("sequence0") + F.col("rank") - F.col("rank0")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = cut(texts.mapInArrow(tokenised(tokenizer or default_tokenizer(), capacity, end_id), PIECES))
    return placed(pieces, capacity)
