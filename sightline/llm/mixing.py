"""Mixes sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled by a hash of their id and read as one endless stream of words, cut into blocks of
equal length. Slots are numbered from 0; the golden-ratio point of a slot falls into the cumulative target shares and
names the slot's source; the slot's rank among its source's slots names the block. Slots past a source's target are
empty, and what the points leave of a target (a few blocks) is added as slots at the end, so each source gives
floor(target) words. The schedule is thus an order of all words of the mix in which any stretch holds the sources near
their shares: taken_words returns each document's first slot, and mixed writes its rows sorted by it.

Blocks hold BLOCK_WORDS words, fewer where the corpus would then have fewer than SLOTS blocks (a smaller corpus needs
shorter blocks to interleave as finely); nothing else depends on the corpus's size.

Defined cases: a null text has no words and is never taken; a null source is a source, the last in order; an empty
table, or one without words, gives targets of zero; rows that repeat count one by one; of a very long document each
block is a slot of its own; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, heavy_join, held, ranked, spare

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK_WORDS = 4096
#: Where the corpus has fewer words than so many whole blocks, blocks are shorter.
SLOTS = 1 << 17
#: The golden ratio's fraction on a lattice of 2**30 points, rounded to an odd number.
LATTICE, GOLDEN = 1 << 30, 663608941


@dataclass
class Mix:
    rows: DataFrame  # row_id, doc_id, skey, size
    sources: DataFrame  # skey, source_size, target
    pieces: DataFrame  # slot, row_id, epoch, start (word in the document), words
    n_rows: int


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """skey, n_docs, source_size, target: by weight, stopped at repeats times the size, the excess reshared by weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumns({"rn": F.row_number().over(order), "w": weight, "cap": repeats * F.col("source_size")})
    by = by.withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    filling = Window.orderBy("ratio", "rn")
    total = F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by = by.withColumn("level", (total - before).cast("double") / rest)
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rn", "level"))).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return by.select("skey", "rn", "n_docs", "source_size", F.least(F.col("w") * fits["level"], F.col("cap").cast("double")).alias("target"))


def _slots(sources: DataFrame, n_slots: int, block: int, n_sources: int, shares: int) -> DataFrame:
    """slot, skey, rank: which block of which source each slot takes."""
    spark = sources.sparkSession
    so_far = Window.orderBy("rn")
    edges = sources.withColumn("share", F.floor("target").cast("long"))
    edges = edges.select("skey", "rn", "share", F.ceil(F.col("share") / block).cast("long").alias("need"), F.sum("share").over(so_far).alias("high")).withColumn("low", F.col("high") - F.col("share"))
    # An equality on cells of the share axis carries the range test.
    cells = max(1 << 12, 1 << max(0, n_sources - 1).bit_length())
    cell = lambda x: F.floor(x.cast("double") / shares * cells).cast("int")
    ranges = edges.filter("share > 0").withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))))
    point = F.pmod(F.pmod(F.col("id"), F.lit(LATTICE)) * GOLDEN, F.lit(LATTICE))
    slots = spark.range(n_slots).withColumn("pos", F.floor(point.cast("double") / LATTICE * shares)).withColumn("cell", cell(F.col("pos")))
    dealt = slots.join(ranges, "cell").filter("pos >= low and pos < high").select(F.col("id").alias("slot"), "skey", "need")
    spread = F.floor(F.col("slot").cast("double") * ((1 << 31) / max(1, n_slots))).cast("long")
    dealt = ranked(dealt, ["skey"], ["slot"], spread, F.lit(0), n_slots)
    dealt = cut(dealt.select("slot", "skey", "rank", "need"))
    have = dealt.groupBy("skey").agg(F.count("*").alias("have"))
    missing = edges.join(have, "skey", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long"))).filter("have < need")
    missing = missing.withColumn("rank", F.explode(F.sequence(F.col("have"), F.col("need") - 1)))
    tail = missing.select((F.row_number().over(Window.orderBy("rank", "rn")) - 1 + n_slots).cast("long").alias("slot"), "skey", "rank")
    return dealt.filter("rank < need").select("slot", "skey", "rank").unionByName(tail)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, seed: str = "mix") -> Mix:
    """docs: row_id, doc_id, source, text."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    rows = cut(docs.select("row_id", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key.alias("skey"), size.alias("size")))
    sources = cut(targets(rows, weights, repeats))
    n_rows, n_sources, words, shares = sources.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.floor("target").cast("long")), F.lit(0))).first()
    block = max(1, min(block_words, words // SLOTS))
    slots = _slots(sources, -(-words // block), block, n_sources, max(1, shares))
    shuffled = F.shiftright(F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long"), 1)
    laid = ranked(rows.filter("size > 0").select("row_id", "doc_id", "skey", "size"), ["skey"], [F.col("doc_id").asc_nulls_last(), "size"], shuffled, F.col("size"), n_rows)
    laid = heavy_join(laid, sources.select("skey", "n_docs", "source_size", F.floor("target").cast("long").alias("goal")), "skey", F.col("n_docs"), n_rows)
    laid = laid.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("low", F.col("epoch") * F.col("source_size") + F.col("before"))
    laid = laid.withColumn("high", F.least(F.col("low") + F.col("size"), "goal")).filter("low < high")
    cuts = laid.withColumn("rank", F.explode(F.sequence(F.floor(F.col("low") / block).cast("long"), F.floor((F.col("high") - 1) / block).cast("long"))))
    first, last = F.greatest("low", F.col("rank") * block), F.least("high", (F.col("rank") + 1) * block)
    pieces = cuts.join(slots, ["skey", "rank"]).select("slot", "row_id", "epoch", (first - F.col("low")).alias("start"), (last - first).alias("words"))
    return Mix(rows, sources, pieces, n_rows)


def with_row_id(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row_id", F.monotonically_increasing_id())


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, first_slot (null if nothing is taken) and
    n_slots: of the schedule's slots, the first that takes words of it, and how many do."""
    m = mix(with_row_id(docs.select("doc_id", "source", "text")), **how)
    taken = m.pieces.groupBy("row_id").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    rows = heavy_join(m.rows.drop("source"), m.sources.select("skey", "n_docs", "source_size", "target"), "skey", F.col("n_docs"), m.n_rows)
    rows = rows.join(taken, "row_id", "left")
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix with the columns of docs: a row for each time a document is taken, the text cut after
    the words taken where a source ends. Rows are dealt evenly, and each partition is in the order of the schedule, so a
    reader of any of them meets the sources near their shares all along."""
    row, taken, slot, size = (spare(n, docs.columns) for n in ("mix_row_", "mix_words_", "mix_slot_", "mix_size_"))
    kept = held(docs.withColumn(row, F.monotonically_increasing_id()))
    m = mix(kept.select(F.col(row).alias("row_id"), "doc_id", "source", "text"), **how)
    times = m.pieces.groupBy("row_id", "epoch").agg(F.sum("words").alias(taken), F.min("slot").alias(slot)).join(m.rows.select("row_id", F.col("size").alias(size)), "row_id")
    times = times.select(F.col("row_id").alias(row), taken, slot, size)
    whole = F.col(taken) >= F.col(size)
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col(taken).cast("int")), " ")
    out = kept.join(times, row)
    # The length first: it looks at the text as it was.
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length(head)).cast(docs.schema["n_chars"].dataType))
    out = out.withColumn("text", F.when(whole, F.col("text")).otherwise(head))
    return out.sortWithinPartitions(slot).select(*docs.columns)
