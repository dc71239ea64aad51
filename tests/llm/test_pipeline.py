"""The pipeline, stage by stage, against brute force over a whole small table."""

import re
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from sightline.llm import common, language_id, packing

from .test_dedup_mix_pack import WORD, best_fit_decreasing, components, fp, water

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, seen = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.cut(stage(spark, docs, SF_DIR))
        seen.append((name, before.collect(), docs.collect()))
        assert name == "best_fit_packing" or docs.columns == before.columns
    assert [s[0] for s in seen] == ["language_id", "exact_dedup", "simhash_near_dedup", "source_mix", "best_fit_packing"]

    _, rows, kept = seen[0]
    judged = {r.doc_id: r for r in language_id.language_id(spark.read.parquet(f"{SF_DIR}/documents.parquet")).collect()}
    fine = lambda r: judged[r.doc_id].lang_pred != "und" and judged[r.doc_id].score >= language_id.REJECT_BELOW
    assert sorted(map(str, kept)) == sorted(str(r) for r in rows if fine(r)) and len(kept) > 0.8 * len(rows)

    _, rows, kept = seen[1]
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id, str(r)))
    assert sorted(map(str, kept)) == sorted(min(g)[2] for g in groups.values())

    _, rows, kept = seen[2]
    of = components({fp(r.text) for r in rows})
    least = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        least.setdefault(of[fp(r.text)], str(r))
    assert sorted(map(str, kept)) == sorted(least.values())

    _, rows, kept = seen[3]
    sizes, taken, original = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
        original[r.doc_id] = r
    times = Counter()
    for r in kept:
        words, own = WORD.findall(r.text), original[r.doc_id]
        taken[r.source] += len(words)
        times[r.doc_id] += 1
        assert r.text == own.text or words == WORD.findall(own.text)[: len(words)]
    want = water(sizes, (5, 2, 1))
    assert max(times.values()) <= 3 and all(abs(taken[s] - want[s]) <= 1 for s in want)

    _, rows, pieces = seen[4]
    encode = packing.encode_all(packing.default_tokenizer().replace(".tiktoken", ".json"))
    lengths = Counter()
    for r in rows:
        lengths[r.doc_id] += len(encode([r.text])[0]) + 1
    packed, filled = Counter(), defaultdict(list)
    for p in pieces:
        packed[p.doc_id] += p.length
        filled[p.sequence_id].append((p.offset, p.length))
    assert packed == lengths and len(filled) == best_fit_decreasing([p.length for p in pieces], packing.CAPACITY)
    for parts in filled.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= packing.CAPACITY
    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    tally = lambda x: sorted((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in x)
    assert tally(whole) == tally(pieces)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, SF_DIR))
        assert docs.count() == 0


def test_columns_named_like_helpers_come_through(spark):
    """Helper columns of the stages, given by the user: their values come out as they went in."""
    named = ["sightline_row", "Sightline_Row_", "sightline_lang", "sightline_score", "mix_row_", "mix_words_", "mix_slot_", "mix_size_", "row_id", "epoch", "slot", "keep_row", "lang_pred", "score", "rank", "size"]
    text = "the quick brown fox and the lazy dog are in the house of the old man by the sea"
    rows = [(k, f"{text} {'again ' * k}{k}", "en" if k % 4 else None, f"s{k % 2}", *(100 * k + i for i in range(len(named)))) for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} long" for n in named))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, SF_DIR))
        kept = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", *named] and kept
        assert all(r[n] == 100 * r.doc_id + i for r in kept for i, n in enumerate(named))
