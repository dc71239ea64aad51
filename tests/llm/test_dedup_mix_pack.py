"""Exact dedup, mixing, SimHash and packing against brute force, and the defined odd cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from sightline.llm import exact_dedup, mixing, packing, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "clash") for i, t, s in rows], DOCS)


ODD = [(1, "a b", "x"), (2, "a  b\n", "x"), (3, None, None), (4, "", "x"), (4, "", "x"), (5, " \t", ""), (6, "a b ", "y"), (None, "ab   ", "y"), (7, "é" * 3000, "z")]


def test_exact_dedup_keeps_longest_then_smallest(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark, ODD)).collect()}
    assert (2, 2, 4, True) in got and (None, 2, 4, False) in got and (6, 2, 4, False) in got  # five code points, the null id last
    assert (3, 5, 4, False) in got and (5, 5, 4, True) in got
    assert (7, 7, 1, True) in got


def test_exact_dedup_of_repeated_rows_keeps_one(spark):
    docs = frame(spark, [(1, "same text", "x")] * 5 + [(2, "other", "x")])
    assert sorted(r.doc_id for r in exact_dedup.keep_one(docs).collect()) == [1, 2]
    assert exact_dedup.keep_one(docs).columns == docs.columns


def test_exact_dedup_verifies_bytes(spark):
    docs = frame(spark, [(1, "a", "x"), (2, "b", "x"), (3, "b", "x")])
    index = exact_dedup.compact(exact_dedup.flush_runs(docs))
    assert exact_dedup.unequal(docs, index).count() == 0
    clash = index.filter("group_size > 1").selectExpr("unhex(sha2('a', 256)) as digest", "keep", "group_size")
    both = frame(spark, [(3, "a", "x"), (2, "a", "x")])
    assert exact_dedup.unequal(both, clash).count() == 0


def test_exact_dedup_where_digests_clash(spark, monkeypatch):
    """A digest of four bits: many texts share one, and only their bytes tell them apart."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(16)
    rows = [(i, f"text {int(rng.integers(60))}" + " " * int(rng.integers(3)), "x") for i in range(400)] + ODD
    monkeypatch.setattr(exact_dedup, "digest", lambda norm: F.unhex(F.substring(F.sha2(F.encode(norm, "UTF-8"), 256), 1, 1)))
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 7)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = sorted((str(i), str(min(g)[3]), len(g)) for g in groups.values() for *_, i in g)
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


@pytest.mark.parametrize("operator", [exact_dedup.exact_dedup, simhash.simhash, mixing.taken_words, packing.pack])
def test_empty_table(spark, operator):
    assert operator(frame(spark, [])).count() == 0


def water(sizes, weights):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, weight = total - sum(fixed.values()), sum(w[s] for s in free)
        target = {s: rest * w[s] / weight for s in free} | fixed
        over = [s for s in free if target[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return target
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mix_reaches_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))) if i % 17 else None, [None, "a", "b", "c", "d"][int(rng.integers(0, 5)) if i % 3 else 1]) for i in range(600)]
    got = mixing.taken_words(frame(spark, rows)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    of = {i: s for i, _, s in rows}
    want = water(sizes, (5, 2, 1))
    for r in got:
        assert r.taken <= 3 * r.size and abs(r.target - want[of[r.doc_id]]) < 1e-4 and r.source_size == sizes[of[r.doc_id]]
        taken[of[r.doc_id]] += r.taken
    assert len(got) == 600 and all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.taken_words(frame(spark, rows[::-1]).repartition(7)).collect()))


def test_mixed_documents_hold_the_taken_words(spark):
    rows = [(i, f"word{i} " * (i % 9), "abc"[i % 3] if i % 5 else None) for i in range(90)]
    docs = frame(spark, rows)
    taken = {r.doc_id: r.taken for r in mixing.taken_words(docs).collect()}
    words = Counter()
    out = mixing.mixed(docs)
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert out.columns == docs.columns and {i: n for i, n in taken.items() if n} == dict(words)


def test_schedule_interleaves_sources(spark):
    docs = frame(spark, [(i, "w " * 40, "ab"[i % 2]) for i in range(200)])
    m = mixing.mix(mixing.with_row_id(docs), block_words=8)
    slots = m.pieces.join(m.rows, "row_id").select("slot", "skey").distinct().orderBy("slot").collect()
    longest = max(len(x) for x in re.findall(r"a+|b+", "".join(r.skey[1] for r in slots[: len(slots) // 2])))
    assert longest <= 6  # never long stretches of one source


def test_slots_come_from_the_sequence(spark, monkeypatch):
    docs = frame(spark, [(i, "w " * (i % 50), "ab"[i % 2] if i % 7 else None) for i in range(200)])
    golden = {r.doc_id: r for r in mixing.taken_words(docs).collect()}
    monkeypatch.setattr(mixing, "GOLDEN", 1)  # points in order: one source after another
    plain = {r.doc_id: r for r in mixing.taken_words(docs).collect()}
    assert all(r.taken == plain[i].taken and (r.first_slot is None) == (r.taken == 0) and r.n_slots >= (r.taken > 0) for i, r in golden.items())
    assert sum(r.first_slot != plain[i].first_slot for i, r in golden.items()) > 100
    monkeypatch.undo()
    m = mixing.mix(mixing.with_row_id(docs))
    slots = m.pieces.join(m.rows, "row_id").groupBy("skey").agg({"slot": "count"}).collect()
    for r in slots:  # any prefix of the schedule holds the sources near their shares
        mine = [x.slot for x in m.pieces.join(m.rows, "row_id").filter(f"skey = '{r.skey}'").select("slot").distinct().orderBy("slot").collect()]
        last = mine[-1]
        for k in (len(mine) // 4, len(mine) // 2):
            assert abs(mine[k] / last - k / len(mine)) < 0.1


def test_clashing_names_and_long_texts_in_stages(spark):
    rows = [(1, "long words here " * 60_000, "a"), (2, "b " * 5, "a"), (3, "b  " * 5, None), (4, None, "b")] + [(10 + i, f"w{i} x y z " * 20, "ab"[i % 2]) for i in range(20)]
    docs = frame(spark, rows)
    for name in ("epoch", "slot", "row_id", "rank", "length", "piece", "fp", "words", "start", "digest_", "norm", "points", "size", "skey", "bucket_", "n_", "stay_", "id", "component", "mix_words"):
        docs = docs.selectExpr("*", f"'clash' as {name}")
    for stage in (exact_dedup.keep_one, simhash.keep_one, mixing.mixed):
        out = stage(docs)
        assert out.columns == docs.columns and out.count() and stage(docs.limit(0)).count() == 0
        assert {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}.get(2, "b " * 5).startswith("b")
    assert packing.pack(docs).filter("doc_id = 1").count() > 100 and simhash.simhash(docs).count() == mixing.taken_words(docs).count() == len(rows)


def fp(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in [None, "", "A", "a É", "x y z", "The Cat sat on the mat the cat SAT", "a b c\x1cd e", "w " * 5000]:
        assert simhash.fingerprint(text) == fp(text)


def components(prints):
    label = {p: p for p in prints}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    distinct = sorted(prints)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                label[root(a)] = root(b)
    return {p: root(p) for p in distinct}


def test_simhash_components(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(list("abcdefghijklmnop"), 60)) for _ in range(12)]
    rows = [(i, base[i % 12] if i % 4 else base[i % 12] + " extra" * (i % 3), "s") for i in range(150)] + ODD
    got = simhash.simhash(frame(spark, rows)).collect()
    prints = {r.fp & (1 << 64) - 1 for r in got}
    of = components(prints)
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[of[fp(t)]] = min(i, least.get(of[fp(t)], i))
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == least.get(of[r.fp & (1 << 64) - 1])  # null where the group has null ids alone
    assert simhash.keep_one(frame(spark, rows)).count() == len(set(of.values()))


@pytest.mark.parametrize("tile", [8, 40])
def test_near_links_over_small_tiles(spark, tile):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = {int(c) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for c in centres for _ in range(40)} | {0, 1, 3, 7, 15, (1 << 64) - 1}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), tile=tile)
    from sightline.llm.common import components as connected

    got = {r.node & (1 << 64) - 1: r.component for r in connected(links).collect()}
    want = defaultdict(set)
    for p, root in components(prints).items():
        want[root].add(p)
    groups = defaultdict(set)
    for p, c in got.items():
        groups[c].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_components_with_a_centre_of_most_links(spark):
    from sightline.llm.common import components as connected

    links = [(1_000, i) for i in range(2_000, 3_000)] + [(i, i + 1) for i in range(10, 300)] + [(10, 2_500), (5_000, 5_001)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: 5_000 if n >= 5_000 else 10 for link in links for n in link}


def test_tokens_equal_the_tokenizers_library(spark):
    import public_tokenizers

    plain = packing.encode_all(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["  a  b ", " a", "a ", "\n\n x\t y", "it's 's  'S don't", "", "\xa0 x \x85y", "a\x1c b", "\x00a b", "日本 語　テスト  ", "<|endoftext|> x", "x" * 300 + " " + "y" * 100, "Don't stop, 3.5% ok?"]
    encoder = packing.Encoder(packing.default_tokenizer())
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(odd)] == plain(odd)


def test_tokens_of_all_documents_equal_the_library(spark):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    for t, ids in zip(texts, packing.Encoder(packing.default_tokenizer()).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_added_tokens_are_those_of_the_library_by_default(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    odd = [f"a {end} b", end, f"{end}{end}", f"a  {end}\n b", f"x{end}y", f" {end}  z  ", f"<|{end}|>", "<|endoftext", f"long words here {end} " * 700, "no token"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in odd]
    assert want[0] == [64, 220, 50256, 275]
    encoder = packing.Encoder(packing.default_tokenizer())
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(odd)] == want
    got = packing.pack(frame(spark, [(i, t, "s") for i, t in enumerate(odd)])).collect()
    first = {r.doc_id: (r.length, r.ids_crc32) for r in got if r.piece == 0}
    for i, ids in enumerate(want):
        ids = np.array([*ids, 2], "<u4")
        n = (len(ids) - 1) % 1024 + 1
        assert first[i] == (n, zlib.crc32(ids[:n].tobytes()))
        assert sum(r.length for r in got if r.doc_id == i) == len(ids)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_sweep_is_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for _ in range(40):
        capacity = int(rng.integers(1, 60))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 200))).tolist()
        filled, used = defaultdict(list), Counter()
        for length, rank, n, first, offset in packing.sweep(Counter(lengths), capacity):
            assert rank == used[length]
            used[length] += n
            for k in range(n):
                filled[first + k].append((offset, length))
        assert used == Counter(lengths) and len(filled) == best_fit_decreasing(lengths, capacity)
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity


def test_pack(spark):
    import public_tokenizers

    plain = packing.encode_all(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*ODD, (8, "long words here " * 900, "s"), (9, "exact", "s"), *[(100 + i, "tok " * (i * 7), "s") for i in range(60)]]
    got = packing.pack(frame(spark, rows)).collect()
    pieces = sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    want = []
    for i, t, _ in rows:
        ids = np.array([*plain([t or ""])[0], 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(-1 if i is None else i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert pieces == sorted(want)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(filled) == best_fit_decreasing([p[3] for p in pieces], 1024)


def test_sha256_is_of_the_normalised_text(spark):
    got = exact_dedup.exact_dedup(frame(spark, [(1, "a  b\n", "x")])).first()
    assert got.text_sha256 == hashlib.sha256("a b".encode()).hexdigest()
