"""Parts of repeated passages against plain loops: anchors in blocks and slices, order of entries, ranks of runs in doubt."""

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from xxhash import xxh3_128_digest

from sightline.llm import suffix_dedup

WORDS = ["ab", "abc", "la", "x", "xxxxxxxx", "é", "of the", "passage"]


def some_texts(rng, n, longest):
    return [" ".join(rng.choice(WORDS, int(rng.integers(0, longest)))).encode() for _ in range(n)]


def laid(texts):
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = lengths.cumsum()
    return np.frombuffer(b"".join(texts), np.uint8), ends - lengths, ends


def test_anchors_of_a_slice_are_its_part_of_all_runs():
    """Runs cover every window once, by an anchor that depends on the window's bytes alone; slices split them."""
    rng = np.random.default_rng(31)
    for _ in range(20):
        texts = some_texts(rng, 8, 60)
        thinner = suffix_dedup.Thinner()
        found = thinner.anchors(*laid(texts))
        offsets, covered = {}, []
        for d, lo, span, off in zip(*(found[k].tolist() for k in ("doc", "lo", "span", "off")), strict=True):
            for p in range(lo, lo + span + 1):
                covered.append((d, p))
                assert 0 <= lo + off - p < thinner.width
                offsets.setdefault(texts[d][p : p + 50], set()).add(lo + off - p)
        assert sorted(covered) == [(d, p) for d, t in enumerate(texts) for p in range(len(t) - 49)]
        assert all(len(x) == 1 for x in offsets.values())
        stretches = {}
        for d, lo, span, h, c in zip(*(found[k].tolist() for k in ("doc", "lo", "span", "h", "c")), strict=True):
            stretches.setdefault((h, c), set()).add(texts[d][lo : lo + span + 50])
        assert all(len(x) == 1 for x in stretches.values()) and len({b for x in stretches.values() for b in x}) == len(stretches)
        parts = [thinner.anchors(*laid(texts), 3, mine) for mine in range(3)]
        rows = lambda f: list(zip(*(f[k].tolist() for k in f), strict=True))
        assert sorted(r for f in parts for r in rows(f)) == sorted(rows(found))
    short = thinner.anchors(*laid([b"x" * 49, b"", b"y" * 20]), 3, 1)
    assert all(len(x) == 0 for x in short.values())
    with pytest.raises(ValueError):
        thinner.anchors(np.zeros((1 << 24) + 1, np.uint8), np.array([0]), np.array([(1 << 24) + 1]))


def test_entries_are_the_same_however_texts_meet(monkeypatch):
    rng = np.random.default_rng(32)
    texts = some_texts(rng, 60, 200)
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(range(60)), pa.array(texts, pa.binary())], names=["rid", "id", "text"])
    rows = lambda mine, slices: sorted(tuple(r.values()) for b in suffix_dedup._thin(50, 20, 1 << 18, 1 << 22, slices, mine)([batch]) for r in b.to_pylist())
    want = rows(0, 1)
    assert len(want) > 500
    for at_once in (1, 100, 5000):
        monkeypatch.setattr(suffix_dedup, "AT_ONCE", at_once)
        assert rows(0, 1) == want and sorted(rows(0, 2) + rows(1, 2)) == want


def test_order_is_that_of_all_columns():
    rng = np.random.default_rng(33)
    for n in (0, 1, 2, 300):
        rows = [rng.integers(-9, 9, n) for _ in range(5)]
        got = suffix_dedup._order(rows)
        assert sorted(got.tolist()) == list(range(n))
        assert [tuple(x[i] for x in rows) for i in got] == sorted(zip(*(x.tolist() for x in rows), strict=True))


@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_ranks_of_runs_do_not_depend_on_batches(size):
    rng = np.random.default_rng(34)
    parts = suffix_dedup.Thinner().parts()
    rows, want = [], set()
    for n, text in enumerate(some_texts(rng, 40, 80)):
        packed = []
        for _ in range(int(rng.integers(0, 5)) if len(text) > 90 else 0):
            lo = int(rng.integers(0, len(text) - 85))
            off = int(rng.integers(0, 31))
            span = int(rng.integers(max(0, off - 30), off + 1))
            packed.append(lo << 16 | span << 8 | off)
            for part, (near, far) in enumerate(parts):
                mine = [p for p in range(lo, lo + span + 1) if near <= lo + off - p <= far]
                if mine:
                    a, b = lo + off - near, lo + off - far + 50
                    want.add((n // 2, n, lo + off, mine[0], mine[-1], part, xxh3_128_digest(text[a:b]) + bytes([part]), text[max(0, a - far + near) : a], text[b : b + far - near]))
        rows += [(n // 2, n, zstandard.compress(text), packed)] * (1 + n % 3)  # rows that repeat count once
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["id", "rid", "data", "runs"])
    got = [tuple(r.values()) for b in suffix_dedup._cores(50, parts)([whole.slice(k, size) for k in range(0, len(rows), size)]) for r in b.to_pylist()]
    assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want
