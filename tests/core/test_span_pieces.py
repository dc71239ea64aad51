"""Pieces of long spans hold the samples that lie in them, counted one by one."""

from __future__ import annotations

import random

import pytest

from sightline.operators import spans


@pytest.mark.parametrize(("longest", "frames", "pad"), [(10.0, 800, 1.0), (3.0, 2000, 0.0), (0.0, 500, 1.0), (60.0, 300, 2.0), (1.0, 120, 1.0)])
def test_samples_of_pieces(spark, longest, frames, pad):
    r = random.Random(6)
    rows = []
    for k in range(8):
        t = r.choice([0.0, 3.0])
        for _ in range(r.randint(1, 120)):
            rows.append((k, t))
            t += r.choice([0.2, 0.5, 1.0, 1.0, 2.0, 5.0])
    found = spans.spans(spark.createDataFrame(rows, "k int, time_s double"), ["k"], 5.0, frames, 2.0, pad, 0.5, longest).collect()
    assert found
    for piece in found:
        times = sorted(t for k, t in rows if k == piece.k)
        runs = [[times[0]]]
        for a, b in zip(times, times[1:], strict=False):
            runs.append([b]) if b - a > 2.0 else runs[-1].append(b)
        held = [t for t in runs[piece.span_no] if piece.start_s - 1e-9 <= t <= piece.end_s + 1e-9]
        assert piece.n_samples == len(held), piece
