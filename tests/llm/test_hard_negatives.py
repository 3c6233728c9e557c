"""Hard negatives against a plain form: ties, repeats, nulls, odd lengths, many passes, several chunks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm.hard_negatives import hard_negatives

LAST = 1 << 62  # stands for a null id in the plain form


def plain(rows, per_anchor=5, per_positive=3, low=50, high=95):
    whole = [(LAST if i is None else i, g, [math.floor(256 * x) for x in v]) for i, g, v in rows if g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (a, g, v) in enumerate(whole):
        if a == LAST or a % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, u)), i, h) for m, (i, h, u) in enumerate(whole) if m != n]
        for s, p, _ in sorted(x for x in scored if x[2] == g)[:per_anchor]:
            fits = sorted(x for x in scored if x[2] != g and low * -s <= 100 * -x[0] <= high * -s)[:per_positive]
            out += [(a, p, k, x[1], -s, -x[0]) for k, x in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    table = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "vec_id long, label int, embedding array<float>, row string, rank int, score double")
    got = hard_negatives(table, F.col("vec_id") % 50 == 0, **more)
    return sorted(tuple(LAST if x is None else x for x in r) for r in got.collect())


def vectors(n, seed, dim=4, labels=3):
    r = random.Random(seed)
    return [(k, r.randrange(labels), [r.choice([-0.5, 0.25, 0.5, 1.0, r.uniform(-1, 1)]) for _ in range(dim)]) for k in range(n)]


@pytest.mark.parametrize("bits, chunk", [(16, 8 << 20), (7, 200)])
def test_against_plain_form(spark, bits, chunk):
    rows = vectors(400, 1)
    rows += [(1000 + k, 1, rows[50][2]) for k in range(60)] + [(2000 + k, 2, [x * 0.75 for x in rows[50][2]]) for k in range(60)]  # groups of copies, as positives and as negatives
    rows += [(2000, 2, rows[50][2]), (100, 0, rows[100][2]), (100, 0, rows[100][2]), (None, 1, rows[50][2]), (None, 2, [x * 0.75 for x in rows[50][2]])]  # repeated and null ids
    rows += [(3000, None, rows[0][2]), (3001, 1, None), (3002, 1, [1.0, None, 1.0, 1.0]), (3050, 1, [float("nan")] * 4), (3100, 1, [float("inf")] * 4)]
    rows += [(3150, 1, [0.5, 0.5]), (3151, 2, [0.5, 0.25]), (3200, 1, [])]
    want = plain(rows)
    got = mined(spark, rows, digit_bits=bits, chunk_bytes=chunk)
    assert len(want) > 60 and got == want


def test_large_components(spark):
    rows = [(k, k % 2, [float(np.float32(x * 1e6)) for x in v]) for k, _, v in vectors(120, 2)]
    assert mined(spark, rows) == plain(rows)  # beyond exact doubles
    with pytest.raises(ValueError, match="64-bit"):
        mined(spark, [(0, 1, [1e9] * 4), (1, 1, [1e9] * 4)])


def test_nothing_to_mine(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0])]) == []  # no anchor
    assert mined(spark, [(50, 1, [1.0]), (51, 2, [1.0])]) == []  # no positive
    assert mined(spark, [(50, 1, [1.0]), (51, 1, [-1.0]), (52, 2, [-0.75])]) == []  # a negative positive score leaves no window
    assert mined(spark, [(50, 1, [1.0]), (51, 1, [0.0]), (52, 2, [0.0])]) == [(50, 51, 1, 52, 0, 0)]
