import math
import random

import pytest
from pyspark.sql import functions as F

from curvecal.llm import hard_negatives

SCHEMA = "id bigint, label int, vector array<bigint>"


def plain(rows, anchors, positives=5, negatives=10, low=30, high=90, den=100):
    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    anchors = {i: (i, lab, v) for i, lab, v in sorted(((r[0], r[1], r[2]) for r in anchors if r in rows), reverse=True)}
    out = []
    for a, label, vector in anchors.values():
        ranked = sorted((-score(vector, v), i, lab) for i, lab, v in rows if i != a)
        for p, positive in [(-s, i) for s, i, lab in ranked if lab == label][:positives]:
            inside = [(-s, i) for s, i, lab in ranked if lab != label and low * p <= den * -s <= high * p][:negatives]
            out += [(a, positive, k, i, p, s) for k, (s, i) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, asked, **how):
    table = spark.createDataFrame(rows, SCHEMA)
    got = hard_negatives.mine(table, table.where(asked), **how).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("block,ranks,round_size", [(8192, 16, 16_384), (37, 1, 5)])
def test_equals_brute_force(spark, monkeypatch, block, ranks, round_size):
    for name, value in (("BLOCK", block), ("RANKS", ranks), ("ROUND", round_size)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(3)
    rows = [(i, rng.randrange(4), [rng.randrange(-9, 10) for _ in range(5)]) for i in range(700)]
    want = plain(rows, [r for r in rows if r[0] % 20 == 0])
    assert len(want) > 500 and mined(spark, rows, "id % 20 = 0") == want


def test_stops_before_all_rows_are_met():
    import numpy as np

    vectors = np.arange(1, 4001, dtype=np.int64)[:, None] * [[1, 2]]
    block = hard_negatives.Block(np.arange(4000), np.zeros(4000, int), vectors, 2)
    best, met = hard_negatives.Best(1, 1, 3), []
    offer = best.offer
    best.offer = lambda a, ids, *rest: (met.extend(ids), offer(a, ids, *rest))
    block.search(np.array([1, 1]), np.ones(4000, bool), best, 0, [hard_negatives.NONE + 1], [1 << 40])
    assert best.ids[0, 0].tolist() == [3999, 3998, 3997] and len(met) < 100


def test_nulls_ties_zeros_repeats_and_large_numbers(spark):
    rows = [(i, i % 2, [1, -1]) for i in range(40)] + [(100, 0, [0, 0]), (120, 1, [3, 0]), (140, 7, [1, 1])]
    rows += [(160, None, [1, 1]), (180, 0, None), (200, 0, [1, None]), (None, 0, [1, 1]), (41, 1, []), (42, 0, [5])]
    rows += [(220, 0, [1 << 29, 3]), (221, 0, [1 << 30, 1]), (222, 1, [1 << 28, 7])]
    rows += [(20, 0, [1, -1])]
    assert mined(spark, rows, "id % 20 = 0") == plain(
        rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0])


def test_scaled_components(spark):
    nan, inf = math.nan, math.inf
    df = spark.createDataFrame([(0, [0.1, -0.1]), (1, [nan]), (2, [inf]), (3, [-inf, 1.0]), (4, [None, 1.0]), (5, None), (6, [])],
                               "i int, v array<float>").select("i", hard_negatives.scaled("v", 256).alias("w"))
    assert {r.i: r.w for r in df.collect()} == {0: [25, -26], 1: None, 2: None, 3: None, 4: None, 5: None, 6: []}


def test_no_rows_and_clashing_names(spark):
    assert mined(spark, [], "id % 2 = 0") == []
    rows = [(1, 0, [1]), (2, 0, [2]), (3, 1, [1])]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("window", "score", "rank", "anchor_id")})
    assert [tuple(r)[1:4] for r in hard_negatives.mine(table, table.where("id = 2")).select(
        "anchor_id", "positive_id", "rank", "negative_id").collect()] == []
    assert [tuple(r) for r in hard_negatives.mine(table, table.where("id = 2"), high=100).select(
        "anchor_id", "positive_id", "rank", "negative_id").collect()] == [(2, 1, 1, 3)]
