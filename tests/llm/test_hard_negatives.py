"""Hard negatives against all products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import hard_negatives as H

ROWS = "vec_id bigint, embedding array<float>, label int, bucket int, number string, block boolean"


def slow_negatives(rows, is_anchor, label):
    kept = []
    for at, (vec_id, vector, own) in enumerate(rows):
        if vec_id is None or vector is None or own is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in vector]
        kept.append((at, vec_id, label(vec_id, own), whole))
    out = []
    for at, vec_id, own, vector in kept:
        if not is_anchor(vec_id):
            continue
        others = [(-sum(a * b for a, b in zip(vector, w, strict=True)), i, k, lab)
                  for k, i, lab, w in kept if i != vec_id and len(w) == len(vector)]
        ranked = sorted((s, i, tuple(kept_vector(kept, k)), lab) for s, i, k, lab in others)
        for score, positive, _, _ in [r for r in ranked if r[3] == own][:5]:
            fit = [r for r in ranked if r[3] != own and 50 * -score <= 100 * -r[0] <= 95 * -score][:3]
            out += [(vec_id, positive, rank, r[1], -score, -r[0]) for rank, r in enumerate(fit, 1)]
    return sorted(out)


def kept_vector(kept, k):
    return next(w for at, _, _, w in kept if at == k)


def vectors(seed, n=160):
    draw = random.Random(seed)
    centers = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for vec_id in draw.sample(range(1000), n):
        center = draw.choice(centers)
        size = draw.choice([0.2, 1, 1, 5])
        rows.append((vec_id, [size * (x + draw.gauss(0, 0.4)) for x in center], draw.randrange(5)))
    rows += [(1005 + k, [0.0] * 6, draw.randrange(5)) for k in range(20)]
    rows += [(2000 + k, [1.0] + [0.0] * 5, k % 3) for k in range(9)]  # ties
    rows += [rows[3], rows[3], rows[10]]  # repeated rows
    rows += [(3000, [1.0, 2.0], 1), (3010, [1.0, 2.5], 1), (3001, [1.0, 1.9], 2), (3002, [], 1), (3005, [], 2)]
    rows += [(None, [1.0] * 6, 1), (3100, None, 1), (3110, [1.0] * 6, None), (3120, [None] + [1.0] * 5, 1),
             (3130, [math.nan] * 6, 2), (3140, [math.inf] * 6, 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", True) for r in rows], ROWS)


@pytest.mark.parametrize(("seed", "bucket", "block"), [(1, 8192, 2048), (2, 16, 7), (3, 5, 3)])
def test_matches_all_products(spark, seed, bucket, block):
    rows = vectors(seed)
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    found = H.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0, label, bucket=bucket, block=block)
    expected = slow_negatives(rows, lambda i: i % 5 == 0, lambda i, x: (x + 1) % 10 if i % 7 == 0 else x)
    assert expected
    assert sorted(tuple(r) for r in found.collect()) == expected


def test_great_components(spark):
    rows = [(5, [1e12, 3.0], 1), (6, [9e11, 1.0], 1), (7, [5e11, 2.0], 2), (10, [1e30, 1.0], 3), (11, [1e30, 2.0], 3)]
    found = H.hard_negatives(frame(spark, rows), F.col("vec_id") == 5).collect()
    assert {(r.positive_id, r.negative_id) for r in found} <= {(6, 7)}


def test_candidates_hold_all_that_reach_the_threshold():
    draw = np.random.default_rng(4)
    vectors = np.floor(draw.normal(0, 100, (500, 8)) * draw.choice([0.3, 1, 2], (500, 1)))
    bucket = H.Bucket(np.arange(500), np.arange(500), np.zeros(500, np.int64), vectors)
    pruned = 0
    for query in vectors[:60]:
        scores = vectors @ query
        for threshold in (1.0, *np.quantile(scores, [0.5, 0.9, 0.99, 1.0])):
            kept = bucket.candidates(query, float(threshold))
            assert set(np.flatnonzero(scores >= threshold)) <= set(kept.tolist()) or threshold <= 0
            pruned += len(kept) < 400
    assert pruned


def test_no_rows_and_no_anchors(spark):
    assert H.hard_negatives(frame(spark, []), F.col("vec_id") % 5 == 0).collect() == []
    assert H.hard_negatives(frame(spark, [(1, [1.0], 1)]), F.col("vec_id") % 5 == 0).collect() == []
