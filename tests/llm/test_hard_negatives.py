"""Hard negatives (operator 13) against brute force with whole numbers, and the tree's bounds against all rows."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from folioscope.llm import hard_negatives, queries
from folioscope.llm.common import Workspace
from pyspark.sql import functions as F

from tests.llm.conftest import DATA, frame

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100):
    part = []
    for vec_id, e, label in rows:
        if vec_id is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        part.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in e]))
    far = 1 << 62
    score = lambda a, b: max(-far, min(far, sum(max(-far, min(far, x)) * max(-far, min(far, y)) for x, y in zip(a, b, strict=False))))
    out = []
    for k, (anchor, label, e) in enumerate(part):
        if anchor % every:
            continue
        own = sorted((-score(e, f), i, lab == label) for j, (i, lab, f) in enumerate(part) if j != k)
        for s, i, _ in [x for x in own if x[2]][:5]:
            fits = [(-t, j) for t, j, same in own if not same and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(anchor, i, rank, j, -s, t) for rank, (t, j) in enumerate(fits, 1)]
    return sorted(out)


def found(spark, rows, every=100, schema=ROWS):
    own = frame(spark, rows, schema).withColumns({c: F.lit("x") for c in ("v", "vec", "bucket", "leaf", "windows", "rank", "w")})
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(own, F.col("vec_id") % every == 0).collect())


def vectors(n, size=16, labels=4, seed=1, spread=0.35):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(labels * 3, size))
    x = centres[r.integers(0, len(centres), n)] + spread * r.normal(size=(n, size))
    return [(int(k), [float(np.float32(c)) for c in v / np.linalg.norm(v)], int(r.integers(0, labels))) for k, v in zip(r.permutation(3 * n)[:n], x, strict=True)]


@pytest.fixture
def small(monkeypatch):
    """Leaves and buckets so small that few rows make many."""
    for name, x in (("LEAF", 16), ("BUCKET", 48), ("SAMPLE", 400), ("SLICE", 7)):
        monkeypatch.setattr(hard_negatives, name, x)


def test_equals_brute_force(spark, small):
    rows = vectors(900)
    assert found(spark, rows, 20) == brute(rows, 20) != []


def test_awkward_rows(spark, small):
    r = random.Random(2)
    rows = vectors(300, size=8, seed=4)
    same = [float(np.float32(x)) for x in (0.3, -0.1, 0.5, 0.2, 0.1, 0.4, -0.2, 0.6)]
    rows += [(10_000 + k, same, k % 3) for k in range(250)]  # copies in a third of all rows, ties everywhere
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1], 1)]  # repeated rows, a repeated id
    rows += [(20_000, None, 1), (20_100, [], 2), (20_200, [0.5] * 8, None), (None, [0.5] * 8, 1), (20_300, [float("nan")] * 8, 1), (20_400, [float("inf"), 1.0], 1), (20_500, [None, 1.0], 1)]
    rows += [(20_600, [0.0] * 8, 1), (20_700, [-x for x in same], 1), (20_800, [0.9, 0.9], 2), (20_900, [r.random() for _ in range(12)], -7), (-100, same, -7)]
    assert found(spark, rows, 20) == brute(rows, 20)


def test_numbers_of_any_size(spark, small):
    r = random.Random(3)
    big = [(k, [r.choice([1e3, 1e12, 1e19, 3e38, 0.01]) * r.uniform(-1, 1) for _ in range(3)], k % 2) for k in range(120)]
    assert found(spark, big, 10) == brute(big, 10) != []
    middle = [(k, [r.uniform(-4e5, 4e5) for _ in range(5)], k % 2) for k in range(120)]
    assert found(spark, middle, 10) == brute(middle, 10) != []


def test_few_rows_and_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 1)]) == []
    assert found(spark, [(1, [1.0], 1), (2, [0.5], 2)]) == []
    few = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (3, [0.95, 0.0], 2)]
    assert found(spark, few) == brute(few) == [(0, 1, 1, 2, 65536, 32768)]
    assert found(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == [(0, 1, 1, 2, 0, 0)]


def test_bounds_hold_and_leaves_are_skipped(spark, small, monkeypatch):
    """Every score lies within its leaf's limits; of clustered rows most buckets are never visited."""
    rows = vectors(2000, size=6, labels=3, seed=9, spread=0.05)
    ws = Workspace(spark, "test")
    own = ws.keep(hard_negatives.taking_part(frame(spark, rows, ROWS)), "rows")
    shape, n = hard_negatives._shape(own)
    index = hard_negatives.build(ws.keep(hard_negatives._pack(own, shape), "packed"), shape, n, ws)
    placed = index.rows.toPandas()
    x = np.stack([np.frombuffer(v, shape.packed) for v in placed.v]).astype(np.int64)
    q = x[placed.vec_id % 50 == 0]
    low, high = index.tree.value.limits(q, shape)
    s = q @ x.T
    leaf = placed.leaf.to_numpy()
    assert (low[:, leaf] <= s).all() and (s <= high[:, leaf]).all()
    assert index.buckets == placed.bucket.nunique() and placed.groupby("bucket").size().max() <= 2 * hard_negatives.BUCKET
    anchors = ws.keep(hard_negatives._pack(own.where("vec_id % 50 = 0"), shape), "anchors").withColumn("windows", F.array(F.struct(F.lit(-hard_negatives.FAR).alias("lo"), F.lit(hard_negatives.FAR).alias("hi"))))
    hard_negatives.nearest(anchors, index, True, 5, ws, "p")
    visited = sum(spark.read.parquet(ws.path(f"p-visits{k}")).count() for k in (1, 2))
    assert visited < 0.5 * len(q) * index.buckets


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_equals_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet')")
    want = sorted(duckdb.sql(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({hard_negatives.SQL})").fetchall())
    assert sorted(tuple(r) for r in queries.op13_hard_negatives(spark, str(DATA)).collect()) == want != []
