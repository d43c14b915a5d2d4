import math
import random

import duckdb
import numpy as np
import pytest

from tracewell.llm import hard_negatives as H
from tracewell.llm import queries

SCHEMA = "vec_id long, embedding array<double>, label int, score int, q string"


def plainly(rows, positives=5, negatives=10, scale=256):
    """rows: (vec_id, vector, label)."""
    good = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        it = (label, [math.floor(x * scale) for x in v])
        good[i] = min(good.get(i, it), it)
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731  the shorter counts as 0 beyond its end
    for a, (label, v) in good.items():
        if a % 100:
            continue
        scored = sorted((-dot(v, w), i) for i, (_, w) in good.items() if i != a)
        for s, p in [(-s, i) for s, i in scored if good[i][0] == label][:positives]:
            found = [(-t, i) for t, i in scored if good[i][0] != label and 30 * s <= -100 * t <= 90 * s][:negatives]
            out += [(a, p, k + 1, i, s, t) for k, (t, i) in enumerate(found)]
    return sorted(out)


def mined(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in H.hard_negatives(df, **options).collect())


def vectors(n, dim, seed, labels=4, spread=1.0):
    r = np.random.default_rng(seed)
    return [(i, (r.standard_normal(dim) * spread + 0.5).tolist(), int(r.integers(labels))) for i in range(n)]


@pytest.mark.parametrize(("n", "dim", "labels", "spread"), [(700, 8, 4, 0.2), (500, 16, 1, 1.0), (600, 3, 300, 1.0), (400, 1, 3, 0.01), (101, 64, 2, 0.1)])
def test_equals_brute_force(spark, n, dim, labels, spread):
    rows = vectors(n, dim, n, labels, spread)
    got = mined(spark, rows)
    assert got == plainly(rows)
    assert got or labels == 1


def test_small_pages_and_rounds(spark, monkeypatch):
    rows = vectors(900, 6, 3)
    want = plainly(rows)
    monkeypatch.setattr(H, "ROUND_BYTES", 150)
    assert mined(spark, rows) == want
    monkeypatch.setattr(H, "ROUND_BYTES", 8 << 20)
    for name, size in (("ROWS", 17), ("TABLE_BYTES", 1), ("SAMPLE", 5)):
        monkeypatch.setattr(H, name, size)
    cells = H.Cells(np.array([[1, 5], [3, 5]]), np.array([-9, -9]), np.array([9, 9]))
    q = np.array([[x, y] for x in range(-9, 10) for y in range(-9, 10)])
    low, high = H.bounds(cells.of(q), cells.tables(np.array([[2, -3], [0, 4]])))
    score = q @ np.array([[2, -3], [0, 4]]).T
    assert (low <= score).all() and (score <= high).all()


def test_ties_copies_and_odd_rows(spark):
    r = random.Random(5)
    rows = [(i, [float(r.randint(0, 2)), float(r.randint(0, 2))], r.randint(0, 2)) for i in range(300)]
    rows += [(None, [1.0, 1.0], 1), (900, None, 1), (901, [1.0, None], 1), (902, [float("nan"), 1.0], 1), (903, [float("inf"), 1.0], 1), (904, [1.0, 1.0], None)]
    rows += [(100, [9.0, 9.0], 2), rows[200], rows[200], (-100, [1.0, 2.0], 1), (1000, [1.0], 0), (1100, [], 0), (1200, [1.0, 1.0, 5.0], 2), (1300, [-1.0, -1.0], 1)]
    assert mined(spark, rows) == plainly(rows)
    for k in (1, 3):
        assert mined(spark, rows, positives=k, negatives=k) == plainly(rows, k, k)


def test_one_label_of_a_third_and_copies(spark):
    rows = [(i, v, 7 if i % 3 == 0 else label) for i, v, label in vectors(600, 4, 9)]
    rows += [(1000 + i, [0.25, 0.5, 0.75, 1.0], 1) for i in range(300)]
    assert mined(spark, rows) == plainly(rows)


def test_bounds_leave_few_rows():
    r = np.random.default_rng(1)
    q = np.floor(256 * r.standard_normal((4000, 64)) / 8).astype(np.int64)
    cells = H.Cells(q[:1000], q.min(0), q.max(0))
    anchors = q[:20]
    low, high = H.bounds(cells.of(q), cells.tables(anchors))
    score = q @ anchors.T
    assert (low <= score).all() and (score <= high).all()
    left = high >= H.kth(low, 5)
    assert left.sum(0).max() < 80  # of 4000


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [], 0)]) == []
    assert mined(spark, [(0, [], 1), (100, [], 1), (3, [], 2)]) == [(0, 100, 1, 3, 0, 0), (100, 0, 1, 3, 0, 0)]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(queries.ORACLE_SQL["op11_hard_negatives"])
    got = queries.op11_hard_negatives(spark, sf)
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows and rows == sorted(want.fetchall())
