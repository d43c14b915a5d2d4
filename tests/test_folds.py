"""Folds, thinning, ranks and percentiles over ranges, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import folds, ranges, thinning, throttle


def stream_rows(n, seed, hot=0.6, span=10_000):
    """(s, t, id, v): one stream has most of the rows; streams may be null; times tie."""
    r = random.Random(seed)
    names = ["b", "c", "d", None]
    return [("a" if r.random() < hot else r.choice(names), r.randint(0, span), i, r.choice([-1, 1]) * r.random() ** 3 * 50) for i in range(n)]


SCHEMA = "s string, t long, id long, v double"


def by_stream(rows):
    out = {}
    for x in sorted(rows, key=lambda x: x[1:3]):
        out.setdefault(x[0], []).append(x)
    return out


@pytest.mark.parametrize(("least", "parts"), [(1, 7), (40, 16), (900, 16), (10**6, 5), (0, 4)])
def test_throttle_and_republish_equal_a_loop(spark, least, parts):
    rows = stream_rows(1500, least)
    want = set()
    for some in by_stream(rows).values():
        last = None
        for x in some:
            if last is None or x[1] - last >= least:
                want.add(x[2])
                last = x[1]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {x.id for x in throttle.throttled(df, "s", "t", least, ["id"], parts).collect()} == want
    out = throttle.republished(df, "s", "t", least, ["id"], parts=parts).collect()
    assert len(out) == len(rows) and {x.id for x in out if x.emits} == want


@pytest.mark.parametrize(("entries", "ran"), [(4096, 0), (3, 11)])
def test_throttle_of_one_regular_stream_takes_many_tasks_and_no_rounds(spark, entries, ran):
    """Evenly spaced rows keep whatever phase they begin with, so no range can guess."""
    n = 6000
    df = spark.range(n).select(F.lit("a").alias("s"), (F.col("id") * 7 + F.col("id") % 5).alias("t"), "id")
    at = ranges.ranged(df, ["s"], ["t", "id"], 12)
    sizes = [x["count"] for x in at.groupBy(ranges.PART).count().collect()]
    assert len(sizes) == 12 and max(sizes) < n / 6
    incoming, runs = throttle.starts(at, "s", "t", 100, entries)
    assert len(incoming) == 11 and runs == ran
    last, want = None, []
    for i in range(n):
        if last is None or i * 7 + i % 5 - last >= 100:
            last = i * 7 + i % 5
            want.append(i)
    assert sorted(x.id for x in throttle.throttled(df, "s", "t", 100, ["id"], 12).collect()) == want


def test_a_fold_that_never_forgets_still_equals_its_loop(spark):
    """Every seventh row of a stream, by counting: the state depends on all rows before."""

    def seventh(_, state, rows):
        before = state or 0
        return before + rows.num_rows, (before + np.arange(rows.num_rows)) % 7 == 0

    rows = stream_rows(400, 3)
    want = {x[2] for some in by_stream(rows).values() for i, x in enumerate(some) if i % 7 == 0}
    got = folds.kept(spark.createDataFrame(rows, SCHEMA), "s", ["t", "id"], seventh, parts=6)
    assert {x.id for x in got.filter("kept").collect()} == want


def running_mean(key, state, rows):
    """A mean over all rows so far, and the gap to the row before: one never forgets, the other needs one row."""
    n, total, last = state or (0, 0.0, None)
    values, times = rows.column("v").to_numpy(), rows.column("t").to_pylist()
    sums = total + np.cumsum(values)
    out = {"id": rows.column("id"), "mean": sums / (n + np.arange(1, len(values) + 1)), "gap": [b - a if a is not None else None for a, b in zip([last, *times[:-1]], times, strict=True)]}
    return (n + len(values), float(sums[-1]), times[-1]), out


@pytest.mark.parametrize("forgets", [False, True])
def test_a_fold_of_ones_own_equals_a_loop(spark, forgets):
    rows = stream_rows(500, 12)
    want = {}
    for some in by_stream(rows).values():
        total, last = 0.0, None
        for i, x in enumerate(some):
            total += x[3]
            want[x[2]] = (total / (i + 1), None if last is None else x[1] - last)
            last = x[1]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = folds.mapped(df, "s", ["t", "id"], running_mean, "id long, mean double, gap long", forgets, parts=5).collect()
    assert len(out) == len(rows)
    for x in out:
        assert math.isclose(x.mean, want[x.id][0], abs_tol=1e-9) and x.gap == want[x.id][1]


def test_times_may_be_null(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 6, 3), (None, None, 4)], "s string, t long, id long")
    assert {x.id for x in throttle.throttled(df, "s", "t", 3, ["id"], 2).collect()} == {2}
    assert throttle.throttled(df.limit(0), "s", "t", 3, ["id"], 2).collect() == []


def keep_within(points, limit):
    keep = [0]
    for i in range(1, len(points)):
        if max(abs(a - b) for a, b in zip(points[keep[-1]], points[i], strict=True)) > limit:
            keep.append(i)
    return sorted(set(keep) | {len(points) - 1})


def to_budget(points, sizes, budget):
    if sum(sizes) <= budget:
        return list(range(len(points))), 0.0
    low, high = 0.0, 1e4
    for _ in range(30):
        middle = (low + high) / 2
        if sum(sizes[i] for i in keep_within(points, middle)) > budget:
            low = middle
        else:
            high = middle
    return keep_within(points, high), high


@pytest.mark.parametrize(("budget", "parts"), [(600, 9), (3000, 4), (10**6, 5)])
def test_thinning_equals_a_loop(spark, budget, parts):
    rows = [(*x, x[3] / 2 + x[1] % 13, 12 + 6 * (x[2] % 5)) for x in stream_rows(900, budget)]
    want = {}
    for some in by_stream(rows).values():
        keep, limit = to_budget([x[3:5] for x in some], [x[5] for x in some], budget)
        want |= {some[i][2]: limit for i in keep}
    df = spark.createDataFrame(rows, SCHEMA + ", w double, size int").repartition(3)
    out = thinning.thinned(df, "s", ["t", "id"], ["v", "w"], "size", budget, parts=parts)
    assert out.columns == [*df.columns, "limit"]
    assert {x.id: x.limit for x in out.collect()} == want


def test_thinning_of_streams_in_one_range(spark):
    rows = [("a" if i % 2 else "b", i, i, float(i % 17), 10) for i in range(200)]
    want = {}
    for some in by_stream(rows).values():
        keep, limit = to_budget([x[3:4] for x in some], [x[4] for x in some], 300)
        want |= {some[i][2]: limit for i in keep}
    out = thinning.thinned(spark.createDataFrame(rows, SCHEMA + ", size int"), "s", ["t", "id"], ["v"], "size", 300, parts=1)
    assert {x.id: x.limit for x in out.collect()} == want
    odd = spark.createDataFrame([("a", 1, 1, None, 5), ("a", 2, 2, float("nan"), 5), ("a", 3, 3, 1.0, 5)], SCHEMA + ", size int")
    assert [(x.id, x.limit) for x in thinning.thinned(odd, "s", ["t", "id"], ["v"], "size", 300, parts=2).collect()] == [(3, 0.0)]
    assert thinning.thinned(odd.limit(0), "s", ["t", "id"], ["v"], "size", 300, parts=2).collect() == []


@pytest.mark.parametrize("budget", [60, 900, 4000])
def test_thinning_takes_as_many_passes_whatever_the_ranges(spark, monkeypatch, budget):
    """Limits that values seldom leave do not forget where a fold began; the ranges are not taken one after the other for that."""
    r = random.Random(5)
    rows = [("a", i, i, r.lognormvariate(3, 1), r.randrange(12, 50)) for i in range(3000)]
    keep, limit = to_budget([x[3:4] for x in rows], [x[4] for x in rows], budget)
    sweeps, swept = [], folds.swept
    monkeypatch.setattr(folds, "swept", lambda *x: sweeps.append(x) or swept(*x))
    monkeypatch.setattr(thinning, "BLOCK", 16)
    out = thinning.thinned(spark.createDataFrame(rows, SCHEMA + ", size int"), "s", ["t", "id"], ["v"], "size", budget, parts=24)
    assert {x.id: x.limit for x in out.collect()} == {rows[i][2]: limit for i in keep}
    assert not sweeps


def test_thinning_where_every_row_exceeds_all_before_it(spark):
    rows = [("a", i, i, i * 0.75, 10) for i in range(1500)]
    keep, limit = to_budget([x[3:4] for x in rows], [x[4] for x in rows], 700)
    out = thinning.thinned(spark.createDataFrame(rows, SCHEMA + ", size int"), "s", ["t", "id"], ["v"], "size", 700, parts=3)
    assert {x.id: x.limit for x in out.collect()} == {rows[i][2]: limit for i in keep}


@pytest.mark.parametrize("within", [0, 3, 50, 100_000])
def test_suppression_equals_a_loop(spark, within):
    rows = [(s, t, i, float(round(v))) for s, t, i, v in stream_rows(500, 4, span=3000)]
    want = set()
    for some in by_stream(rows).values():
        picked = []
        for x in sorted(some, key=lambda x: (-x[3], x[1], x[2])):
            if all(abs(x[1] - p[1]) > within for p in picked):
                picked.append(x)
        want |= {x[2] for x in picked}
    out, rounds = thinning.suppressed(spark.createDataFrame(rows, SCHEMA), "s", "t", "v", ["id"], within)
    assert {x.id for x in out.collect()} == want
    assert 1 <= rounds < 30


def test_suppression_of_nothing(spark):
    out, rounds = thinning.suppressed(spark.createDataFrame([("a", None, 1, 1.0), ("a", 1, 2, None)], SCHEMA), "s", "t", "v", ["id"], 5)
    assert out.collect() == [] and rounds == 0


def test_places(spark):
    rows = stream_rows(700, 8)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = ranges.placed(df, ["s"], ["t", "id"], rank="i", total="n", before={"past": "v", "past_t": "t"}, after={"next": "id"}, parts=9)
    assert out.columns == [*df.columns, "i", "n", "past", "past_t", "next"]
    got = {x.id: (x.i, x.n, x.past, x.past_t, x.next) for x in out.collect()}
    want = {}
    for some in by_stream(rows).values():
        for i, x in enumerate(some):
            past, after = some[i - 1] if i else None, some[i + 1] if i + 1 < len(some) else None
            want[x[2]] = (i, len(some), past and past[3], past and past[1], after and after[2])
    assert got == want


@pytest.mark.parametrize("kind", ["double", "long"])
def test_percentiles(spark, kind, monkeypatch):
    monkeypatch.setattr(ranges, "CELLS", 5)
    r = random.Random(6)
    odd = [0, 0, 0, 5, -5, 2**60, 2**60 + 1, -(2**62)] if kind == "long" else [0.0, -0.0, 1e300, -1e300, 5e-324, 1.0, 1.0 + 2**-52, float("inf")]
    rows = [("abc"[i % 3] if i % 10 else None, (r.randint(-50, 50) if kind == "long" else r.random() ** 9) if i > 60 else r.choice(odd)) for i in range(400)]
    rows += [("a", None), ("only null", None), ("one", 3 if kind == "long" else 3.0)]
    if kind == "double":
        rows = [x for x in rows if x[1] != float("inf")] + [("a", float("nan"))]
    df = spark.createDataFrame(rows, f"s string, x {kind}")
    asked = {"p50": ranges.nearest_rank(0.5), "p99": ranges.nearest_rank(0.99), "p95": ranges.floor_rank(0.95), "past": F.col("n"), "least": F.lit(0)}
    got = {x.s: x[1:] for x in ranges.at_ranks(df, ["s"], "x", asked).select("s", *asked).collect()}
    want = {}
    for s in {x[0] for x in rows}:
        v = sorted(x[1] for x in rows if x[0] == s and x[1] is not None and x[1] == x[1])
        if v:
            n = len(v)
            want[s] = (v[math.ceil(0.5 * n) - 1], v[math.ceil(0.99 * n) - 1], v[min(n - 1, math.floor(0.95 * n))], None, v[0])
    assert got == want
