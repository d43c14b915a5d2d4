"""Rigid alignment, wall angle and chains of poses against known answers and plain code."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import chains, spatial


def turn(axis, angle):
    x, y, z = np.array(axis) / np.linalg.norm(axis) * math.sin(angle / 2)
    return np.array([x, y, z, math.cos(angle / 2)])


def matrix(q):
    x, y, z, w = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


@pytest.mark.parametrize("angle", [0.0, 1e-3, 0.7, 2.5, math.pi - 1e-3, math.pi])
def test_alignment_recovers_a_known_turn(spark, angle):
    r = np.random.default_rng(1)
    rows, want = [], {}
    for g in range(4):
        q, t, s = turn(r.standard_normal(3), angle), r.standard_normal(3) * 5, r.standard_normal((30, 3)) * 3 + 2
        target = s @ matrix(q).T + t
        rows += [(g, *map(float, a), *map(float, b)) for a, b in zip(s, target, strict=True)]
        want[g] = (q, t)
    df = spark.createDataFrame([*rows, (0, None, 1.0, 1.0, 1.0, 1.0, 1.0)], "g int, a double, b double, c double, d double, e double, f double").repartition(3)
    out = spatial.aligned(df, ["g"], ("a", "b", "c"), ("d", "e", "f")).collect()
    assert {x.g for x in out} == set(want)
    for x in out:
        q, t = want[x.g]
        assert x.n == 30 and x.rmse < 1e-6 and x.qw >= 0
        assert np.allclose(matrix([x.qx, x.qy, x.qz, x.qw]), matrix(q), atol=1e-6) and np.allclose([x.x, x.y, x.z], t, atol=1e-5)


def test_alignment_of_noise_has_the_least_error(spark):
    r = np.random.default_rng(2)
    s, target = r.standard_normal((40, 3)), r.standard_normal((40, 3))
    df = spark.createDataFrame([tuple(map(float, (*a, *b))) for a, b in zip(s, target, strict=True)], "a double, b double, c double, d double, e double, f double")
    x = spatial.aligned(df, [], ("a", "b", "c"), ("d", "e", "f")).first()
    error = lambda q, t: math.sqrt(((s @ matrix(q).T + t - target) ** 2).sum(1).mean())
    best = error([x.qx, x.qy, x.qz, x.qw], np.array([x.x, x.y, x.z]))
    assert abs(best - x.rmse) < 1e-9
    for _ in range(300):
        q = turn(r.standard_normal(3), r.uniform(0, math.pi))
        assert error(q, target.mean(0) - matrix(q) @ s.mean(0)) >= best - 1e-9


def test_alignment_of_one_point_and_none(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 2.0, 2.0, 2.0)], "a double, b double, c double, d double, e double, f double")
    x = spatial.aligned(df, [], ("a", "b", "c"), ("d", "e", "f")).first()
    assert (x.n, x.x, x.y, x.z, x.qw) == (1, 1.0, 0.0, -1.0, 1.0)
    grouped = df.withColumn("g", F.lit(1)).limit(0)
    assert spatial.aligned(grouped, ["g"], ("a", "b", "c"), ("d", "e", "f")).collect() == []


@pytest.mark.parametrize("degrees", [0.0, 7.3, 23.4, 44.9, 89.6])
def test_wall_angle_to_a_tenth(spark, degrees):
    r = random.Random(3)
    a = math.radians(degrees)
    walls = [(r.uniform(0, 12), w) for w in (0.0, 3.02, 7.4) for _ in range(300)] + [(w, r.uniform(0, 7)) for w in (0.03, 6.0, 12.0) for _ in range(200)]
    rows = [(u * math.cos(a) - v * math.sin(a), u * math.sin(a) + v * math.cos(a)) for u, v in walls]
    df = spark.createDataFrame([*rows, (None, 1.0)], "x double, y double").repartition(3)
    for cell in (None, 0.01):
        off = abs(spatial.wall_turn(df, cell=cell).first().degrees - degrees) % 90
        assert min(off, 90 - off) < 0.15
    assert spatial.wall_turn(df.limit(0)).collect() == []


POSE = "x double, y double, z double, qx double, qy double, qz double, qw double"


def compose(a, b):
    (p, q), (r, s) = a, b
    x1, y1, z1, w1 = q
    x2, y2, z2, w2 = s
    mixed = np.array([w1 * x2 + x1 * w2 + y1 * z2 - z1 * y2, w1 * y2 - x1 * z2 + y1 * w2 + z1 * x2, w1 * z2 + x1 * y2 - y1 * x2 + z1 * w2, w1 * w2 - x1 * x2 - y1 * y2 - z1 * z2])
    return p + matrix(q) @ r, mixed / np.linalg.norm(mixed)


def random_pose(r):
    return r.standard_normal(3), turn(r.standard_normal(3), r.uniform(0, 3))


def numbers(p):
    return [float(v) for v in (*p[0], *p[1])]


def same(row, p):
    got = [row[c] for c in chains.POSE]
    return np.allclose(got[:3], p[0], atol=1e-6) and np.allclose(matrix(got[3:]), matrix(p[1]), atol=1e-6)


def test_a_chain_of_300_frames(spark):
    r = np.random.default_rng(5)
    steps = [random_pose(r) for _ in range(300)]
    edges = [("k", i, i + 1, *numbers(p)) for i, p in enumerate(steps)] + [("k", 1000, 1001, *numbers(steps[0])), ("k", 1001, 1000, *numbers(steps[0])), ("k", 1002, 1000, *numbers(steps[0]))]
    out = {x.frame: x for x in chains.to_roots(spark.createDataFrame(edges, "k string, child long, parent long, " + POSE), ["k"]).collect()}
    at = (np.zeros(3), np.array([0, 0, 0, 1.0]))
    for i in reversed(range(300)):
        at = compose(at, steps[i])
        assert (out[i].root, out[i].depth) == (300, 300 - i) and same(out[i], at)
    assert all(out[i].root is None and out[i].x is None for i in (1000, 1001, 1002))


def test_chains_at_a_time(spark):
    """Edges between samples, before the first, after the last, and where the parent changes."""
    r = np.random.default_rng(6)
    p = [random_pose(r) for _ in range(7)]
    edges = [("a", 1, 2, 10, *numbers(p[0])), ("a", 1, 2, 20, *numbers(p[1])), ("a", 1, 3, 30, *numbers(p[2])), ("a", 2, 9, 0, *numbers(p[3])), ("a", 3, 8, 5, *numbers(p[4])), ("b", 1, 2, 10, *numbers(p[5]))]
    probes = [("a", 1, 1, 0), ("a", 2, 1, 10), ("a", 3, 1, 24), ("a", 4, 1, 25), ("a", 5, 1, 26), ("a", 6, 1, 99), ("a", 7, 2, 7), ("a", 8, 9, 7), ("b", 9, 1, 15), ("c", 10, 1, 15)]
    out = {x.probe: x for x in chains.chains_at(spark.createDataFrame(probes, "rec string, probe long, frame long, ts long"), spark.createDataFrame(edges, "rec string, child long, parent long, ts long, " + POSE), "rec", "probe", "frame").collect()}
    one = (np.zeros(3), np.array([0, 0, 0, 1.0]))
    want = {1: (9, compose(p[3], p[0])), 2: (9, compose(p[3], p[0])), 3: (9, compose(p[3], p[1])), 4: (9, compose(p[3], p[1])), 5: (8, compose(p[4], p[2])), 6: (8, compose(p[4], p[2])), 7: (9, p[3]), 8: (9, one), 9: (2, p[5]), 10: (1, one)}
    assert set(out) == set(want)
    for i, (root, pose) in want.items():
        assert out[i].root == root and same(out[i], pose), i


def test_mounts(spark):
    r = np.random.default_rng(7)
    p = [random_pose(r) for _ in range(6)]
    move = (p[2][0] + np.array([0, 2e-9, 0]), p[2][1])
    edges = [("a", "lidar", "mast", 1, *numbers(p[0])), ("a", "lidar", "mast", 9, *numbers(p[0])), ("a", "mast", "base", 2, *numbers(p[1])), ("a", "base", "odom", 1, *numbers(p[2])), ("a", "base", "odom", 2, *numbers(p[3]))]
    edges += [("b", "lidar", "mast", 1, *numbers(p[2])), ("b", "lidar", "mast", 2, *numbers(move)), ("b", "mast", "base", 2, *numbers(p[1]))]
    edges += [("c", "lidar", "mast", 1, *numbers(p[0])), ("c", "mast", "base", 2, *numbers(p[1])), ("c", "mast", "odom", 2, *numbers(p[1]))]
    edges += [("d", "lidar", "mast", 1, *numbers(p[0])), ("d", "mast", "lidar", 2, *numbers(p[1])), ("d", "base", "odom", 2, *numbers(p[1]))]
    edges += [("e", "lidar", "odom", 1, *numbers(p[0])), ("e", "base", "odom", 2, *numbers(p[1]))]
    walks = [(k, "lidar", "base") for k in "abcdef"] + [("a", "base", "base"), ("a", "mast", "odom")]
    out = {(x.rec, x.start): x for x in chains.mounts(spark.createDataFrame(edges, "rec string, child string, parent string, ts long, " + POSE), spark.createDataFrame(walks, "rec string, start string, goal string"), "rec").collect()}
    assert {k: x.verdict for k, x in out.items()} == {
        ("a", "lidar"): "fixed", ("b", "lidar"): "moves", ("c", "lidar"): "two parents", ("d", "lidar"): "cycle", ("e", "lidar"): "not under", ("f", "lidar"): "not under", ("a", "base"): "fixed", ("a", "mast"): "moves",
    }
    assert same(out["a", "lidar"], compose(p[1], p[0])) and out["a", "lidar"].depth == 2 and out["a", "base"].depth == 0 and out["b", "lidar"].x is None


def test_small_trees_climb_in_a_row(spark, monkeypatch):
    """As by doubling, cycles and frames of no tree too, and without a round of joins."""
    r = random.Random(11)
    edges = []
    for rec in "abc":
        for child in range(1, 13):
            for t in range(0, 100, 20):
                h = r.random()
                edges.append((rec, child, r.randrange(0, 13) if rec == "c" else r.randrange(0, child), t, r.random(), r.random(), r.random(), 0.0, 0.0, math.sin(h), math.cos(h)))
    probes = [(rec, i, r.randrange(0, 15), r.randrange(-5, 110)) for i, rec in enumerate("abcd" * 30)]
    e, p = spark.createDataFrame(edges, "rec string, child long, parent long, ts long, " + POSE), spark.createDataFrame(probes, "rec string, probe long, frame long, ts long")
    near = lambda x: tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in x)
    rounds, settled = [], chains.settled
    monkeypatch.setattr(chains, "settled", lambda x: rounds.append(1) or settled(x))
    out = sorted(map(near, chains.chains_at(p, e, "rec", "probe", "frame").collect()), key=repr)
    assert not rounds
    monkeypatch.setattr(chains, "SMALL_TREE", 0)
    assert out == sorted(map(near, chains.chains_at(p, e, "rec", "probe", "frame").collect()), key=repr) and rounds
    assert len(out) == 120 and any(x[3] is None for x in out) and any(x[4] and x[4] > 2 for x in out)
