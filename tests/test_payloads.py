"""Payloads packed here, field by field, and read back; a log decoded, profiled, changed and written again."""

import random
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracewell.operators import graph, mutations
from tracewell.sources import container, payloads


class Packer:
    """CDR by hand."""

    def __init__(self, order="<"):
        self.order, self.out = order, bytearray(b"\0\1\0\0" if order == "<" else b"\0\0\0\0")

    def put(self, kind, *values):
        size = struct.calcsize(self.order + kind)
        for v in values:
            self.out += bytes(-(len(self.out) - 4) % size) + struct.pack(self.order + kind, v)
        return self

    def text(self, s):
        data = s.encode() + b"\0"
        self.put("I", len(data)).out.extend(data)
        return self


def tf(edges, order="<"):
    p = Packer(order).put("I", len(edges))
    for stamp, parent, child, pose in edges:
        p.put("i", stamp // 10**9).put("I", stamp % 10**9).text(parent).text(child).put("d", *pose)
    return bytes(p.out)


def odom(stamp, pose, twist, order="<"):
    p = Packer(order).put("i", stamp // 10**9).put("I", stamp % 10**9).text("odom").text("base")
    return bytes(p.put("d", *pose).put("d", *range(36)).put("d", *twist).put("d", *range(36)).out)


def cloud(stamp, points, fields, step, order="<", big=False, height=1, pad=0):
    p = Packer(order).put("i", stamp // 10**9).put("I", stamp % 10**9).text("lidar").put("I", height, len(points) // height).put("I", len(fields))
    codes = {"f": (7, "f"), "d": (8, "d"), "H": (4, "H")}
    for name, offset, kind in fields:
        p.text(name).put("I", offset).put("B", codes[kind][0]).put("I", 1)
    data = bytearray()
    for r in range(height):
        for point in points[r * (len(points) // height) : (r + 1) * (len(points) // height)]:
            cell = bytearray(step)
            for value, (_, offset, kind) in zip(point, fields, strict=True):
                struct.pack_into((">" if big else "<") + kind, cell, offset, value)
            data += cell
        data += bytes(pad)
    p.put("B", int(big)).put("I", step, step * (len(points) // height) + pad).put("I", len(data)).out.extend(data)
    return bytes(p.put("B", 1).out)


SCHEMA = "topic string, log_ns long, data binary"


def pose(r):
    return [r.uniform(-5, 5) for _ in range(7)]


def framed(data):
    return pa.Codec("lz4").compress(data, asbytes=True)


def test_transforms(spark):
    r = random.Random(1)
    rows, want = [], []
    for i in range(60):
        edges = [(i * 10**9 + 5 + j, r.choice(["map", "odom", "長"]), f"c{j}", pose(r)) for j in range(i % 4)]
        data = tf(edges, "<" if i % 3 else ">")
        rows.append((f"/t{i % 2}", i, framed(data) if i % 5 == 0 else data))
        want += [(f"/t{i % 2}", i, j, *e[:3], *e[3]) for j, e in enumerate(edges)]
    rows += [("/t0", 100, b""), ("/t0", 101, None), ("/t0", 102, b"\7nothing like it"), ("/t0", 103, tf([(1, "a", "b", pose(r))])[:-9]), ("/t0", 104, b"\0\1\0\0" + struct.pack("<I", 2**31))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, payloads.transforms(df).collect())) == sorted(want)
    assert {x.topic: (x.n, x.bad) for x in payloads.told(df, payloads.TRANSFORMS).collect()} == {"/t0": (35, 5), "/t1": (30, 0)}


def test_odometry(spark):
    r = random.Random(2)
    rows = [("/o", i, i * 10**9 + 3, pose(r), pose(r)[:6]) for i in range(30)]
    df = spark.createDataFrame([(t, i, odom(s, p, w, "<" if i % 2 else ">")) for t, i, s, p, w in rows], SCHEMA).repartition(2)
    assert sorted(map(tuple, payloads.odometry(df).collect())) == sorted((t, i, s, "odom", "base", *p, *w) for t, i, s, p, w in rows)


def test_points(spark):
    f = lambda x: float(np.float32(x))
    xyz = [("x", 0, "f"), ("y", 4, "f"), ("z", 8, "f")]
    wide = [("z", 16, "d"), ("y", 8, "d"), ("intensity", 26, "H"), ("x", 0, "d")]
    a = [(0.5, 1.5, -2.0), (float("nan"), 1.0, 1.0), (1.0, float("inf"), 0.0), (3.25, 4.0, 5.0)]
    b = [(1.5, 2.5, 7, 3.5), (4.5, 5.5, 9, 6.5)]
    rows = [
        ("/a", 1, cloud(10, a, xyz, 16)), ("/a", 2, cloud(11, a[::-1], xyz, 16)), ("/a", 3, cloud(12, a, xyz, 12, big=True)), ("/a", 4, cloud(13, a, xyz, 12, height=2, pad=5)), ("/b", 5, cloud(14, b, wide, 32, order=">")),
        ("/b", 6, cloud(15, b, wide, 32, big=True)), ("/c", 7, cloud(16, [(1.0, 2.0)], xyz[:2], 8)), ("/c", 8, cloud(17, [], xyz, 12)), ("/c", 9, cloud(18, a, xyz, 12)[:-30]),
    ]
    out = payloads.points(spark.createDataFrame(rows, SCHEMA).repartition(2))
    got = {}
    for x in out.orderBy("log_ns", "i").collect():
        got.setdefault(x.log_ns, []).append((x.i, x.x, x.y, x.z, x.intensity))
        assert (x.frame, x.stamp_ns) == ("lidar", x.log_ns + 9)
    good = [(0, *map(f, a[0]), None), (3, *map(f, a[3]), None)]
    assert got[1] == got[3] == got[4] == good and got[2] == [(0, *good[1][1:]), (3, *good[0][1:])]
    assert got[5] == got[6] == [(0, 3.5, 2.5, 1.5, 7.0), (1, 6.5, 5.5, 4.5, 9.0)] and not {7, 8, 9} & got.keys()


def test_record_files(spark, tmp_path):
    r = np.random.default_rng(3)
    frames = np.zeros(7, payloads.KEYFRAME)
    for n in frames.dtype.names:
        frames[n] = r.standard_normal(7)
    (tmp_path / "a.kf").write_bytes(frames.tobytes() + b"cut off")
    data, want = b"", []
    for s in range(4):
        some = np.zeros(s, payloads.STATE)
        some["id"], some["x"], some["ts"] = np.arange(s), r.standard_normal(s), s + 0.5
        data += np.array([(s * 2.0, s)], payloads.STATE_HEAD).tobytes() + some.tobytes()
        want += [(s, s * 2.0, int(x["id"]), float(x["x"]), float(x["ts"])) for x in some]
    (tmp_path / "a.states").write_bytes(data + struct.pack("<dI", 9.0, 3) + b"x")
    read = lambda name: spark.read.format("binaryFile").load(str(tmp_path / name))
    assert payloads.KEYFRAME.itemsize == 120
    got = payloads.record_files(read("a.kf"), payloads.KEYFRAME).orderBy("i").collect()
    assert [x.i for x in got] == list(range(7)) and all(got[k][n] == frames[n][k] for k in range(7) for n in frames.dtype.names)
    assert [(x.state, x.state_ts, x.id, x.x, x.ts) for x in payloads.state_files(read("a.states")).orderBy("state", "id").collect()] == want


def test_a_log_is_decoded_profiled_changed_and_written_back(spark, tmp_path):
    container.register(spark)
    r = random.Random(4)
    rows = []
    for i in range(120):
        edges = [(i * 10**8, "map", "odom", pose(r)), (i * 10**8, "odom", "base", pose(r))] + ([(i * 10**8, "base", "lidar", pose(r))] if i % 3 == 0 else [])
        rows.append(("/tf", i * 10**8, tf(edges if i % 7 else edges[:1]), "tf2_msgs/msg/TFMessage"))
    rows += [("/scan", i * 10**8 + 5, bytes([i]), "other") for i in range(50)]
    spark.createDataFrame(rows, SCHEMA + ", schema string").repartitionByRange(3, "log_ns").write.format("messagelog").mode("append").save(str(tmp_path / "a"))
    log = spark.read.format("messagelog").option("path", str(tmp_path / "a")).load()
    edges = payloads.transforms(log.filter("topic = '/tf'").select("topic", "log_ns", "data"))
    assert {(x.frame, x.root, x.depth) for x in graph.root_of(edges.select("child", "parent").distinct()).collect()} == {("odom", "map", 1), ("base", "map", 2), ("lidar", "map", 3)}
    # frames renamed, an edge dropped; messages stay even if emptied
    renamed = lambda c: mutations.renamed_frame(F.col(c), {"odom": "wheel"}, "r1/", ("map",)).alias(c)
    dropped = F.col("child") != "r1/lidar"
    changed = edges.select("topic", "log_ns", "i", "stamp_ns", renamed("parent"), renamed("child"), *payloads.POSE)
    changed = changed.withColumn("child", F.when(dropped, F.col("child")))
    back = payloads.encoded_transforms(changed, ["topic", "log_ns"]).withColumn("schema", F.lit("tf2_msgs/msg/TFMessage"))
    back.sortWithinPartitions("log_ns").write.format("messagelog").mode("append").save(str(tmp_path / "b"))
    again = payloads.transforms(spark.read.format("messagelog").option("path", str(tmp_path / "b")).load().select("topic", "log_ns", "data"))
    key = lambda x: (x.log_ns, x.child, x.parent, *[x[p] for p in payloads.POSE])
    names = {"map": "map", "odom": "wheel", "base": "r1/base", "lidar": "r1/lidar"}
    want = [(x.log_ns, names[x.child], names[x.parent], *[x[p] for p in payloads.POSE]) for x in edges.collect() if x.child != "lidar"]
    assert sorted(map(key, again.collect())) == sorted(want)
    only = spark.createDataFrame([("/tf", 1, 0, 0, "a", None, *[0.0] * 7)], "topic string, log_ns long, i int, stamp_ns long, parent string, child string, " + ", ".join(f"{p} double" for p in payloads.POSE))
    assert payloads.encoded_transforms(only, ["topic", "log_ns"]).first().data == tf([])
