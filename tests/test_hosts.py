"""Owners, names and telemetry on hand-made rows."""

import json

from pyspark.sql import functions as F

from tracewell.operators import hosts
from tracewell.sources import telemetry


def test_owners(spark):
    p = [(1, 0, "init"), (10, 1, "sshd: ann"), (11, 10, "-bash"), (12, 11, "python x"), (20, 1, "tmux new"), (21, 20, "vim"), (30, 1, "/lib/systemd --user"), (31, 30, "pulse"), (40, 1, "/h/.cursor-server/x agent host"), (41, 40, "node"), (50, 1, "lone job"), (51, 50, "child"), (60, 999, "orphan"), (70, 71, "a"), (71, 70, "b"), (80, 81, "a"), (81, 82, "b"), (82, 80, "tmux"), (92, 91, "x"), (91, 90, "y"), (90, 1, "screen")]
    p += [(100 + i, 99 + i if i else 12, f"deep {i}") for i in range(60)]
    out = {r.pid: (r.session, r.via) for r in hosts.owners(spark.createDataFrame(p, "pid long, ppid long, args string"), spark.createDataFrame([(10, "9.9.9.9"), (5, None)], "pid long, ip string")).collect()}
    assert len(out) == len(p)
    assert out[10] == out[12] == out[159] == (10, "ssh from 9.9.9.9")
    assert out[20] == out[30] == out[50] == (None, "detached (parent is init)") and out[21] == (None, "tmux/screen") and out[31] == (None, "systemd user service")
    assert out[41] == (None, "under Cursor pid 40") and out[51] == (None, "lone job") and out[60] == (None, "?") and out[70] == (None, "b")
    assert out[80] == out[81] == out[92] == out[91] == (None, "tmux/screen")


def test_panes(spark):
    rows = [("ann", 5, "tmux(7).%1"), ("ann", 3, "tmux(7).%0"), ("bob", 9, "tmux(8)"), ("bob", 1, "10.0.0.1"), ("bob", 1, None), ("x", 1, "tmux(y)")]
    assert sorted(map(tuple, hosts.panes(spark.createDataFrame(rows, "user string, time long, origin string")).collect())) == [(7, "ann", 2, 3), (8, "bob", 1, 9)]


def test_telemetry(spark, tmp_path):
    s = lambda t, **x: json.dumps({"t": t, "k": "s", **x})
    a = [
        json.dumps({"t": "2024-03-01T10:00:00Z", "k": "start", "iface": "wlan0", "ports": [1, 2], "pid": 7}),
        s("2024-03-01T10:00:01Z", iw={"signal": -50}, socks=[{"port": 1, "sendq": 5, "retrans": 1}, {"port": 2, "sendq": 9}], ping={"1.1.1.1": {"rtt": 3.5}, "8.8.8.8": {"loss": 1}}),
        "{broken", s("2024-03-01T10:00:02Z", iw={"signal": -70}, socks=[{"port": 1, "sendq": 9, "retrans": 4}]), "", json.dumps({"t": "2024-03-01T10:00:03Z", "k": "e", "kind": "roam", "n": 3, "line": "x"}), "[1]", '"text"', s("2024-03-01T10:00:04Z"),
    ]
    (tmp_path / "netlog-2024-03-01.jsonl").write_text("\n".join(a) + "\n")
    (tmp_path / "netlog-2024-03-02.jsonl").write_text(json.dumps({"t": "2024-03-02T00:00:00Z", "k": "e", "kind": "roam"}) + "\ncut off {")
    path = str(tmp_path)
    assert sorted((str(r.day), r.n) for r in telemetry.broken(spark, path).collect()) == [("2024-03-01", 3), ("2024-03-02", 1)]
    assert telemetry.samples(spark, path).count() == 3
    assert {r.kind: r.n for r in telemetry.events(spark, path).groupBy("kind").agg(F.sum("n").alias("n")).collect()} == {"roam": 4}
    r = telemetry.report(spark, path).first()
    assert (r.samples, r.first, r.last, r.signal_low, r.signal_high) == (3, "2024-03-01T10:00:01Z", "2024-03-01T10:00:04Z", -70.0, -50.0)
    assert (r.worst_sendq, r.worst_at, r.retrans, r.probes, r.lost) == (9, "2024-03-01T10:00:01Z", 0, 2, 1)
    assert telemetry.recent(telemetry.lines(spark, path), "2024-03-04", 2).count() == 2
    assert telemetry.report(spark, str(tmp_path / "netlog-2024-03-02.jsonl")).collect() == []


def test_daily_files_are_kept_for_so_many_days(spark, tmp_path):
    folder = str(tmp_path / "days")
    rows = spark.createDataFrame([("2024-03-01 10:00:00", 1), ("2024-03-02 10:00:00", 2), ("2024-02-01 10:00:00", 3)], "at string, v long").withColumn("at", F.to_timestamp("at"))
    telemetry.write_daily(rows, folder, "2024-03-02", 5)
    assert sorted(r.v for r in spark.read.json(folder).collect()) == [1, 2]
    telemetry.write_daily(rows.filter("v = 2"), folder, "2024-03-07", 5)
    assert sorted(r.v for r in spark.read.json(folder).collect()) == [2, 2]
