"""Operators on small tables, beyond what the catalog's queries show."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import asof, graph, mutations
from tracewell.streaming import live
from tracewell.streaming.drain import drained


def test_deep_tree_and_cycles(spark):
    chain = [(i, i + 1) for i in range(300)]
    loop = [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000), (1004, 1003), (2000, 2000)]
    edges = spark.createDataFrame(chain + loop, "child long, parent long")
    got = {r.frame: (r.root, r.depth) for r in graph.root_of(edges).collect()}
    assert got == {i: (300, 300 - i) for i in range(300)}
    assert {(r.frame, r.length) for r in graph.in_cycles(edges).collect()} == {(1000, 3), (1001, 3), (1002, 3), (2000, 1)}
    seen = graph.climbed(spark.createDataFrame(chain, "child long, parent long"), spark.createDataFrame([(150,)], "frame long"))
    assert {r.frame for r in seen.filter("seen").collect()} == set(range(150))


def test_hops(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a"), ("x", "y")], "child string, parent string")
    got = {(r.frame, r.hops) for r in graph.hops(edges, spark.createDataFrame([("c",)], "frame string")).collect()}
    assert got == {("c", 0), ("b", 1), ("a", 2), ("d", 3)}


def test_asof_against_bisection(spark):
    import bisect

    r = random.Random(2)
    samples = [(r.choice("ab"), r.randint(0, 50), float(i)) for i in range(60)]
    probes = [(r.choice("abc"), r.randint(-5, 55), i) for i in range(80)]
    out = asof.around(spark.createDataFrame(probes, "k string, t long, id long"), spark.createDataFrame(samples, "k string, t long, v double"), "k", "t", ["v"])
    for row in out.collect():
        mine = sorted((t, v) for k, t, v in samples if k == row.k)
        at = bisect.bisect_right(mine, (row.t, float("inf")))
        assert (None if row.before is None else tuple(row.before)) == (mine[at - 1] if at else None)
        at = bisect.bisect_left(mine, (row.t, -1.0))
        assert (None if row.after is None else tuple(row.after)) == (mine[at] if at < len(mine) else None)
    assert out.count() == len(probes)


def test_asof_of_one_large_key_is_linear(spark):
    n = 200_000
    samples = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("t"), F.col("id").cast("double").alias("v"))
    probes = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10 + 3).alias("t"), "id")
    out = asof.around(probes, samples, "k", "t", ["v"])
    assert out.filter("before.v = id AND (after.v = id + 1 OR id = 199999)").count() == n


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.numbers(F.lit("a -1.5e3, .5 and v1.2.3, utf8; 7"))) == ["-1.5e3", ".5", "7"]
    assert one(text.accepted(F.lit("something else"))) is None
    assert one(text.console(F.lit("Traceback (most recent call last):"))) is None
    assert one(text.hex_address(F.lit("0100007F:1F90"))) == "127.0.0.1:8080"
    assert one(text.channel(F.lit("/fleet/a/b/m.Type"))) == "a/b"
    assert one(text.link_event(F.lit("RTW: DISASSOC then deauth"))) == "disconnect"


def test_listings_with_odd_lines(spark):
    def parsed(f, lines):
        return [r.x and tuple(r.x) for r in spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string").orderBy("i").select(f(F.col("line")).alias("x")).collect()]

    ps = ["  12 1   30 pts/0 ann  python3 -m  run", "1 0 5 ? root [kthread]", "1 0 x ? root a", "PID PPID ELAPSED TT USER ARGS", "1 2 3 ? u", "", None, "9 1 2\tpts/1\tbob\tsh -c 'a  b'"]
    assert parsed(lambda c: text.process(c, F.lit(100)), ps) == [(12, 1, 70, "pts/0", "ann", "python3 -m  run"), (1, 0, 95, None, "root", "[kthread]"), None, None, None, None, None, (9, 1, 98, "pts/1", "bob", "sh -c 'a  b'")]
    ssh = [
        "1700.25 host sshd[7]: Accepted publickey for ann from ::ffff:10.0.0.1 port 22 ssh2: ED25519 SHA256:abc", "1700 host sshd-session[8]: Accepted password for bob from 10.0.0.2 port 4000 ssh2", "1700 host sshd[9]: Accepted none for c from h port 5: RSA SHA256:x",
        "1700 host sshd[9]: Failed password for c from h port 5", "1700 host cron[9]: Accepted none for c from h port 5", "x host sshd[9]: Accepted none for c from h port 5", "1700 host sshd[9]: Accepted none for c from h port many", "", None,
    ]
    assert parsed(text.accepted, ssh) == [(1700, 7, "publickey", "ann", "10.0.0.1", 22, "ED25519", "SHA256:abc"), (1700, 8, "password", "bob", "10.0.0.2", 4000, None, None), (1700, 9, "none", "c", "h", 5, "RSA", "SHA256:x"), *[None] * 6]
    who = ["ann pts/0  2024-03-01 10:30 (10.1.1.1)", "bob tty1   Mar  1 10:30", "carl :0 2024-03-01 10:30 (:0)", "dora pts/1 yesterday 10:30", "dora pts/1", None]
    at = 1709289000 - 3600
    assert parsed(lambda c: text.logged_in(c, F.lit(3600), 2024), who) == [("ann", "pts/0", at, "10.1.1.1"), ("bob", "tty1", at, None), ("carl", ":0", at, ":0"), None, None, None]
    log = [
        "12:00:01.123 [WAR][net.core   ] late by=[3]", "12:00:01.123 [inf][a]", "2026-10-13T02:03:49.050480Z  WARN net-0 ThreadId(03) zed::net::x: gone: b", "2026-10-13T02:03:49Z ERROR a::b:c: d::e: f", "2026-10-13T02:03:49Z NOTE a::b: f",
        "12:00 [inf][a] x", "12:00:01.1 inf][a] x", "12:00:01.1 [in f][a] x", "Traceback (most recent call last):", "", None,
    ]
    assert parsed(text.console, log) == [("war", "net.core", "late by=[3]"), ("inf", "a", ""), ("war", "zed::net::x", "gone: b"), ("err", "a::b:c", "d::e: f"), *[None] * 7]
    args = ["/h/u/.vscode-server-insiders-server/x", "/h/u/.cursor-server/bin", "/h/.vscode-insiders-server/n", "vscode-server", None]
    assert [r.x for r in spark.createDataFrame([(i, a) for i, a in enumerate(args)], "i int, a string").orderBy("i").select(text.editor(F.col("a")).alias("x")).collect()] == ["VS Code", "Cursor", "VS Code", None, None]
    ips = {"127.0.0.1": "loopback", "[::1]": "loopback", "100.64.1.2": "overlay", "100.63.1.2": "public", "FD7A:115C:A1E0::5": "overlay", "169.254.3.4": "private", "172.31.0.1": "private", "172.32.0.1": "public", "fe80::1": "public", "1.2.3": "name", "1.2.3.4.5": "name", "999.1.1.1": "name", "dead.beef": "name", "a:b": "name", "": "name"}
    rows = spark.createDataFrame(list(ips.items()), "ip string, want string").withColumn("got", text.address_class(F.col("ip"))).collect()
    assert [(r.ip, r.got) for r in rows] == [(r.ip, r.want) for r in rows]


def test_mutations_refuse(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "stream string, id long, ts long")
    with pytest.raises(ValueError):
        mutations.rename_stream(rows, {"a": "x y"})
    with pytest.raises(ValueError):
        mutations.rename_stream(rows, {"a": "x", "b": "x"})
    with pytest.raises(ValueError, match="has a stream"):
        mutations.rename_stream(rows, {"a": "b"})
    assert sorted(tuple(r) for r in mutations.rename_stream(rows, {"a": "b", "b": "a"}).collect()) == [("a", 2, 20), ("b", 1, 10)]
    with pytest.raises(ValueError):
        mutations.appended(rows, rows, ["a"], overwrite=False)
    head, tail = mutations.cut_with_carry(rows, 15)
    assert [tuple(r) for r in head.collect()] == [("a", 1, 10)]
    assert sorted(tuple(r) for r in tail.collect()) == [("a", 1, 15), ("b", 2, 20)]


SCHEMA = "event_id long, user_id long, stream string, at timestamp"


def batches(spark, folder, rows, n):
    """The rows as n files, read one in each batch."""
    data = spark.createDataFrame(rows, "event_id long, user_id long, stream string, us long").select("event_id", "user_id", "stream", F.timestamp_micros("us").alias("at"))
    step = -(-len(rows) // n)
    for i in range(n):
        data.filter(f"event_id >= {i * step} AND event_id < {(i + 1) * step}").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_streams_do_not_depend_on_batches(spark, tmp_path):
    r = random.Random(3)
    t, rows = 0, []
    for i in range(120):
        t += r.choice([1, 5, 40, 400]) * 1_000_000
        rows.append((i, r.randint(1, 4), r.choice(["open", "held", "x"]), t))
    got = {}
    for n in (1, 5):
        s = lambda: batches(spark, tmp_path / f"n{n}-{r.random()}", rows, n)  # noqa: B023, E731
        got[n] = (
            sorted(map(tuple, drained(live.presence(s(), 30_000_000, 300_000_000)).collect())),
            sorted(map(tuple, drained(live.released(s(), "open", "held")).collect())),
            sorted(map(tuple, drained(live.tumbling_counts(s(), "1 minute"), "complete").collect())),
            sorted(map(tuple, drained(live.firsts(s(), ["user_id", "stream"])).collect())),
        )
    assert got[1] == got[5] and all(got[1])
    opened = {}
    for _, u, k, at in rows:
        if k == "open":
            opened.setdefault(u, at)
    assert got[1][1] == sorted((i,) for i, u, k, at in rows if k == "held" and u in opened and at >= opened[u])
