"""State machines with timers and the streaming source of logs, against plain code; and whatever the batches are."""

import random
from functools import partial

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell.plans import catalog
from tracewell.sources import line_log
from tracewell.streaming import live, machines
from tracewell.streaming.drain import drained

S = machines.SECOND


def fed(spark, folder, rows, schema, n):
    """rows (at_us first) as a stream of n batches."""
    data = spark.createDataFrame(rows, schema)
    step = -(-len(rows) // n)
    for i in range(n):
        some = rows[i * step : (i + 1) * step]
        if some:
            spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return stream.withColumn("at", F.timestamp_micros("at_us")).drop("at_us")


def machine(make, rows, until):
    """What a machine tells of one key's rows, silence up to a time included."""
    out, own = [], make()
    for at, values in [*rows, (until, None)]:
        while not own.over() and own.due() is not None and (own.due() < at or values is None and own.due() <= at):
            out += own.expire(own.due())
        if own.over():
            own = make()
        if values is not None:
            out += own.row(at, values)
    return out


def presence_rows(seed):
    r, t, rows = random.Random(seed), 0, []
    for _ in range(150):
        t += r.choice([1, 3, 11, 13, 60, 200, 700]) * S
        rows.append((t, r.choice("ab"), r.choice(["up", "up", "down", "agent", "agent_module", "heartbeat", "run", "stop", "listens", "deaf"])))
    return rows


@pytest.mark.parametrize("n", [1, 5])
def test_presence(spark, tmp_path, n):
    rows = presence_rows(1)
    make = lambda: machines.Presence(forget_us=3000 * S)
    out = drained(machines.run(fed(spark, tmp_path / "in", rows, "at_us long, who string, signal string", n), make, "who", ["signal"], machines.Presence.schema, "0 seconds"))
    want = []
    for key in "ab":
        want += [(key, *x) for x in machine(make, [(t, {"signal": s}) for t, k, s in rows if k == key], rows[-1][0])]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert {"no-bridge", "stale", "live"} <= {x[2] for x in want}  # the others are looked at below


def test_presence_by_the_rules():
    p = machines.Presence()
    tell = lambda at, s: [x[1] for x in p.row(at * S, {"signal": s})]
    assert tell(0, "run") == ["no-bridge"] and tell(1, "up") == ["probably"] and tell(2, "stop") == ["searching"]
    assert tell(10, "heartbeat") == ["probably"] and p.due() == 22 * S and p.expire(22 * S) == [(22 * S, "searching")]
    assert tell(30, "agent_module") == ["live"] and p.due() == 42 * S and p.expire(42 * S) == [(42 * S, "searching")]
    assert tell(50, "agent") == ["live"] and p.due() == 230 * S and p.expire(230 * S) == [(230 * S, "stale")]
    assert tell(300, "run") == [] and tell(301, "listens") == ["live"] and tell(302, "deaf") == ["stale"] and tell(303, "down") == ["no-bridge"]
    assert p.due() == (303 + 86_400) * S and p.expire(p.due()) == [] and p.over()


@pytest.mark.parametrize("n", [1, 4])
def test_panels(spark, tmp_path, n):
    r, t, rows = random.Random(2), 0, []
    for i in range(120):
        t += r.choice([1, 2, 6, 7, 20]) * S
        rows.append((t, r.choice("xyz"), "stopped" if r.random() < 0.15 else "update", f"line {i}"))
    out = drained(machines.run(fed(spark, tmp_path / "in", rows, "at_us long, tool string, kind string, text string", n), machines.Panel, "tool", ["kind", "text"], machines.Panel.schema, "0 seconds"))
    want = []
    for key in "xyz":
        want += [(key, *x) for x in machine(machines.Panel, [(t, {"kind": k, "text": x}) for t, tool, k, x in rows if tool == key], rows[-1][0])]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    p = machines.Panel()
    assert p.row(0, {"kind": "stopped", "text": None}) == [] and p.over()
    p = machines.Panel()
    assert p.row(0, {"kind": "update", "text": "a"}) == [] and p.row(6 * S, {"kind": "update", "text": "b"}) == []
    assert p.due() == 12 * S + 1 and p.expire(p.due()) == [(0, 12 * S, 2, "b")]


@pytest.mark.parametrize("n", [1, 4])
def test_held_rows(spark, tmp_path, n):
    r, t, rows = random.Random(6), 1000 * S, []
    for i in range(150):
        t += r.choice([1, 5, 30]) * S
        rows.append((t, r.choice("abcdefgh"), "open" if r.random() < 0.04 else "scan", i))
    make = partial(machines.Held, "open", 300 * S)
    out = drained(machines.run(fed(spark, tmp_path / "in", rows, "at_us long, who string, stream string, event_id long", n), make, "who", ["stream", "event_id"], machines.Held.schema, "0 seconds"))
    want = []
    for key in "abcdefgh":
        want += [(key, *x) for x in machine(make, [(t, {"stream": s, "event_id": i}) for t, k, s, i in rows if k == key], rows[-1][0])]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    # a later opener after the patience changes nothing; an earlier one drops what was held before it
    h = make()
    assert h.row(0, {"stream": "scan", "event_id": 1}) == [] and h.due() == 300 * S and h.expire(h.due()) == [(1,)]
    assert h.row(400 * S, {"stream": "open", "event_id": 2}) == [] and h.row(401 * S, {"stream": "scan", "event_id": 3}) == [(3,)] and h.due() is None
    h = make()
    assert h.row(0, {"stream": "scan", "event_id": 1}) == [] and h.row(9, {"stream": "open", "event_id": 2}) == [] and h.row(9, {"stream": "scan", "event_id": 3}) == [(3,)]


@pytest.mark.parametrize("n", [1, 3])
def test_broken_trees(spark, tmp_path, n):
    rows = [(0, "r", "odom", "map"), (5 * S, "r", "base", "odom"), (12 * S, "r", "base", "map"), (31 * S, "r", "cam", "rig"), (33 * S, "r", "rig", "base"), (47 * S, "r", "arm", "table"), (52 * S, "s", "a", "b"), (53 * S, "r", "cam", "map"), (200 * S, "s", "b", "c")]
    rows = [(1000 * S + x[0], *x[1:]) for x in rows]
    out = drained(machines.run(fed(spark, tmp_path / "in", rows, "at_us long, rec string, child string, parent string", n), machines.BrokenTree, "rec", ["child", "parent"], machines.BrokenTree.schema, "0 seconds"))
    # the tree that was in two parts at 31 s had healed by the look at 40 s; it breaks again at 47 s
    assert sorted(map(tuple, out.collect())) == [("r", 1030 * S, "multiple parents", "base"), ("r", 1050 * S, "multiple trees", "map,table")]


def test_windows_close_by_the_watermark(spark, tmp_path):
    """In append mode a window is told once it is closed, late rows are dropped, and the last stays open."""
    rows = [(10 * S, "a"), (70 * S, "a"), (130 * S, "b"), (20 * S, "a"), (400 * S, "b"), (401 * S, "b"), (75 * S, "a"), (470 * S, "a")]
    source = fed(spark, tmp_path / "in", rows, "at_us long, stream string", len(rows))
    got = sorted(map(tuple, drained(live.tumbling_counts(source, "1 minute", "100 seconds")).collect()))
    assert got == [(0, "a", 2), (60 * S, "a", 1), (120 * S, "b", 1)]  # 75 s came after 400 s, which closed its window; 360 s and 420 s are open


def lines(spark, folder, checkpoint, **options):
    line_log.register(spark)
    got = []
    stream = spark.readStream.format("linelog").options(path=str(folder), **options).load()
    query = stream.writeStream.foreachBatch(lambda batch, _: got.extend(map(tuple, batch.collect()))).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(got)


def test_a_log_is_read_on_where_it_was(spark, tmp_path):
    log = tmp_path / "logs"
    log.mkdir()
    write = lambda name, text: (log / name).open("ab").write(text.encode())
    write("2024-01-01", "one\ntwo\nhalf a li")
    assert lines(spark, log, tmp_path / "c") == [("2024-01-01", 0, "one"), ("2024-01-01", 4, "two")]
    assert lines(spark, log, tmp_path / "c") == []
    write("2024-01-01", "ne\r\nnäxt\n")
    write("2024-01-02", "\nnew day\n" + "x" * 100 + "\n")
    assert lines(spark, log, tmp_path / "c", run_bytes="7") == [("2024-01-01", 8, "half a line"), ("2024-01-01", 21, "näxt"), ("2024-01-02", 0, ""), ("2024-01-02", 1, "new day"), ("2024-01-02", 9, "x" * 100)]
    assert lines(spark, log, tmp_path / "other", start="now") == []
    write("2024-01-03", "later\n")
    assert lines(spark, log, tmp_path / "other", start="now") == lines(spark, log, tmp_path / "c", keep="1") == [("2024-01-03", 0, "later")]
    write("2024-01-04", "more\n")
    assert lines(spark, log, tmp_path / "c", keep="1") == [("2024-01-04", 0, "more")]
    assert len(list(log.iterdir())) < 4  # wholly read files go but for the newest
    assert lines(spark, tmp_path / "logs" / "2024-01-04", tmp_path / "one") == [("2024-01-04", 0, "more")]


def late_silences(folder, hours, n_users=60):
    """Events so many hours apart that silences end in the ten minutes that the watermark has not passed, with rows after some; many at equal times."""
    r, rows = random.Random(9), []
    for user in range(n_users):
        for _ in range(r.randrange(4, 16)):
            at = r.choice(hours) * 3600 + r.choice([0, 30, 60, 120, 300, 420, 599, 600, r.randrange(1200)])
            rows.append((user, 1_704_067_200_000_000 + at * S, r.choice(["view", "click", "signup", "purchase", "error"])))
    r.shuffle(rows)
    values = ", ".join(f"({i}, make_timestamp({t}), {u}, '{k}', 1.5, '')" for i, (u, t, k) in enumerate(rows))
    con = duckdb.connect()
    con.sql(f"CREATE TABLE events AS SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value, props FROM (VALUES {values}) t(event_id, ts, user_id, event_type, value, props)")
    con.sql(f"COPY events TO '{folder}/events.parquet'")
    return con


@pytest.mark.parametrize("name", ["live_presence_states", "live_tool_panels", "live_broken_trees", "live_held"])
def test_silence_is_told_when_the_watermark_has_passed_it(spark, tmp_path, name):
    """As the SQL has it: also where a row that came since shows it, and rows of equal time count together."""
    con = late_silences(tmp_path, [0, 48, 72] if name == "live_broken_trees" else [0, 3, 6, 9, 12, 18, 24])
    got = catalog.QUERIES[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


@pytest.mark.parametrize("name, n", [("live_tumbling", "n"), ("live_rates", "round(hz * 86400)"), ("live_panels", "n")])
def test_open_windows_are_told_too(spark, tmp_path, name, n):
    """The newest rows' windows have not been closed by the watermark; each row is in some window all the same."""
    con = late_silences(tmp_path, [0, 3, 6, 9, 12, 18, 24])
    got = catalog.QUERIES[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted((*x[:-1], float(x[-1])) if name == "live_rates" else x for x in want)
    few = con.sql("SELECT sum(c) FROM (SELECT count(*) AS c FROM events GROUP BY ts::DATE, event_type HAVING c / 86400.0 >= 0.00005)").fetchall()[0][0]
    assert got.selectExpr(f"CAST(sum({n}) AS long)").first()[0] == (few if name == "live_rates" else con.sql("SELECT count(*) FROM events").fetchall()[0][0])
