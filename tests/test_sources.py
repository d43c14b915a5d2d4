"""Sources over small files made here."""

import sqlite3
import struct

import pytest
import zstandard

from tracewell.sources import container, store


@pytest.fixture(scope="module")
def recording(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "a.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE _streams (name TEXT PRIMARY KEY, config TEXT NOT NULL)")
    for name, config in (("odom", '{"payload_module": "geo.msgs.Odometry", "codec": "lz4+lcm"}'), ("scan", "no json"), ("empty", "{}")):
        db.execute("INSERT INTO _streams VALUES (?, ?)", (name, config))
        db.execute(f'CREATE TABLE "{name}" (id INTEGER PRIMARY KEY AUTOINCREMENT, ts REAL NOT NULL)')
    db.execute("CREATE TABLE odom_blob (id INTEGER PRIMARY KEY, data BLOB NOT NULL)")
    for i in range(50):
        db.execute("INSERT INTO odom (ts) VALUES (?)", (100 + i / 10,))
        db.execute("INSERT INTO odom_blob VALUES (?, ?)", (i + 1, bytes([i])))
        db.execute("INSERT INTO scan (ts) VALUES (?)", (200 + i,))
    db.commit()
    db.close()
    return path


def test_store(spark, recording):
    store.register(spark)
    read = lambda **o: spark.read.format("recording").options(path=recording, **o).load()
    assert [tuple(r) for r in read(table="streams").orderBy("name").collect()] == [("empty", None, "lcm"), ("odom", "Odometry", "lz4+lcm"), ("scan", None, "lcm")]
    rows = read(partitions="3").collect()
    assert len(rows) == 100 and {r.stream for r in rows} == {"odom", "scan"}
    assert sorted((r.id, r.ts_us, bytes(r.data)) for r in rows if r.stream == "odom") == [(i + 1, 100_000_000 + i * 100_000, bytes([i])) for i in range(50)]
    assert all(r.data is None for r in rows if r.stream == "scan")
    some = read().filter("stream = 'odom' AND ts_us >= 101000000 AND ts_us < 102000000")
    assert sorted(r.id for r in some.collect()) == list(range(11, 21))
    assert read(payload="false", stream="odom").filter("data IS NOT NULL").count() == 0


def test_store_refuses_other_files(spark, tmp_path):
    store.register(spark)
    (tmp_path / "x").write_bytes(b"something else")
    with pytest.raises(Exception, match="no recording store"):
        spark.read.format("recording").option("path", str(tmp_path / "x")).load()


def text(s: str) -> bytes:
    return struct.pack("<I", len(s)) + s.encode()


def record(kind: int, body: bytes) -> bytes:
    return bytes([kind]) + struct.pack("<Q", len(body)) + body


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "a.mcap")
    channel = {n: record(4, struct.pack("<HH", n, 1) + text(t) + text("cdr") + struct.pack("<I", 0)) for n, t in ((1, "/odom"), (2, "/scan"))}
    schema = record(3, struct.pack("<H", 1) + text("geo/Odometry") + text("ros2msg") + struct.pack("<I", 0))
    out, indexes = container.MAGIC + record(1, text("") + text("")), []
    for c in range(4):
        data, index = b"", {}
        for i in range(10):
            n, t = (1 if c < 3 else 2), c * 100 + i
            index.setdefault(n, []).append((t, len(data)))
            data += record(5, struct.pack("<HIQQ", n, i, t, t + 1) + bytes([c, i]))
        packed, kind = (zstandard.ZstdCompressor().compress(data), "zstd") if c % 2 else (data, "")
        at = len(out)
        chunk = record(6, struct.pack("<QQQI", c * 100, c * 100 + 9, len(data), 0) + text(kind) + struct.pack("<Q", len(packed)) + packed)
        out += chunk
        places = {}
        for n, entries in index.items():
            places[n] = len(out)
            rows = b"".join(struct.pack("<QQ", *e) for e in entries)
            out += record(7, struct.pack("<HI", n, len(rows)) + rows)
        offsets = b"".join(struct.pack("<HQ", n, p) for n, p in places.items())
        indexes.append(record(8, struct.pack("<QQQQ", c * 100, c * 100 + 9, at, len(chunk)) + struct.pack("<I", len(offsets)) + offsets + struct.pack("<Q", 0) + text(kind) + struct.pack("<QQ", len(packed), len(data))))
    meta_at = len(out)
    meta = record(12, text("robot") + struct.pack("<I", len(text("id") + text("7"))) + text("id") + text("7"))
    out += meta
    counts = struct.pack("<HQHQ", 1, 30, 2, 10)
    stats = record(11, struct.pack("<QHIIIIQQ", 40, 1, 2, 0, 1, 4, 0, 309) + struct.pack("<I", len(counts)) + counts)
    start = len(out)
    out += schema + channel[1] + channel[2] + b"".join(indexes) + stats + record(13, struct.pack("<QQ", meta_at, len(meta)) + text("robot"))
    out += record(2, struct.pack("<QQI", start, 0, 0)) + container.MAGIC
    with open(path, "wb") as f:
        f.write(out)
    return path


def test_log(spark, log):
    container.register(spark)
    read = lambda table, **o: spark.read.format("messagelog").options(path=log, table=table, **o).load()
    assert [tuple(r) for r in read("channels").orderBy("channel_id").collect()] == [(1, "/odom", "geo/Odometry", "cdr", 30), (2, "/scan", "geo/Odometry", "cdr", 10)]
    rows = read("messages", run_bytes="1").orderBy("log_ns").collect()
    assert [(r.topic, r.log_ns, r.publish_ns, bytes(r.data)) for r in rows] == [("/odom" if c < 3 else "/scan", c * 100 + i, c * 100 + i + 1, bytes([c, i])) for c in range(4) for i in range(10)]
    assert [r.log_ns for r in read("index").orderBy("log_ns").collect()] == [r.log_ns for r in rows]
    assert [tuple(r) for r in read("metadata").collect()] == [("robot", "id", "7")]
    stated = {r.channel_id: r.stated for r in read("channels").collect()}
    counted = {r.channel_id: r["count"] for r in read("index").groupBy("channel_id").count().collect()}
    assert stated == counted


def test_log_leaves_out_chunks(log):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

    reader = container.LogReader({"path": log, "run_bytes": "1"})
    assert len(reader.partitions()) == 4
    list(reader.pushFilters([EqualTo(("topic",), "/odom"), GreaterThanOrEqual(("log_ns",), 105)]))
    assert len(reader.partitions()) == 2



def messages(spark, path, table="messages"):
    container.register(spark)
    return spark.read.format("messagelog").options(path=str(path), table=table).load()


def rows_of(df):
    return sorted((r.topic, r.log_ns, r.publish_ns, r.sequence, bytes(r.data)) for r in df.collect())


def written(spark, folder, n=300, **options):
    container.register(spark)
    rows = [(["/odom", "/scan", "/tf"][i % 3] if i < 250 else "/late", 1000 + i // 2, 2000 + i, i, bytes([i % 256]) * (i % 50), "geo/T" if i % 3 else None, "cdr") for i in range(n)]
    df = spark.createDataFrame(rows, "topic string, log_ns long, publish_ns long, sequence long, data binary, schema string, encoding string").repartitionByRange(3, "log_ns").sortWithinPartitions("log_ns")
    df.write.format("messagelog").options(**{"chunk_bytes": "700", **options}).mode("append").save(str(folder))
    return df


@pytest.mark.parametrize("packing", ["zstd", ""])
def test_a_written_log_reads_back_equal(spark, tmp_path, packing):
    folder = tmp_path / "log"
    df = written(spark, folder, packing=packing)
    assert len(list(folder.glob("*.mcap"))) == 3 and (folder / "_manifest.json").exists() and not list(folder.glob("_writing*"))
    assert rows_of(messages(spark, folder)) == rows_of(df)
    assert sorted(map(tuple, messages(spark, folder, "index").select("topic", "log_ns").collect())) == sorted(map(tuple, df.select("topic", "log_ns").collect()))
    stated = {r.topic: r.n for r in messages(spark, folder, "channels").groupBy("topic").agg({"stated": "sum"}).toDF("topic", "n").collect()}
    assert stated == {r.topic: r["count"] for r in df.groupBy("topic").count().collect()}
    for path in folder.glob("*.mcap"):  # each is a file of its own
        assert len(container.summary(str(path)).chunks) > 1
    some = messages(spark, folder).filter("topic IN ('/odom', '/late') AND log_ns >= 1050")
    assert rows_of(some) == [r for r in rows_of(df) if r[0] in ("/odom", "/late") and r[1] >= 1050]
    written(spark, folder, 9)  # append
    assert messages(spark, folder).count() == 309
    df.limit(5).write.format("messagelog").mode("overwrite").save(str(folder))
    assert messages(spark, folder).count() == 5 and len(list(folder.glob("*.mcap"))) == 1


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "log"
    container.register(spark)
    bad = spark.createDataFrame([("/a", 1, b"x")] * 50 + [(None, 2, b"y")], "topic string, log_ns long, data binary").repartition(4)
    with pytest.raises(Exception, match="needs a topic"):
        bad.write.format("messagelog").mode("append").save(str(folder))
    assert not folder.exists() or not list(folder.rglob("*"))
    store.register(spark)
    worse = spark.createDataFrame([("a", 1)] * 50 + [("b", None)], "stream string, ts_us long").repartition(4)
    with pytest.raises(Exception, match="needs a stream"):
        worse.write.format("recording").mode("append").save(str(tmp_path / "store"))
    assert not list((tmp_path / "store").rglob("*"))
    with pytest.raises(Exception, match="needs the columns"):
        bad.drop("data").write.format("messagelog").mode("append").save(str(folder))


def test_a_written_recording_reads_back_equal(spark, tmp_path):
    store.register(spark)
    folder = str(tmp_path / "store")
    rows = [(f"s{i % 4}", 1_000_000 * i + i, None if i % 7 == 0 else bytes([i % 256]), "geo.T", "lz4+lcm") for i in range(5000)]
    df = spark.createDataFrame(rows, "stream string, ts_us long, data binary, payload string, codec string").repartition(3)
    df.write.format("recording").mode("append").save(folder)
    got = spark.read.format("recording").option("path", folder).load()
    assert sorted((r.stream, r.ts_us, r.data and bytes(r.data)) for r in got.collect()) == sorted(r[:3] for r in rows)
    assert got.filter("stream = 's1' AND ts_us < 50000000").count() == sum(r[0] == "s1" and r[1] < 50_000_000 for r in rows)
    assert [tuple(r) for r in spark.read.format("recording").options(path=folder, table="streams").load().orderBy("name").collect()] == [(f"s{i}", "T", "lz4+lcm") for i in range(4)]
    with pytest.raises(Exception, match="nothing was committed"):
        (tmp_path / "empty").mkdir()
        spark.read.format("recording").option("path", str(tmp_path / "empty")).load()


def test_the_last_message_of_each_topic(spark, tmp_path):
    df = written(spark, tmp_path / "log")
    want = {}
    for r in sorted(rows_of(df), key=lambda r: (r[1], r[3])):
        want[r[0]] = r
    got = messages(spark, tmp_path / "log", "last")
    assert {r.topic: r.log_ns for r in got.collect()} == {t: r[1] for t, r in want.items()}
    assert [(r.topic, bytes(r.data)) for r in got.filter("topic = '/late'").collect()] == [("/late", want["/late"][4])]


def test_unclosed_and_unindexed_logs(spark, tmp_path, log):
    from tracewell.sources.container_file import ContainerFile

    whole = tmp_path / "whole.mcap"
    with open(whole, "wb") as f:
        out = ContainerFile(f, "zstd", 200)
        for i in range(60):
            out.add(out.channel("/a" if i % 2 else "/b", "geo/T"), i, i, i, bytes([i]) * 9)
        out.close()
    data = whole.read_bytes()
    told = container.summary(str(whole))
    cut = told.chunks[-1]["at"] + 20  # in the last chunk
    (tmp_path / "cut.mcap").write_bytes(data[:cut])
    (tmp_path / "open.mcap").write_bytes(data[: data.rindex(b"\x0f\x04\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00")])
    rows = rows_of(messages(spark, whole))
    assert len(rows) == 60 and rows_of(messages(spark, tmp_path / "open.mcap")) == rows
    some = rows_of(messages(spark, tmp_path / "cut.mcap"))
    assert 30 < len(some) < 60 and set(some) < set(rows)
    # no message indexes: chunks are read for the index table
    bare, at = container.MAGIC, 8
    while at < told.chunks[-1]["at"] + told.chunks[-1]["size"]:
        size = 9 + int.from_bytes(data[at + 1 : at + 9], "little")
        if data[at] != container.MESSAGE_INDEX:
            bare += data[at : at + size]
        at += size
    (tmp_path / "bare.mcap").write_bytes(bare)
    assert rows_of(messages(spark, tmp_path / "bare.mcap")) == rows
    assert messages(spark, tmp_path / "bare.mcap", "index").count() == 60
    assert {r.topic: r.log_ns for r in messages(spark, tmp_path / "bare.mcap", "last").collect()} == {"/a": 59, "/b": 58}


def test_lz4_chunks(tmp_path):
    import io

    import pyarrow as pa

    data = record(5, struct.pack("<HIQQ", 1, 0, 7, 7) + b"hello" * 20)
    packed = pa.Codec("lz4").compress(data, asbytes=True)
    chunk = record(6, struct.pack("<QQQI", 7, 7, len(data), 0) + text("lz4") + struct.pack("<Q", len(packed)) + packed)
    assert container.unpacked(io.BytesIO(chunk), 0, len(chunk)) == data


def test_rewriting_touches_only_the_chunks_it_must(spark, tmp_path):
    from tracewell.sources import rewrite

    df = written(spark, tmp_path / "log", chunk_bytes="400")
    every = rows_of(df)
    told = rewrite.without_topics(spark, str(tmp_path / "log"), str(tmp_path / "rest"), ["/late"], run_bytes=1500).collect()
    assert rows_of(messages(spark, tmp_path / "rest")) == [r for r in every if r[0] != "/late"]
    total = lambda told, c: sum(r[c] or 0 for r in told)
    size = sum(c["size"] for p in (tmp_path / "log").glob("*.mcap") for c in container.summary(str(p)).chunks)
    assert total(told, "chunks_opened") <= 1 and total(told, "chunks_dropped") >= 2 and total(told, "chunks_passed") >= 5
    assert total(told, "bytes_opened") < size / 10 and total(told, "bytes_read") < size
    assert len(told) > 3
    head, tail = rewrite.head_and_tail(spark, str(tmp_path / "log"), str(tmp_path / "head"), str(tmp_path / "tail"), 1060)
    assert rows_of(messages(spark, tmp_path / "head")) == [r for r in every if r[1] < 1060]
    assert rows_of(messages(spark, tmp_path / "tail")) == [r for r in every if r[1] >= 1060]
    both = head.collect() + tail.collect()
    assert total(both, "chunks_opened") <= 6 and total(both, "bytes_read") < 1.3 * size
    # what was rewritten is a log like another
    again = rewrite.without_topics(spark, str(tmp_path / "rest"), str(tmp_path / "less"), ["/odom", "/tf"]).collect()
    assert rows_of(messages(spark, tmp_path / "less")) == [r for r in every if r[0] == "/scan"] and total(again, "chunks_passed") == 0
    rewrite.without_topics(spark, str(tmp_path / "less"), str(tmp_path / "none"), ["/scan"])
    assert messages(spark, tmp_path / "none").count() == 0
