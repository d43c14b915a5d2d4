"""A recording store (one SQLite file) as a data source and sink: spark.read.format("recording").option("path", ...).

Options: path, a file or a folder that was written here; table "streams" for the registry, else "rows"; stream, one name or several joined by commas (all by default);
payload "false" leaves the blobs unread; partitions, id ranges a stream is read in. Rows are (stream, id, ts_us, data).
Comparisons of stream and ts_us with literals reach the file as SQL; Spark sees what was pushed. The file must be readable where tasks run.

df.write.format("recording").mode("append" or "overwrite").save(folder) takes (stream, ts_us) and, where there are such columns, data, payload and
codec: a store for each task with ids from 1, which count once the job commits. Rows get their ids as they come.
"""

import json
import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .shared_output import SharedOutput, Written, members

#: Rows between two commits of a task's store.
COMMIT_ROWS = 2000
STREAMS = "name string, payload string, codec string"
ROWS = "stream string, id long, ts_us long, data binary"
COMPARISONS = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", EqualTo: "="}


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def settings(config: str | None) -> tuple[str | None, str]:
    """Payload type (last part of its name) and codec of a stream; defaults where they are missing or the text is no JSON."""
    try:
        found = json.loads(config or "")
    except ValueError:
        found = {}
    found = found if isinstance(found, dict) else {}
    payload = found.get("payload_module")
    return (str(payload).rsplit(".", 1)[-1] if payload else None), str(found.get("codec") or "lcm")


@dataclass
class Range(InputPartition):
    path: str
    stream: str
    low: int
    high: int


class StoreReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"], options.get("table", "rows")
        self.parts = max(1, int(options.get("partitions", "4")))
        self.payload = options.get("payload", "true") != "false"
        self.wanted = [s for s in options.get("stream", "").split(",") if s]
        self.times: list[tuple[str, int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            sign, column = COMPARISONS.get(type(f)), getattr(f, "attribute", None)
            if self.kind == "rows" and sign == "=" and column == ("stream",):
                self.wanted = [s for s in self.wanted if s == f.value] if self.wanted else [f.value]
                self.wanted = self.wanted or [""]  # contradictory: no stream has this name
            elif self.kind == "rows" and sign and column == ("ts_us",):
                self.times.append((sign, int(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.kind == "streams":
            return [InputPartition(0)]
        out: list[InputPartition] = []
        for path in members(self.path):
            db = opened(path)
            for (name,) in db.execute("SELECT name FROM _streams ORDER BY name").fetchall():
                if self.wanted and name not in self.wanted:
                    continue
                low, high = db.execute(f"SELECT min(id), max(id) FROM {quoted(name)}").fetchone()
                if low is not None:
                    step = max(1, -(-(high - low + 1) // self.parts))
                    out += [Range(path, name, at, min(at + step - 1, high)) for at in range(low, high + 1, step)]
            db.close()
        return out or [InputPartition(None)]  # Spark asks for one at least

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.kind == "streams":
            found = {}
            for path in members(self.path):
                db = opened(path)
                found |= dict(db.execute("SELECT name, config FROM _streams"))
                db.close()
            for name, config in sorted(found.items()):
                yield (name, *settings(config))
            return
        if not isinstance(partition, Range):
            return
        db = opened(partition.path)
        # a stamp is seconds as a REAL; whole microseconds are compared
        stamp = "CAST(round(m.ts * 1e6) AS INTEGER)"
        more = "".join(f" AND {stamp} {sign} ?" for sign, _ in self.times)
        name, blob = quoted(partition.stream), quoted(partition.stream + "_blob")
        has = db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (partition.stream + "_blob",)).fetchone()
        data, join = ("b.data", f"LEFT JOIN {blob} b ON b.id = m.id") if self.payload and has else ("NULL", "")
        sql = f"SELECT m.id, {stamp}, {data} FROM {name} m {join} WHERE m.id BETWEEN ? AND ?{more} ORDER BY m.id"
        for row in db.execute(sql, (partition.low, partition.high, *[v for _, v in self.times])):
            yield (partition.stream, *row)
        db.close()


class StoreWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], columns: list[str], overwrite: bool):
        self.out = SharedOutput(options["path"], overwrite, ".db")
        if missing := {"stream", "ts_us"} - set(columns):
            raise ValueError(f"a recording needs the columns {', '.join(sorted(missing))}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        path, db, rows, ids = None, None, 0, {}
        for batch in iterator:
            names = batch.schema.names
            of = {c: batch.column(c).to_pylist() if c in names else [None] * batch.num_rows for c in ("stream", "ts_us", "data", "payload", "codec")}
            for stream, ts, data, payload, codec in zip(*of.values(), strict=True):
                if not stream or ts is None:
                    raise ValueError("a row of a recording needs a stream and a time")
                if db is None:
                    path = self.out.new_file()
                    db = sqlite3.connect(path)
                    db.execute("CREATE TABLE _streams (name TEXT PRIMARY KEY, config TEXT NOT NULL)")
                if stream not in ids:
                    ids[stream] = 0
                    config = {k: v for k, v in (("payload_module", payload), ("codec_id", codec), ("codec", codec)) if v}
                    db.execute("INSERT INTO _streams VALUES (?, ?)", (stream, json.dumps(config)))
                    db.execute(f"CREATE TABLE {quoted(stream)} (id INTEGER PRIMARY KEY AUTOINCREMENT, ts REAL NOT NULL)")
                    db.execute(f"CREATE TABLE {quoted(stream + '_blob')} (id INTEGER PRIMARY KEY, data BLOB NOT NULL)")
                ids[stream] += 1
                db.execute(f"INSERT INTO {quoted(stream)} (id, ts) VALUES (?, ?)", (ids[stream], ts / 1e6))
                if data is not None:
                    db.execute(f"INSERT INTO {quoted(stream + '_blob')} VALUES (?, ?)", (ids[stream], data))
                rows += 1
                if rows % COMMIT_ROWS == 0:
                    db.commit()
        if db is None:
            return Written()
        db.commit()
        db.close()
        return Written([(os.path.basename(path), {"rows": rows, "streams": ids})])

    def commit(self, messages) -> None:
        self.out.commit(messages)

    def abort(self, messages) -> None:
        self.out.abort()


class RecordingStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        for path in members(self.options["path"])[:1]:
            with open(path, "rb") as f:
                if f.read(16) != b"SQLite format 3\0":
                    raise ValueError(f"{path} is no recording store")
        return STREAMS if self.options.get("table") == "streams" else ROWS

    def reader(self, schema) -> StoreReader:
        return StoreReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> StoreWriter:
        return StoreWriter(dict(self.options), schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingStore)
