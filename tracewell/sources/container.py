"""A message log (MCAP container) as a data source and sink: spark.read.format("messagelog").option("path", ...).

Options: path, a file or a folder that was written here; table "messages" (topic, channel_id, log_ns, publish_ns, sequence, data), "index"
(topic, channel_id, log_ns: read from the chunks' message indexes, so no chunk is opened), "last" (the last message of each
topic), "channels" (channel_id, topic, schema, encoding, stated) or "metadata" (name, key, value; of a name that comes twice the last).

Only the footer and the summary are read to plan; a file that was not closed, or has no summary, is planned from its records' heads, and a
chunk that was cut off is left out. A task reads a run of chunks; comparisons of topic (= and IN) and log_ns with literals leave out chunks by
the topics and times that the summary tells. Chunks are plain, zstd or lz4.

df.write.format("messagelog").mode("append" or "overwrite").save(folder) takes (topic, log_ns, data) and, where there are such columns,
publish_ns, sequence, schema and encoding: a file for each task, which count once the job commits. Rows go in as they come, so
sort within partitions by log_ns for files in order of time.
"""

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .shared_output import SharedOutput, Written, members

MAGIC = b"\x89MCAP0\r\n"
# fixed values: the format's record kinds
FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, MESSAGE_INDEX, CHUNK_INDEX, STATISTICS, METADATA, METADATA_INDEX = 2, 3, 4, 5, 6, 7, 8, 11, 12, 13
SCHEMAS = {
    "messages": "topic string, channel_id int, log_ns long, publish_ns long, sequence long, data binary",
    "index": "topic string, channel_id int, log_ns long",
    "last": "topic string, channel_id int, log_ns long, publish_ns long, sequence long, data binary",
    "channels": "channel_id int, topic string, schema string, encoding string, stated long",
    "metadata": "name string, key string, value string",
}


class Cursor:
    """Little-endian fields of a record's body, one after another."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, size: int) -> int:
        self.at += size
        return int.from_bytes(self.data[self.at - size : self.at], "little")

    def raw(self, size: int) -> bytes:
        self.at += size
        return self.data[self.at - size : self.at]

    def text(self) -> str:
        return self.raw(self.number(4)).decode()

    def pairs(self, key, value) -> dict:
        end, out = self.number(4) + self.at, {}
        while self.at < end:
            k = key()
            out[k] = value()
        return out


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 9 <= len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 9], "little")
        yield kind, data[at + 9 : at + 9 + size]
        at += 9 + size


@dataclass
class Chunks(InputPartition):
    """A run of chunks of one file: (place, length, indexes by channel)."""

    path: str
    chunks: list[tuple[int, int, dict[int, int]]] = field(default_factory=list)


@dataclass
class Summary:
    schemas: dict[int, str]
    channels: dict[int, tuple[str, int, str]]
    counts: dict[int, int]
    chunks: list[dict]
    metadata: list[tuple[int, int]]


def note(out: Summary, kind: int, body: bytes) -> None:
    """What a record of the summary, or of a chunk, tells of the file."""
    c = Cursor(body)
    if kind == SCHEMA:
        number = c.number(2)
        out.schemas[number] = c.text()
    elif kind == CHANNEL:
        number, schema = c.number(2), c.number(2)
        topic = c.text()
        out.channels[number] = (topic, schema, c.text())
    elif kind == CHUNK_INDEX:
        low, high, at, size = (c.number(8) for _ in range(4))
        out.chunks.append({"low": low, "high": high, "at": at, "size": size, "indexes": c.pairs(lambda: c.number(2), lambda: c.number(8))})
    elif kind == STATISTICS:
        c.raw(8 + 2 + 4 + 4 + 4 + 4 + 8 + 8)
        out.counts = c.pairs(lambda: c.number(2), lambda: c.number(8))
    elif kind == METADATA_INDEX:
        out.metadata.append((c.number(8), c.number(8)))


def summary(path: str) -> Summary:
    """What the end of the file tells, and no message is read; of a file without such an end, what its records' heads tell."""
    out = Summary({}, {}, {}, [], [])
    with open(path, "rb") as f:
        if f.read(8) != MAGIC:
            raise ValueError(f"{path} is no message log")
        end = f.seek(0, 2) - 37
        start = 0
        if end >= 8:
            f.seek(end)
            tail = f.read(37)
            if tail[-8:] == MAGIC and tail[0] == FOOTER:
                start = struct.unpack_from("<Q", tail, 9)[0]
        if start == 0:
            return walked(f)
        f.seek(start)
        for kind, body in records(f.read(end - start)):
            note(out, kind, body)
    if not out.chunks and out.counts:
        with open(path, "rb") as f:  # messages, but no index of chunks
            return walked(f)
    return out


def walked(f) -> Summary:
    """The summary of a file that has none: heads of records, and the channels that its chunks tell of, chunk by chunk until all are known.

    Chunks are passed over but for their heads, and for the first ones as long as an index names a channel that is not known yet.
    """
    out, end = Summary({}, {}, {}, [], []), f.seek(0, 2)
    at = 8
    while at + 9 <= end:
        f.seek(at)
        head = f.read(9)
        kind, size = head[0], int.from_bytes(head[1:], "little")
        if at + 9 + size > end:
            break  # cut off
        if kind == CHUNK:
            low, high = struct.unpack("<QQ", f.read(16))
            out.chunks.append({"low": low, "high": high, "at": at, "size": 9 + size, "indexes": {}})
        elif kind == MESSAGE_INDEX and out.chunks:
            number = int.from_bytes(f.read(2), "little")
            if size > 6:
                out.chunks[-1]["indexes"][number] = at
        elif kind in (SCHEMA, CHANNEL):
            note(out, kind, f.read(size))
        elif kind == METADATA:
            out.metadata.append((at, 9 + size))
        at += 9 + size
    for chunk in out.chunks:
        if not chunk["indexes"] or chunk["indexes"].keys() - out.channels.keys():
            for kind, body in records(unpacked(f, chunk["at"], chunk["size"])):
                if kind in (SCHEMA, CHANNEL):
                    note(out, kind, body)
    return out


def unpacked(f, at: int, size: int) -> bytes:
    """The records of the chunk at a place of a file."""
    f.seek(at + 9)
    c = Cursor(f.read(size - 9))
    c.raw(16)
    plain = c.number(8)
    c.raw(4)
    packing = c.text()
    data = c.raw(c.number(8))
    if packing == "zstd":
        return zstandard.ZstdDecompressor().decompress(data, max_output_size=plain)
    if packing == "lz4":
        return pa.Codec("lz4").decompress(data, plain, asbytes=True)
    if packing:
        raise ValueError(f"chunks packed by {packing} are not read")
    return data


def index_entries(f, at: int) -> Iterator[tuple[int, int]]:
    """(log time, offset in the chunk) of the message index at a place of a file."""
    f.seek(at)
    length = int.from_bytes(f.read(9)[1:], "little")
    c = Cursor(f.read(length))
    c.raw(2)
    end = c.number(4) + c.at
    while c.at < end:
        yield c.number(8), c.number(8)


def message(body: bytes) -> tuple[int, int, int, int, bytes]:
    """channel, log_ns, publish_ns, sequence and data of a message's record."""
    number, sequence, log, publish = struct.unpack_from("<HIQQ", body)
    return number, log, publish, sequence, body[22:]


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"], options.get("table", "messages")
        self.run_bytes = int(options.get("run_bytes", 64 << 20))
        self.topics: set[str] | None = None
        self.low, self.high = 0, (1 << 63) - 1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if self.kind in ("messages", "index", "last") and column == ("topic",) and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.topics = named if self.topics is None else self.topics & named
            elif self.kind in ("messages", "index") and column == ("log_ns",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, int(f.value))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, int(f.value))
            yield f  # whole chunks are left out; Spark still looks at rows

    def wanted(self, told: Summary) -> set[int]:
        return {k for k, v in told.channels.items() if self.topics is None or v[0] in self.topics}

    def partitions(self) -> list[InputPartition]:
        if self.kind in ("channels", "metadata", "last"):
            return ([Chunks(path) for path in members(self.path)] if self.kind == "channels" else []) or [InputPartition(None)]
        out: list[InputPartition] = []
        for path in members(self.path):
            told = summary(path)
            wanted, held, own = self.wanted(told), 0, None
            for c in sorted(told.chunks, key=lambda c: c["at"]):
                if c["high"] < self.low or c["low"] > self.high or (c["indexes"] and not wanted & c["indexes"].keys()):
                    continue
                if own is None or held + c["size"] > self.run_bytes:
                    own, held = Chunks(path), 0
                    out.append(own)
                own.chunks.append((c["at"], c["size"], c["indexes"]))
                held += c["size"]
        return out or [InputPartition(None)]  # Spark asks for one at least

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.kind == "metadata":
            yield from self.metadata()
        elif self.kind == "last":
            yield from self.last()
        elif isinstance(partition, Chunks):
            told = summary(partition.path)
            with open(partition.path, "rb") as f:
                yield from self.channels(told) if self.kind == "channels" else self.messages(f, told, partition.chunks)

    def channels(self, told: Summary) -> Iterator[tuple]:
        for number, (topic, schema, encoding) in sorted(told.channels.items()):
            yield number, topic, told.schemas.get(schema), encoding, told.counts.get(number)

    def metadata(self) -> Iterator[tuple]:
        found: dict[str, dict[str, str]] = {}
        for path in members(self.path):
            with open(path, "rb") as f:
                for at, size in summary(path).metadata:
                    f.seek(at + 9)
                    c = Cursor(f.read(size - 9))
                    name = c.text()
                    found[name] = c.pairs(c.text, c.text)
        for name, values in found.items():
            for k, v in values.items():
                yield name, k, v

    def messages(self, f, told: Summary, chunks: list[tuple[int, int, dict[int, int]]]) -> Iterator[tuple]:
        wanted = self.wanted(told)
        for at, size, indexes in chunks:
            if self.kind == "index" and indexes:
                for number in sorted(indexes.keys() & wanted):
                    for stamp, _ in index_entries(f, indexes[number]):
                        yield told.channels[number][0], number, stamp
                continue
            for kind, body in records(unpacked(f, at, size)):
                if kind == MESSAGE:
                    number, log, *rest = message(body)
                    if number in wanted:  # a chunk without indexes is read for them
                        yield (told.channels[number][0], number, log) if self.kind == "index" else (told.channels[number][0], number, log, *rest)

    def last(self) -> Iterator[tuple]:
        """Each topic's message of the latest log time, of equal ones the last written: by the indexes, so that a chunk is opened only where that message is."""
        best: dict[str, tuple[int, int, int]] = {}  # topic: time, file, chunk
        files = members(self.path)
        told = [summary(path) for path in files]
        order = sorted(((c["high"], i, k) for i, t in enumerate(told) for k, c in enumerate(t.chunks)), reverse=True)
        for high, i, k in order:
            with open(files[i], "rb") as f:
                chunk, wanted = told[i].chunks[k], self.wanted(told[i])
                for number in sorted((chunk["indexes"].keys() or wanted) & wanted):
                    topic = told[i].channels[number][0]
                    if topic in best and best[topic][0] > high:
                        continue
                    if chunk["indexes"]:
                        latest = max((t for t, _ in index_entries(f, chunk["indexes"][number])), default=None)
                    else:
                        latest = max((m[1] for kind, body in records(unpacked(f, chunk["at"], chunk["size"])) if kind == MESSAGE and (m := message(body))[0] == number), default=None)
                    if latest is not None and (topic not in best or (latest, i, k) > best[topic]):
                        best[topic] = (latest, i, k)
        for topic, (stamp, i, k) in sorted(best.items()):
            with open(files[i], "rb") as f:
                own = [m for kind, body in records(unpacked(f, told[i].chunks[k]["at"], told[i].chunks[k]["size"])) if kind == MESSAGE and (m := message(body))[1] == stamp and told[i].channels[m[0]][0] == topic]
            yield (topic, *own[-1])


class LogWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], columns: list[str], overwrite: bool):
        self.out = SharedOutput(options["path"], overwrite, ".mcap")
        self.packing, self.chunk_bytes = options.get("packing", "zstd"), int(options.get("chunk_bytes", 4 << 20))
        if missing := {"topic", "log_ns", "data"} - set(columns):
            raise ValueError(f"a message log needs the columns {', '.join(sorted(missing))}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from .container_file import ContainerFile

        path, log = None, None
        for batch in iterator:
            names = batch.schema.names
            of = {c: batch.column(c).to_pylist() if c in names else [None] * batch.num_rows for c in ("topic", "log_ns", "publish_ns", "sequence", "schema", "encoding", "data")}
            for topic, stamp, publish, sequence, schema, encoding, data in zip(*of.values(), strict=True):
                if log is None:
                    path = self.out.new_file()
                    log = ContainerFile(open(path, "wb"), self.packing, self.chunk_bytes)  # noqa: SIM115
                if topic is None or stamp is None:
                    raise ValueError("a message needs a topic and a log time")
                channel = log.channel(topic, schema or "", encoding or "cdr")
                log.add(channel, stamp, stamp if publish is None else publish, sequence or 0, data or b"")
        if log is None:
            return Written()
        told = log.close()
        log.out.close()
        return Written([(os.path.basename(path), told)])

    def commit(self, messages) -> None:
        self.out.commit(messages)

    def abort(self, messages) -> None:
        self.out.abort()


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "messagelog"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "messages")]

    def reader(self, schema) -> LogReader:
        return LogReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(dict(self.options), schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MessageLog)
