"""Message logs rewritten chunk by chunk: what a change does not touch is passed on as bytes.

The plan comes from the index of chunks alone: a chunk is kept as it is, left out, or opened. Runs of chunks are tasks; each writes a log
of its own into one folder, and the folder's manifest makes them count together.
"""

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import container as C
from .container_file import ContainerFile
from .shared_output import SharedOutput, Written, members

TOLD = "file string, source string, chunks_passed long, chunks_opened long, chunks_dropped long, bytes_read long, bytes_opened long, messages long, low long, high long"
PASS, OPEN, DROP = "pass", "open", "drop"


@dataclass
class Change:
    """Messages to keep: those of topics other than dropped, with low <= log_ns < high."""

    dropped: frozenset[str] = frozenset()
    low: int = 0
    high: int = 1 << 63

    def of_chunk(self, chunk: dict, told: C.Summary) -> str:
        topics = {told.channels[n][0] for n in chunk["indexes"]}
        if chunk["high"] < self.low or chunk["low"] >= self.high or (topics and topics <= self.dropped):
            return DROP
        inside = chunk["low"] >= self.low and chunk["high"] < self.high
        return PASS if inside and topics and not topics & self.dropped else OPEN

    def keeps(self, topic: str, log_ns: int) -> bool:
        return topic not in self.dropped and self.low <= log_ns < self.high


def plan(path: str, change: Change, run_bytes: int) -> list[tuple[str, list[tuple[str, dict]]]]:
    """(file, [(what to do, chunk)]) of each task; no chunk is read."""
    out = []
    for file in members(path):
        told, run, held = C.summary(file), [], 0
        for chunk in sorted(told.chunks, key=lambda c: c["at"]):
            run.append((change.of_chunk(chunk, told), chunk))
            held += chunk["size"] if run[-1][0] != DROP else 0
            if held >= run_bytes:
                out.append((file, run))
                run, held = [], 0
        if run:
            out.append((file, run))
    return out


def rewritten(file: str, run: list[tuple[str, dict]], change: Change, target: str) -> dict:
    """Writes the log of one run; what was done."""
    told = C.summary(file)
    done = {"chunks_passed": 0, "chunks_opened": 0, "chunks_dropped": 0, "bytes_read": 0, "bytes_opened": 0}
    with open(file, "rb") as f, open(target, "wb") as out:
        log = ContainerFile(out)
        for number, (topic, schema, encoding) in sorted(told.channels.items()):
            if topic not in change.dropped:
                log.channel(topic, told.schemas.get(schema, ""), encoding, number=number, schema_number=schema or None)
        for what, chunk in run:
            if what == DROP:
                done["chunks_dropped"] += 1
                continue
            done["bytes_read"] += chunk["size"]
            if what == PASS:
                done["chunks_passed"] += 1
                log.flush()
                places = {n: list(C.index_entries(f, at)) for n, at in chunk["indexes"].items()}
                f.seek(chunk["at"])
                raw = f.read(chunk["size"])
                c = C.Cursor(raw[9:])
                c.raw(16)
                plain = c.number(8)
                c.raw(4)
                packing = c.text()
                log.whole_chunk(raw, chunk["low"], chunk["high"], places, packing, c.number(8), plain)
                continue
            done["chunks_opened"] += 1
            done["bytes_opened"] += chunk["size"]
            for kind, body in C.records(C.unpacked(f, chunk["at"], chunk["size"])):
                if kind == C.MESSAGE:
                    number, log_ns, publish_ns, sequence, data = C.message(body)
                    if change.keeps(told.channels[number][0], log_ns):
                        log.add(number, log_ns, publish_ns, sequence, data)
            log.flush()
        return done | log.close()


def rewrite(spark: SparkSession, path: str, target: str, change: Change, run_bytes: int = 64 << 20) -> DataFrame:
    """A folder of logs with what change keeps of path, and what each task did: chunks passed on, opened and left out, bytes read and opened.

    Files appear once all tasks have ended; if one fails, none does. Rows of metadata are not carried over.
    """
    import pickle

    out = SharedOutput(target, True, ".mcap")
    runs = [(i, pickle.dumps(x)) for i, x in enumerate(plan(path, change, run_bytes))]
    tasks = spark.createDataFrame(runs, "i int, run binary").repartition(max(1, len(runs)), "i")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column("run").to_pylist():
                file, chunks = pickle.loads(run)
                place = out.new_file()
                told = {"file": os.path.basename(place), "source": file} | rewritten(file, chunks, change, place)
                yield pa.RecordBatch.from_pylist([told], schema=SCHEMA)

    try:
        done = tasks.mapInArrow(work, TOLD).toArrow().to_pylist() if runs else []  # a row for each task
    except Exception:
        out.abort()
        raise
    out.commit([Written([(x["file"], {k: x[k] for k in ("messages", "low", "high")}) for x in done if x["messages"]])])
    return spark.createDataFrame([tuple(x.values()) for x in done], TOLD)


SCHEMA = pa.schema([("file", pa.string()), ("source", pa.string()), *[(c.split()[0], pa.int64()) for c in TOLD.split(", ")[2:]]])


def without_topics(spark: SparkSession, path: str, target: str, topics: list[str], **options) -> DataFrame:
    return rewrite(spark, path, target, Change(dropped=frozenset(topics)), **options)


def head_and_tail(spark: SparkSession, path: str, head: str, tail: str, at_ns: int, **options) -> tuple[DataFrame, DataFrame]:
    """Two folders: messages before a time, and from it on. Only chunks that the time cuts are opened."""
    return rewrite(spark, path, head, Change(high=at_ns), **options), rewrite(spark, path, tail, Change(low=at_ns), **options)
