"""Writing one message log file, by the public format: chunks with their indexes, statistics, a summary and a footer."""

import struct
import zlib
from typing import BinaryIO

import zstandard

from . import container as C

HEADER, DATA_END = 1, 15
CHUNK_BYTES = 4 << 20


def text(value: str) -> bytes:
    data = value.encode()
    return struct.pack("<I", len(data)) + data


def record(kind: int, body: bytes) -> bytes:
    return struct.pack("<BQ", kind, len(body)) + body


def mapped(entries: bytes) -> bytes:
    return struct.pack("<I", len(entries)) + entries


class ContainerFile:
    """A message log that grows: add() messages or whole chunks of another log, then close(). Memory holds one chunk and the index."""

    def __init__(self, out: BinaryIO, packing: str = "zstd", chunk_bytes: int = CHUNK_BYTES):
        self.out, self.packing, self.chunk_bytes = out, packing, chunk_bytes
        self.at = 0
        self.schemas: dict[tuple[str, str, bytes], int] = {}
        self.channels: dict[tuple, int] = {}
        self.records: dict[int, bytes] = {}  # a channel's records: of its schema and its own
        self.counts: dict[int, int] = {}
        self.indexes: list[bytes] = []
        self.metadata: list[bytes] = []
        self.low, self.high, self.chunks, self.named = None, 0, 0, 0
        self.open: bytearray = bytearray()
        self.places: dict[int, list[tuple[int, int]]] = {}
        self.told: set[int] = set()  # channels that this file's chunks have told of
        self.put(C.MAGIC + record(HEADER, text("") + text("")))

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def channel(self, topic: str, schema: str, encoding: str = "cdr", schema_encoding: str = "ros2msg", definition: bytes = b"", number: int | None = None, schema_number: int | None = None) -> int:
        """The number of a channel; a new one, or number, if the file has none such yet."""
        key = (topic, schema, encoding, number)
        if key not in self.channels:
            kind = (schema, schema_encoding, definition)
            of = self.schemas.setdefault(kind, schema_number or len(self.schemas) + 1)
            number = number if number is not None else max(self.channels.values(), default=0) + 1
            self.channels[key] = number
            self.records[number] = record(C.SCHEMA, struct.pack("<H", of) + text(schema) + text(schema_encoding) + struct.pack("<I", len(definition)) + definition)
            self.records[number] += record(C.CHANNEL, struct.pack("<HH", number, of) + text(topic) + text(encoding) + mapped(b""))
        return self.channels[key]

    def add(self, channel: int, log_ns: int, publish_ns: int, sequence: int, data: bytes) -> None:
        if channel not in self.told:
            self.told.add(channel)
            self.open += self.records[channel]
        self.places.setdefault(channel, []).append((log_ns, len(self.open)))
        self.open += record(C.MESSAGE, struct.pack("<HIQQ", channel, sequence, log_ns, publish_ns) + data)
        if len(self.open) >= self.chunk_bytes:
            self.flush()

    def flush(self) -> None:
        """Ends the chunk at hand."""
        if not self.places:
            return
        data = bytes(self.open)
        packed = zstandard.ZstdCompressor().compress(data) if self.packing == "zstd" else data
        stamps = [t for places in self.places.values() for t, _ in places]
        body = struct.pack("<QQQI", min(stamps), max(stamps), len(data), zlib.crc32(data)) + text(self.packing) + struct.pack("<Q", len(packed)) + packed
        places = {n: sorted(p) for n, p in self.places.items()}
        self.whole_chunk(record(C.CHUNK, body), min(stamps), max(stamps), places, self.packing, len(packed), len(data))
        self.open, self.places = bytearray(), {}

    def whole_chunk(self, chunk: bytes, low: int, high: int, places: dict[int, list[tuple[int, int]]], packing: str, packed: int, plain: int) -> None:
        """A chunk record as it is, with (time, offset in the chunk) of its messages by channel."""
        at = self.at
        self.put(chunk)
        offsets = b""
        for number, entries in sorted(places.items()):
            offsets += struct.pack("<HQ", number, self.at)
            rows = b"".join(struct.pack("<QQ", *e) for e in entries)
            self.put(record(C.MESSAGE_INDEX, struct.pack("<H", number) + mapped(rows)))
            self.counts[number] = self.counts.get(number, 0) + len(entries)
        length = self.at - at - len(chunk)
        self.indexes.append(record(C.CHUNK_INDEX, struct.pack("<QQQQ", low, high, at, len(chunk)) + mapped(offsets) + struct.pack("<Q", length) + text(packing) + struct.pack("<QQ", packed, plain)))
        self.low, self.high, self.chunks = low if self.low is None else min(self.low, low), max(self.high, high), self.chunks + 1

    def add_metadata(self, name: str, values: dict[str, str]) -> None:
        self.flush()
        data = record(C.METADATA, text(name) + mapped(b"".join(text(k) + text(v) for k, v in values.items())))
        self.metadata.append(record(C.METADATA_INDEX, struct.pack("<QQ", self.at, len(data)) + text(name)))
        self.put(data)

    def close(self) -> dict:
        """Ends the file; what a manifest tells of it."""
        self.flush()
        self.put(record(DATA_END, struct.pack("<I", 0)))
        start = self.at
        counts = b"".join(struct.pack("<HQ", *x) for x in sorted(self.counts.items()))
        total = sum(self.counts.values())
        stats = struct.pack("<QHIIIIQQ", total, len(self.schemas), len(self.records), 0, len(self.metadata), self.chunks, self.low or 0, self.high) + mapped(counts)
        summary = b"".join(self.records.values()) + b"".join(self.indexes) + record(C.STATISTICS, stats) + b"".join(self.metadata)
        footer = struct.pack("<BQQQ", C.FOOTER, 20, start, 0)
        self.put(summary + footer + struct.pack("<I", zlib.crc32(summary + footer)) + C.MAGIC)
        return {"messages": total, "low": self.low, "high": self.high}
