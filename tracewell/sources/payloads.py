"""Messages' payloads as columns: transforms, odometry and point clouds of a log, and the record files of a run.

A layout names a message's fields in order. Where they lie depends only on the texts and counts in the message, so one message of each
shape is laid out field by field, and all that agree with it in length and in the bytes of texts and counts are read at once, as numpy views of
one matrix. Payloads are CDR, either byte order, perhaps inside an LZ4 frame. One that is cut short, or no such message, gives no
row; told() counts them.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LZ4_MAGIC = b"\x04\x22\x4d\x18"
#: numpy's names of the format's number types, by the code that a cloud's field has.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}
STAMP = [("sec", "i4"), ("nsec", "u4")]
POSE = ["x", "y", "z", "qx", "qy", "qz", "qw"]
TWIST = ["vx", "vy", "vz", "wx", "wy", "wz"]
TRANSFORM = [*STAMP, ("parent", "text"), ("child", "text"), *[(p, "f8") for p in POSE]]
ODOMETRY = [*STAMP, ("frame", "text"), ("child", "text"), *[(p, "f8") for p in POSE], ("pose_cov", "f8*36"), *[(t, "f8") for t in TWIST], ("twist_cov", "f8*36")]
FIELD = [("name", "text"), ("offset", "u4"), ("datatype", "u1"), ("count", "u4")]
CLOUD = [*STAMP, ("frame", "text"), ("height", "u4"), ("width", "u4"), ("fields", FIELD), ("bigendian", "u1"), ("point_step", "u4"), ("row_step", "u4"), ("data", "bytes"), ("dense", "u1")]
TRANSFORMS = [("transforms", TRANSFORM)]


def plain(data: bytes | None) -> bytes:
    """The payload itself, if it is an LZ4 frame."""
    if data and data[:4] == LZ4_MAGIC:
        with pa.CompressedInputStream(pa.BufferReader(data), "lz4") as f:
            return f.read()
    return data or b""


class Shape:
    """Where the fields of one message lie; others of its length with the same bytes at fixed are of the same shape."""

    def __init__(self, layout: list, data: bytes):
        if len(data) < 4 or data[0] != 0 or data[1] > 1:
            raise ValueError("not CDR")
        self.order = "<" if data[1] == 1 else ">"
        self.data, self.at = data, 4
        self.fixed: list[np.ndarray] = [np.arange(4)]
        #: (name, numpy type, place, how many) of numbers; texts and bytes by value and place.
        self.values = self.fields(layout)
        if self.at > len(data):
            raise ValueError("cut short")
        self.same = np.concatenate(self.fixed)
        self.template = np.frombuffer(data, np.uint8)[self.same]

    def place(self, size: int, n: int = 1) -> int:
        """Places of n numbers of a size, aligned by it from the end of the header."""
        self.at += -(self.at - 4) % size
        at = self.at
        self.at += size * n
        if self.at > len(self.data):
            raise ValueError("cut short")
        return at

    def count(self) -> int:
        at = self.place(4)
        self.fixed.append(np.arange(at, at + 4))
        return int(np.frombuffer(self.data, f"{self.order}u4", 1, at)[0])

    def fields(self, layout: list) -> dict:
        out = {}
        for name, kind in layout:
            if isinstance(kind, list):
                n = self.count()
                if n > len(self.data):
                    raise ValueError("cut short")
                out[name] = [self.fields(kind) for _ in range(n)]
            elif kind in ("text", "bytes"):
                n = self.count()
                at = self.place(1, n)
                if kind == "text":
                    self.fixed.append(np.arange(at, at + n))
                    out[name] = self.data[at : at + n].rstrip(b"\0").decode("utf-8", "replace")
                else:
                    out[name] = (at, n)
            else:
                base, _, n = kind.partition("*")
                size = int(base[1:])
                out[name] = (base, self.place(size, int(n or 1)), int(n or 1))
                if layout is FIELD:
                    self.fixed.append(np.arange(out[name][1], out[name][1] + size))
        return out

    def numbers(self, rows: np.ndarray, field: tuple) -> np.ndarray:
        """A field of all rows of this shape: one column for each of its numbers."""
        base, at, n = field
        return np.ascontiguousarray(rows[:, at : at + int(base[1:]) * n]).view(f"{self.order}{base}").reshape(len(rows), n).astype(f"={base}")


def shaped(payloads: list[bytes], layout: list) -> Iterator[tuple[Shape, np.ndarray, np.ndarray]]:
    """(shape, which payloads, their bytes as a matrix) for each shape there is."""
    sizes = np.array([len(p) for p in payloads])
    for size in np.unique(sizes):
        left = np.flatnonzero(sizes == size)
        rows = np.frombuffer(b"".join(payloads[i] for i in left), np.uint8).reshape(len(left), size)
        while len(left):
            try:
                shape = Shape(layout, payloads[left[0]])
            except ValueError:
                rows, left = rows[1:], left[1:]
                continue
            same = (rows[:, shape.same] == shape.template).all(axis=1)
            yield shape, left[same], rows[same]
            rows, left = rows[~same], left[~same]


def stamps(shape: Shape, rows: np.ndarray, at: dict) -> np.ndarray:
    return shape.numbers(rows, at["sec"])[:, 0].astype(np.int64) * 1_000_000_000 + shape.numbers(rows, at["nsec"])[:, 0].astype(np.int64)


def decoded(messages: DataFrame, layout: list, rows_of: Callable[[Shape, np.ndarray], Iterator[dict[str, np.ndarray | str]]], columns: str) -> DataFrame:
    """messages' columns but data, with the columns that rows_of makes of each shape's messages: arrays of one value or row of values for each message."""
    kept = [c for c in messages.columns if c != "data"]
    types = ", ".join(f"`{c}` {messages.schema[c].dataType.simpleString()}" for c in kept) + ", " + columns
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        for batch in batches:
            payloads = [plain(p) for p in batch.column("data").to_pylist()]
            own = batch.select(kept)
            for shape, which, rows in shaped(payloads, layout):
                for part in rows_of(shape, rows):
                    index = part.pop("__message", None)
                    index = np.arange(len(which)) if index is None else index
                    if len(index):
                        given = [pa.array([part[n]] * len(index)) if isinstance(part[n], str) else pa.array(part[n]) for n in names]
                        taken = own.take(pa.array(which[index]))
                        yield pa.RecordBatch.from_arrays([*taken.columns, *given], names=[*kept, *names])

    return messages.select(*kept, "data").mapInArrow(run, types)


def transforms(messages: DataFrame) -> DataFrame:
    """(…, i, stamp_ns, parent, child, pose): each transform of each message, numbered from 0."""

    def rows(shape: Shape, m: np.ndarray):
        for i, at in enumerate(shape.values["transforms"]):
            pose = {p: shape.numbers(m, at[p])[:, 0] for p in POSE}
            yield {"i": np.full(len(m), i, np.int32), "stamp_ns": stamps(shape, m, at), "parent": at["parent"], "child": at["child"], **pose}

    return decoded(messages, TRANSFORMS, rows, "i int, stamp_ns long, parent string, child string, " + ", ".join(f"{p} double" for p in POSE))


def odometry(messages: DataFrame) -> DataFrame:
    """(…, stamp_ns, frame, child, pose, twist) of each message."""

    def rows(shape: Shape, m: np.ndarray):
        at = shape.values
        yield {"stamp_ns": stamps(shape, m, at), "frame": at["frame"], "child": at["child"], **{p: shape.numbers(m, at[p])[:, 0] for p in (*POSE, *TWIST)}}

    return decoded(messages, ODOMETRY, rows, "stamp_ns long, frame string, child string, " + ", ".join(f"{p} double" for p in (*POSE, *TWIST)))


def points(messages: DataFrame) -> DataFrame:
    """(…, stamp_ns, frame, i, x, y, z, intensity) of each finite point of each cloud; a cloud without x, y or z has none, intensity is null where a cloud has none."""

    def rows(shape: Shape, m: np.ndarray):
        at = shape.values
        fields = {f["name"]: f for f in at["fields"]}
        if not {"x", "y", "z"} <= fields.keys():
            return
        start, size = at["data"]
        # what is told once for each message, and may differ
        heads = np.column_stack([shape.numbers(m, at[c])[:, 0].astype(np.int64) for c in ("point_step", "bigendian", "height", "width", "row_step")])
        for head in np.unique(heads, axis=0):
            step, big, height, width, row_step = head.tolist()
            which = np.flatnonzero((heads == head).all(axis=1))
            if step <= 0 or height * width == 0:
                continue
            grid = m[which][:, start : start + size]
            if height > 1 and row_step > width * step:  # rows end in padding
                grid = grid[:, : row_step * height].reshape(len(which), height, row_step)[:, :, : width * step].reshape(len(which), -1)
            n = min(height * width, grid.shape[1] // step)
            cells = np.ascontiguousarray(grid[:, : n * step]).reshape(len(which) * n, step)
            found = {}
            for name in ("x", "y", "z", "intensity"):
                if name in fields:
                    kind = NUMBERS.get(int(shape.numbers(m[:1], fields[name]["datatype"])[0, 0]))
                    offset = int(shape.numbers(m[:1], fields[name]["offset"])[0, 0])
                    if kind and offset + int(kind[1:]) <= step:
                        found[name] = np.ascontiguousarray(cells[:, offset : offset + int(kind[1:])]).view(f"{'>' if big else '<'}{kind}")[:, 0].astype(np.float64)
            if not {"x", "y", "z"} <= found.keys():
                continue
            good = np.isfinite(found["x"]) & np.isfinite(found["y"]) & np.isfinite(found["z"])
            index = np.repeat(which, n)[good]
            intensity = found["intensity"][good] if "intensity" in found else pa.nulls(len(index), pa.float64())
            yield {"__message": index, "stamp_ns": stamps(shape, m, at)[index], "frame": at["frame"], "i": np.tile(np.arange(n, dtype=np.int32), len(which))[good], **{c: found[c][good] for c in "xyz"}, "intensity": intensity}

    return decoded(messages, CLOUD, rows, "stamp_ns long, frame string, i int, x double, y double, z double, intensity double")


def told(messages: DataFrame, layout: list, by: str = "topic") -> DataFrame:
    """(by, n, bad): messages, and those that are not of the layout."""

    def run(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for _, which, _ in shaped([plain(p) for p in batch.column("data").to_pylist()], layout):
                good[which] = True
            yield pa.RecordBatch.from_arrays([batch.column(by), pa.array(good)], names=[by, "good"])

    kind = messages.schema[by].dataType.simpleString()
    return messages.select(by, "data").mapInArrow(run, f"`{by}` {kind}, good boolean").groupBy(by).agg(F.count("*").alias("n"), F.count_if(~F.col("good")).alias("bad"))


def encoded_transforms(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, data): one message for each key of rows (keys, i, stamp_ns, parent, child, pose), its transforms by i; a row whose child is null adds none, so a message may be empty."""
    named = ["i", "stamp_ns", "parent", "child", *POSE]
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("child").isNotNull(), F.struct(*named)))).alias("edges"))
    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def text(value: str, out: bytearray) -> None:
        out.extend(bytes(-(len(out) - 4) % 4))
        data = value.encode() + b"\0"
        out += len(data).to_bytes(4, "little") + data

    def run(batches):
        for batch in batches:
            made = []
            for edges in batch.column("edges").to_pylist():
                out = bytearray(b"\0\1\0\0" + len(edges).to_bytes(4, "little"))
                for e in edges:
                    out.extend(bytes(-(len(out) - 4) % 4))
                    seconds, rest = divmod(e["stamp_ns"], 1_000_000_000)
                    out += seconds.to_bytes(4, "little", signed=True) + rest.to_bytes(4, "little")
                    text(e["parent"], out)
                    text(e["child"], out)
                    out.extend(bytes(-(len(out) - 4) % 8))
                    out += np.array([e[p] for p in POSE], "<f8").tobytes()
                made.append(bytes(out))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(made, pa.binary())], names=[*keys, "data"])

    return grouped.mapInArrow(run, f"{types}, data binary")


#: Record files of a run, by the formats' names for their numbers.
KEYFRAME = np.dtype([("ts", "<f8"), *[(f"raw_{p}", "<f8") for p in POSE], *[(f"corrected_{p}", "<f8") for p in POSE]])
STATE_HEAD = np.dtype([("ts", "<f8"), ("n", "<u4")])
STATE = np.dtype([(p, "<f4") for p in "xyz"] + [("id", "<u4"), ("ts", "<f8")] + [(f"q{p}", "<f4") for p in "xyzw"] + [(f"dt_{p}", "<f4") for p in "xyz"] + [(f"dq_{p}", "<f4") for p in "xyzw"])
EDGE = np.dtype([(p, "<f4") for p in "xyz"] + [(f"target_{p}", "<f4") for p in "xyz"] + [("source_id", "<u4"), ("target_id", "<u4"), ("state", "<u4"), ("confidence", "<f4"), ("yank_z", "<f4"), ("ts", "<f8")])
SQL = {"f": "double", "u": "long"}


def typed(kind: np.dtype) -> str:
    return ", ".join(f"`{n}` {SQL[kind[n].kind]}" for n in kind.names)


def arrays(table: np.ndarray) -> list[pa.Array]:
    return [pa.array(table[n].astype(np.float64 if table.dtype[n].kind == "f" else np.int64)) for n in table.dtype.names]


def record_files(files: DataFrame, kind: np.dtype) -> DataFrame:
    """(path, i, fields) of the records of files (path, content), as spark.read.format("binaryFile") gives them; a last record that was cut off is left out."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                table = np.frombuffer(content, kind, len(content) // kind.itemsize)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(table)), pa.array(np.arange(len(table))), *arrays(table)], names=["path", "i", *kind.names])

    return files.select("path", "content").mapInArrow(run, f"path string, i long, {typed(kind)}")


def state_files(files: DataFrame) -> DataFrame:
    """(path, state, state_ts, fields) of framed state files: each frame tells its time and how many records follow. A last frame that was cut off is left out."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at, heads, parts = 0, [], []
                while at + STATE_HEAD.itemsize <= len(content):
                    ts, n = np.frombuffer(content, STATE_HEAD, 1, at)[0].tolist()
                    at += STATE_HEAD.itemsize
                    if at + n * STATE.itemsize > len(content):
                        break
                    heads.append((ts, n))
                    parts.append(np.frombuffer(content, STATE, n, at))
                    at += n * STATE.itemsize
                table, sizes = np.concatenate([np.zeros(0, STATE), *parts]), [n for _, n in heads]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(table), pa.string()), pa.array(np.repeat(np.arange(len(heads)), sizes).astype(np.int64)), pa.array(np.repeat([t for t, _ in heads], sizes).astype(np.float64)), *arrays(table)],
                    names=["path", "state", "state_ts", *STATE.names],
                )

    return files.select("path", "content").mapInArrow(run, f"path string, state long, state_ts double, {typed(STATE)}")
