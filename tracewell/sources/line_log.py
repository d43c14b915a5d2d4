"""Appended text logs as a streaming source: spark.readStream.format("linelog").option("path", ...).

path is a file, or a folder of files that are written one after another in the order of their names, as daily logs are. Rows are (file, at, line): the
byte where a line begins, and its text. A position is a file and a byte, kept with the query's checkpoint, so a query that is started again
reads on where it was. Only lines that have ended are read; the rest waits. Options: start "now" leaves out what there is when a query first
starts; run_bytes, what one task reads; keep, if set, how many files that are wholly read stay, the newest: older ones are removed once
a batch is committed. The files must be readable where tasks run.
"""

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


@dataclass
class Lines(InputPartition):
    """Lines that begin in low <= byte < high of a file."""

    path: str
    low: int
    high: int


def ended(path: str) -> int:
    """The byte after the file's last line end."""
    with open(path, "rb") as f:
        at = f.seek(0, 2)
        while at > 0:
            low = max(0, at - (1 << 16))
            f.seek(low)
            place = f.read(at - low).rfind(b"\n")
            if place >= 0:
                return low + place + 1
            at = low
    return 0


class LineLogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.start = options["path"], options.get("start", "first")
        self.run_bytes = int(options.get("run_bytes", 32 << 20))
        self.keep = int(options["keep"]) if "keep" in options else None

    def files(self) -> list[str]:
        """Names in order; of a single file its own."""
        if os.path.isdir(self.path):
            return sorted(x for x in os.listdir(self.path) if not x.startswith((".", "_")) and os.path.isfile(os.path.join(self.path, x)))
        return [""] if os.path.exists(self.path) else []

    def place(self, name: str) -> str:
        return os.path.join(self.path, name) if name else self.path

    def end(self) -> dict:
        files = self.files()
        return {"file": files[-1], "byte": ended(self.place(files[-1]))} if files else {"file": "", "byte": 0}

    def initialOffset(self) -> dict:  # noqa: N802
        return self.end() if self.start == "now" else {"file": "", "byte": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return self.end()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for name in self.files():
            if start["file"] <= name <= end["file"]:
                low = start["byte"] if name == start["file"] else 0
                high = end["byte"] if name == end["file"] else os.path.getsize(self.place(name))
                out += [Lines(self.place(name), at, min(at + self.run_bytes, high)) for at in range(low, high, self.run_bytes)]
        return out

    def read(self, partition: Lines) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            at = partition.low
            if at > 0:  # a line that began before belongs to the run before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.high:
                line = f.readline()
                if not line:
                    break
                yield os.path.basename(partition.path), at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        if self.keep is not None:
            read = [name for name in self.files() if name and name < end["file"]]
            for name in read[: max(0, len(read) - self.keep)]:
                os.unlink(self.place(name))


class LineLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "linelog"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema) -> LineLogReader:  # noqa: N802
        return LineLogReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineLog)
