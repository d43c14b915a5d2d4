"""Greedy throttling of streams: a row stays if it is at least so long after the last one that stayed.

A range of a stream can't know the last row kept before it. But that row leaves only a time from which rows are due, and this lies
within one interval of the range's first row. So a range tells, for every row that may be its first to stay, the last one
that stays (rows in a row with the same end are one entry), and walking these tables range by range gives each its start: two passes
over the rows and no task for a stream. A range with more than ENTRIES of them is run when its start is known.
"""

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .folds import Step, flagged, runs, swept
from .ranges import PART, ranged

#: Entries of a table that a range sends at most.
ENTRIES = 4096
HEAD = "part int, first binary, last binary, state binary, due array<long>, end array<long>"
HEAD_SCHEMA = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("first", "last", "state")], *[(c, pa.list_(pa.int64())) for c in ("due", "end")]])


def apart(ts: str, least: int) -> Step:
    """Keeps a row if it is at least `least` after the last one kept; a stream's first is kept. A row without a time is not."""

    def step(_, state: int | None, rows: pa.RecordBatch) -> tuple[int | None, np.ndarray]:
        times = times_of(rows, ts)
        flags, skipped = np.zeros(rows.num_rows, bool), rows.num_rows - len(times)
        at = 0 if state is None else int(np.searchsorted(times, state + least))
        while at < len(times):
            flags[skipped + at] = True
            state = int(times[at])
            at = max(at + 1, int(np.searchsorted(times, state + least)))
        return state, flags

    return step


def times_of(rows: pa.RecordBatch, ts: str) -> np.ndarray:
    """Times of sorted rows without the null ones, which come first."""
    column = rows.column(ts)
    return column.slice(column.null_count).to_numpy()


def ends(times: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(due, end): if rows are due from a time up to due, and after the due before, the last row that stays is at end. None if there are too many."""
    n = len(times)
    after = np.maximum(np.searchsorted(times, times + least), np.arange(n) + 1)
    last = np.where(after < n, after, np.arange(n))
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further
    first = min(n, int(np.searchsorted(times, times[0] + least)) + 1) if n else 0
    due, end = times[:first], times[last[:first]]
    own = np.append(end[1:] != end[:-1], True)[:first]
    return (due[own], end[own]) if np.count_nonzero(own) <= most else None


def starts(at: DataFrame, stream: str, ts: str, least: int, entries: int = ENTRIES) -> tuple[dict[int, bytes], int]:
    """The last row kept before each range, of its first stream; and the ranges that had to be run for it."""

    def run(batches):
        part = first = last = state = None
        step, times = apart(ts, least), []
        for batch in batches:
            for key, rows in runs(batch, stream):
                if part is None:
                    part, first = batch.column(PART)[0].as_py(), (key,)
                elif (key,) != last:
                    state = None
                last = (key,)
                if last == first:
                    times.append(times_of(rows, ts))
                state, _ = step(key, state, rows)
        if part is not None:
            table = ends(np.concatenate(times), least, entries) if first == last else None
            values = (part, *map(pickle.dumps, (first, last, state)), *(x.tolist() for x in table)) if table else (part, *map(pickle.dumps, (first, last, state)), None, None)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, HEAD_SCHEMA.types, strict=True)], schema=HEAD_SCHEMA)

    incoming, ran, before = {}, 0, None
    for head in sorted(at.mapInArrow(run, HEAD).toArrow().to_pylist(), key=lambda x: x["part"]):
        state = pickle.loads(head["state"])
        if before and before[0] == head["first"]:
            incoming[head["part"]] = pickle.dumps(before[1])
            if head["first"] == head["last"] and before[1] is not None:
                if head["due"] is None:
                    state, ran = pickle.loads(swept(at, stream, apart(ts, least), incoming, {head["part"]})[0].state), ran + 1
                else:
                    i = int(np.searchsorted(head["due"], before[1] + least))
                    state = head["end"][i] if i < len(head["due"]) else before[1]
        before = (head["last"], state)
    return incoming, ran


def republished(rows: DataFrame, stream: str, ts: str, every: int, ties: list[str], flag: str = "emits", parts: int | None = None) -> DataFrame:
    """All rows, flagged where something that must be told again is sent along: at a stream's first row and once `every` has passed since.

    Rows of equal time come in the order of ties, and the first is flagged; rows without a time are not. Null keys are a stream.
    """
    at = ranged(rows, [stream], [ts, *ties], parts)
    return flagged(at, stream, apart(ts, every), starts(at, stream, ts, every)[0], flag)


def throttled(rows: DataFrame, stream: str, ts: str, least: int, ties: list[str], parts: int | None = None) -> DataFrame:
    """Rows at least `least` after the last of their stream that stayed; its first stays. Rows without a time go."""
    return republished(rows, stream, ts, least, ties, "__kept", parts).filter("__kept").drop("__kept")
