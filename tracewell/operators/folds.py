"""Sequential folds over ordered streams, in ranges that run at once.

What a fold does with a row may depend on any row before it, so it can't be a window. But folds that thin a stream soon forget
where they began: two that start apart meet at a row both keep. So all ranges of (stream, order) first run as if each began its
stream; then those whose state at the start turns out to be another run again from that, until no range learns anything new. The result is that
of one loop over the stream, whatever the fold; how many rounds it takes is how many ranges long the fold remembers. One that never
forgets is handed from range to range, each run a bounded number of times. A border between ranges cuts one stream at most, so
what the driver holds is one state for each range.

A range streams its rows: a task holds one batch, and the state.
"""

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .ranges import PART, ranged

#: Rounds after which a range waits until the one before it is settled.
GUESSES = 4
HEAD = "part int, first binary, last binary, state binary, tally binary"
HEAD_SCHEMA = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("first", "last", "state", "tally")]])
#: step(key, state, rows): the state after rows of one stream, and flags of the rows that it keeps. The state before a stream's first row is None.
Step = Callable[[Any, Any, pa.RecordBatch], tuple[Any, np.ndarray]]
#: tally(before, rows, flags): what is known of a stream's rows in one range, and these rows, together. Before the first it is None.
Tally = Callable[[Any, pa.RecordBatch, np.ndarray], Any]


def runs(batch: pa.RecordBatch, stream: str) -> Iterator[tuple[Any, pa.RecordBatch]]:
    """(key, rows) of each stream in a sorted batch."""
    if batch.num_rows:
        keys = pc.run_end_encode(batch.column(stream))
        lo = 0
        for hi, key in zip(keys.run_ends.to_pylist(), keys.values.to_pylist(), strict=True):
            yield key, batch.slice(lo, hi - lo)
            lo = hi


@dataclass
class Head:
    """What a range has found: its first and last key, the state after it, and the tallies of these two keys (one, if they are one)."""

    part: int
    first: bytes
    last: bytes
    state: bytes
    tally: bytes

    def tallies(self) -> dict[Any, Any]:
        return pickle.loads(self.tally)


def swept(at: DataFrame, stream: str, step: Step, incoming: dict[int, bytes], only: set[int] | None = None, tally: Tally | None = None) -> list[Head]:
    """The heads of the ranges that only names, or all, each going on from its incoming state."""

    def run(batches):
        part = first = last = state = None
        found = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part = batch.column(PART)[0].as_py()
                if only is not None and part not in only:
                    return
            for key, rows in runs(batch, stream):
                if first is None:
                    first, last = (key,), (key,)
                    state = pickle.loads(incoming[part]) if part in incoming else None
                elif key != last[0]:
                    found = {k: v for k, v in found.items() if k == first[0]}
                    last, state = (key,), None
                state, flags = step(key, state, rows)
                if tally is not None:
                    found[key] = tally(found.get(key), rows, flags)
        if first is not None:
            values = (part, *map(pickle.dumps, (first, last, state, found)))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, HEAD_SCHEMA.types, strict=True)], schema=HEAD_SCHEMA)

    return [Head(**x) for x in sorted(at.mapInArrow(run, HEAD).toArrow().to_pylist(), key=lambda x: x["part"])]


def settled_heads(at: DataFrame, stream: str, step: Step, tally: Tally | None = None, guesses: int = GUESSES) -> tuple[dict[int, bytes], list[Head], int]:
    """The state with which each range goes on a stream that began before it, the ranges' heads from these, and the rounds it took."""
    heads = {h.part: h for h in swept(at, stream, step, {}, None, tally)}
    parts, began, rounds = sorted(heads), {}, 1
    while True:
        incoming = {q: heads[p].state for p, q in zip(parts, parts[1:], strict=False) if heads[p].last == heads[q].first}
        todo = {q for q in incoming if incoming[q] != began.get(q)}
        if tally is None:  # a range that holds the start of its last stream ends as it did, whatever it begins with
            todo = {q for q in todo if heads[q].first == heads[q].last}
        if rounds > guesses:  # this fold does not forget: only ranges whose start is sure
            todo = {q for p, q in zip(parts, parts[1:], strict=False) if q in todo and p not in todo}
        if not todo:
            return incoming, [heads[p] for p in parts], rounds
        rounds += 1
        heads |= {h.part: h for h in swept(at, stream, step, incoming, todo, tally)}
        began |= {q: incoming[q] for q in todo}


def kept(rows: DataFrame, stream: str, order: list[str], step: Step, flag: str = "kept", parts: int | None = None) -> DataFrame:
    """rows with a flag: whether the fold keeps them. order must tell a stream's rows apart, or ties come in any order."""
    at = ranged(rows, [stream], order, parts)
    return flagged(at, stream, step, settled_heads(at, stream, step)[0], flag)


def flagged(at: DataFrame, stream: str, step: Step, incoming: dict[int, bytes], flag: str) -> DataFrame:
    """The rows of ranges with the flags of a fold, each range going on from its incoming state."""

    def mark(batches):
        last = state = None
        for batch in batches:
            flags = []
            for key, some in runs(batch, stream):
                if last is None:
                    part = batch.column(PART)[0].as_py()
                    state = pickle.loads(incoming[part]) if part in incoming else None
                elif key != last[0]:
                    state = None
                last = (key,)
                state, own = step(key, state, some)
                flags.append(own)
            yield batch.append_column(flag, pa.array(np.concatenate(flags) if flags else np.zeros(0, bool)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in at.schema)
    return at.mapInArrow(mark, f"{fields}, `{flag}` boolean").drop(PART)


#: turn(key, state, rows): the state after rows of one stream, and what the fold gives for them, as columns by name.
Turn = Callable[[Any, Any, pa.RecordBatch], tuple[Any, dict[str, Any]]]


def mapped(rows: DataFrame, stream: str, order: list[str], turn: Turn, schema: str, forgets: bool = False, parts: int | None = None) -> DataFrame:
    """What a fold of one's own gives over each stream in order, as a loop over the stream would: rows of schema.

    turn gets a stream's rows in pieces of any size and must not depend on how they are cut; its state, None at first, must pickle. A fold
    that forgets (a filter, a rate, a last value) runs over all ranges at once; another's state is handed from range to range, so that
    only the states are sequential: the last pass, which gives the rows, runs all ranges at once again, each from its state. A task that
    is lost starts its range again from that state. order must tell a stream's rows apart.
    """
    at = ranged(rows, [stream], order, parts)
    incoming, _, _ = settled_heads(at, stream, lambda key, state, some: (turn(key, state, some)[0], np.zeros(0, bool)), guesses=GUESSES if forgets else 0)

    def give(batches):
        last = state = None
        for batch in batches:
            for key, some in runs(batch, stream):
                if last is None:
                    part = batch.column(PART)[0].as_py()
                    state = pickle.loads(incoming[part]) if part in incoming else None
                elif key != last[0]:
                    state = None
                last = (key,)
                state, out = turn(key, state, some)
                yield pa.RecordBatch.from_pydict(out)

    return at.mapInArrow(give, schema)
