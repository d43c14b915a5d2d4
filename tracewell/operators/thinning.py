"""Greedy thinning of streams: to a byte budget by how far values move, and to the weightiest rows of each neighbourhood.

A row kept stays the last one kept until a value leaves it by more than the limit, so a range is passed by leaps over blocks of known least and
most values. Wherever a fold comes from, the first row of a range that it keeps is one of those that exceed all before them in the range: a few
dozen, in most data. Folds from these, for all limits at once, say what the range does to any fold that comes in.
"""

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import runs, settled_heads, swept
from .ranges import PART, ranged
from .settle import settled

#: Steps of the search that one sweep decides: it folds with all limits that these steps could come to, 2 ** DEPTH - 1.
DEPTH = 5
#: Rows of a block that leaps pass at once.
BLOCK = 512
#: Rows that exceed all before them, and leaps, up to which a range says what it does to any fold; beyond, it is folded as it comes.
MOST_ENTRIES, MOST_LEAPS = 256, 200_000


def limits_ahead(low: float, high: float, depth: int) -> np.ndarray:
    """The middles that the next steps of a halving search can come to: node i's children are 2 i + 1 (lower half) and 2 i + 2."""
    spans, out = [(low, high)], []
    for i in range(2**depth - 1):
        low, high = spans[i]
        middle = (low + high) / 2
        out.append(middle)
        spans += [(low, middle), (middle, high)]
    return np.array(out)


def narrowed(low: float, high: float, sizes: np.ndarray, budget: float, steps: int) -> tuple[float, float]:
    """The span after so many steps, by the sizes at limits_ahead."""
    node = 0
    for _ in range(steps):
        middle = (low + high) / 2
        if sizes[node] > budget:
            low, node = middle, 2 * node + 2
        else:
            high, node = middle, 2 * node + 1
    return low, high


def table_of(rows: pa.RecordBatch | pa.Table, values: list[str]) -> np.ndarray:
    return np.column_stack([rows.column(v).to_numpy() for v in values]).astype(np.float64)


def flags_of(points: np.ndarray, limits: np.ndarray, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, limits) flags: a row is kept if a value differs from the last row kept by more than the limit. state: that row, for each limit."""
    flags = np.zeros((len(points), len(limits)), bool)
    for i, x in enumerate(points):
        if state is None:
            state, flags[i] = np.tile(x, (len(limits), 1)), True
            continue
        far = np.abs(state - x).max(axis=1) > limits
        if far.any():
            state[far] = x
            flags[i] = far
    return state, flags


class Leaps:
    """A range's rows of one stream, passed from one row kept to the next."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        starts = np.arange(0, len(points), BLOCK)
        self.least, self.most = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)

    def entries(self) -> np.ndarray:
        """The rows that a fold from before can keep first: those with a value above, or below, all before them."""
        first = np.zeros(len(self.points), bool)
        first[0] = True
        for x in (self.points, -self.points):
            first[1:] |= (x[1:] > np.maximum.accumulate(x)[:-1]).any(axis=1)
        return np.flatnonzero(first)

    def next(self, at: int, limit: float) -> int | None:
        """The next row kept after row at."""
        state, block = self.points[at], at // BLOCK
        lo, hi = at + 1, (block + 1) * BLOCK
        near = (np.abs(self.points[lo:hi] - state) > limit).any(axis=1)
        if len(near) and near.any():
            return lo + int(near.argmax())
        far = ((np.abs(self.most[block + 1 :] - state) > limit) | (np.abs(self.least[block + 1 :] - state) > limit)).any(axis=1)
        if not len(far) or not far.any():
            return None
        lo = (block + 1 + int(far.argmax())) * BLOCK
        return lo + int((np.abs(self.points[lo : lo + BLOCK] - state) > limit).any(axis=1).argmax())

    def onward(self, entries: np.ndarray, limit: float, budget: float, leaps: int) -> tuple[np.ndarray, np.ndarray, int]:
        """For folds from each entry: the size of what they keep (infinite once over the budget), their last row kept, and leaps left (under 0: given up)."""
        stops = bool((self.sizes >= 0).all())
        known: dict[int, tuple[float, int]] = {}
        after: dict[int, int | None] = {}
        sizes, lasts = np.zeros(len(entries)), np.zeros(len(entries), np.int64)
        for i, entry in enumerate(entries.tolist()):
            way, size, at = [], 0.0, entry
            while at is not None and at not in known and not (stops and size > budget):
                way.append(at)
                size += self.sizes[at]
                if at not in after:
                    after[at] = self.next(at, limit)
                    leaps -= 1
                    if leaps < 0:
                        return sizes, lasts, leaps
                at = after[at]
            if at is not None and at not in known:
                # over the budget from here; what lies on the way may not be
                sizes[i], lasts[i] = np.inf, way[-1]
                continue
            total, last = (0.0, way[-1]) if at is None else known[at]
            for x in reversed(way):
                total += self.sizes[x]
                known[x] = total, last
            sizes[i], lasts[i] = known[entry]
        return sizes, lasts, leaps


def flags_at(points: np.ndarray, limit: float, state: np.ndarray | None) -> np.ndarray:
    """flags_of for one limit: by leaps, where few rows are kept."""
    flags = np.zeros(len(points), bool)
    far = np.ones(1, bool) if state is None else (np.abs(points - state[0]) > limit).any(axis=1)
    row, rows, left = (int(far.argmax()) if far.any() else None), Leaps(points, flags), 1000 + len(points) // 16
    while row is not None:
        flags[row] = True
        row, left = rows.next(row, limit), left - 1
        if left < 0:
            return flags_of(points, np.array([limit]), state)[1][:, 0]
    return flags


def passages(at: DataFrame, stream: str, values: list[str], size: str, budget: float, limits: dict) -> dict | None:
    """What each range does to the folds of the streams of limits: {key: [(part, entries, sizes, states, whether the last row is kept, its size)]}; None if one gave up."""

    def run(batches):
        held: dict = {}
        part = None
        for batch in batches:
            for key, some in runs(batch, stream):
                if (key,) in limits:
                    part = batch.column(PART)[0].as_py()
                    held.setdefault(key, []).append((table_of(some, values), some.column(size).to_numpy().astype(np.float64)))
        for key, pieces in held.items():
            rows = Leaps(np.concatenate([p for p, _ in pieces]), np.concatenate([x for _, x in pieces]))
            entries, leaps, found = rows.entries(), MOST_LEAPS, []
            if len(entries) <= MOST_ENTRIES:
                for limit in limits[key,]:
                    sizes, lasts, leaps = rows.onward(entries, float(limit), budget, leaps)
                    found.append((sizes, rows.points[lasts], lasts == len(rows.points) - 1))
                    if leaps < 0:
                        break
            gave_up = leaps < 0 or not found
            out = None if gave_up else (rows.points[entries], *(np.stack(x) for x in zip(*found, strict=True)), rows.sizes[-1])
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "key": [pickle.dumps(key)], "found": [pickle.dumps(out)]})

    out: dict = {}
    for part, key, found in sorted((x["part"], x["key"], x["found"]) for x in at.mapInArrow(run, "part int, key binary, found binary").toArrow().to_pylist()):
        if (found := pickle.loads(found)) is None:
            return None
        out.setdefault((pickle.loads(key),), []).append((part, *found))
    return out


def followed(ranges: list[tuple], limits: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Over a stream's ranges in order: the size kept at each limit, its last row included, and the state in which each range but the first is entered."""
    totals, incoming = np.zeros(len(limits)), {}
    for i, limit in enumerate(limits):
        state = None
        for part, entries, sizes, states, ends, last in ranges:
            if state is not None:
                incoming.setdefault(part, np.zeros((len(limits), entries.shape[1])))[i] = state
            far = np.ones(1, bool) if state is None else (np.abs(entries - state) > limit).any(axis=1)
            loose = last
            if far.any():
                j = int(far.argmax())
                totals[i] += sizes[i, j]
                state, loose = states[i, j], 0.0 if ends[i, j] else last
        totals[i] += loose
    return totals, incoming


def thinned(rows: DataFrame, stream: str, order: list[str], values: list[str], size: str, budget: int, steps: int = 30, most: float = 1e4, parts: int | None = None) -> DataFrame:
    """The rows of each stream that a greedy thinning to a byte budget keeps, with the limit it came to.

    A row is kept if a value differs from the last row kept by more than the limit; a stream's first and last are always kept. The
    limit is the least that fits sum(size) of the rows kept into the budget, found by so many halvings of 0 to most; a stream
    that fits as it is stays whole, with limit 0. Rows with a null or NaN among values or size take no part; order must tell rows apart.

    Streams that lie in one range are searched there; for the others one pass over all ranges at once finds what they do to folds with 31
    limits, which decides five halvings. Where a range has too many rows to begin from, or a fold keeps too many, the pass is a fold
    that forgets where it began (see folds).
    """
    sound = " AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(CAST(`{c}` AS DOUBLE))" for c in [*values, size])
    at = ranged(rows.filter(sound), [stream], order, parts)
    limits: dict = {}

    def step(key, state, some):
        mine = limits.get((key,))
        if mine is None:
            return None, np.zeros((some.num_rows, 0), bool)
        return flags_of(table_of(some, values), mine, None if state is None else state.copy())

    def tally(before, some, flags):
        sizes = some.column(size).to_numpy().astype(np.float64)
        whole, part = (0.0, 0.0) if before is None else before[:2]
        return whole + sizes.sum(), part + sizes @ flags, sizes[-1] * ~flags[-1]

    def totals(heads):
        """Per stream that a border cuts: its size, its size at each limit, and what its last row adds if it was not kept."""
        out = {}
        for head in heads:
            for key, (whole, part, loose) in head.tallies().items():
                a = out.get((key,), (0.0, 0.0))
                out[key,] = (a[0] + whole, a[1] + part, loose)
        return {k: v for k, v in out.items() if k in cut}

    heads = swept(at, stream, step, {}, None, tally)
    cut = {pickle.loads(q.first) for p, q in zip(heads, heads[1:], strict=False) if p.last == q.first}
    spans = {k: (0.0, most) for k, (whole, _, _) in totals(heads).items() if whole > budget}
    for done in range(0, steps, DEPTH):
        if not spans:
            break
        limits.update({k: limits_ahead(*span, DEPTH) for k, span in spans.items()})
        through = passages(at, stream, values, size, budget, limits)
        if through is None:
            found = {k: part + loose for k, (_, part, loose) in totals(settled_heads(at, stream, step, tally)[1]).items()}
        else:
            found = {k: followed(ranges, limits[k])[0] for k, ranges in through.items()}
        spans = {k: narrowed(*span, found[k], budget, min(DEPTH, steps - done)) for k, span in spans.items()}
    limits.clear()
    limits.update({k: np.array([high]) for k, (_, high) in spans.items()})
    incoming = {}
    if spans and (through := passages(at, stream, values, size, np.inf, limits)) is None:
        incoming = settled_heads(at, stream, step)[0]
    elif spans:
        for k, ranges in through.items():
            incoming |= {part: pickle.dumps(state) for part, state in followed(ranges, limits[k])[1].items()}
    last_part = {k: max(h.part for h in heads if k[0] in h.tallies()) for k in cut}

    def mark(batches):
        own, held, first = None, [], True

        def flagged(key, first):
            some = pa.Table.from_batches(held).combine_chunks()
            part = some.column(PART)[0].as_py()
            flags, limit = np.ones(some.num_rows, bool), 0.0
            if key in limits:
                state = pickle.loads(incoming[part]) if first and part in incoming else None
                limit = float(limits[key][0])
                flags = flags_at(table_of(some, values), limit, state)
                flags[-1] |= part == last_part[key]
            elif key not in cut:
                flags, limit = searched(table_of(some, values), some.column(size).to_numpy().astype(np.float64), budget, steps, most)
            kept = some.filter(pa.array(flags))
            yield from kept.append_column("limit", pa.array(np.full(kept.num_rows, limit))).combine_chunks().to_batches()

        for batch in batches:
            for key, some in runs(batch, stream):
                if held and (key,) != own:
                    yield from flagged(own, first)
                    held, first = [], False
                own = (key,)
                held.append(some)
        if held:
            yield from flagged(own, first)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in at.schema)
    return at.mapInArrow(mark, f"{fields}, limit double").drop(PART)


def searched(points: np.ndarray, sizes: np.ndarray, budget: float, steps: int, most: float) -> tuple[np.ndarray, float]:
    """The same for a stream at hand: flags and limit."""
    if sizes.sum() <= budget:
        return np.ones(len(points), bool), 0.0
    low, high = 0.0, most
    for done in range(0, steps, DEPTH):
        flags = flags_of(points, limits_ahead(low, high, DEPTH), None)[1]
        flags[-1] = True
        low, high = narrowed(low, high, sizes @ flags, budget, min(DEPTH, steps - done))
    flags = flags_of(points, np.array([high]), None)[1][:, 0]
    flags[-1] = True
    return flags, high


def suppressed(rows: DataFrame, stream: str, ts: str, weight: str, ties: list[str], within: int) -> tuple[DataFrame, int]:
    """The rows that greedy suppression keeps, by weight (ties: the earlier, then by ties), each more than `within` from all kept before it; and the rounds.

    Rounds keep, at once, every row that is the best of all that are left around it, and take out what is around those: that is the
    greedy set, in whatever order. Time is cut into buckets of `within`; a bucket's best is the only one in it that can be
    kept, so a round meets rows with one candidate in each bucket beside theirs. Rounds grow with the longest run of rows each of which
    is outweighed by the next around it: a few for weights in no order. Rows without time or weight take no part.
    """
    rank = F.struct((-F.col(weight)).alias("w"), F.col(ts).alias("t"), *ties)
    base = rows.filter(F.col(ts).isNotNull() & F.col(weight).isNotNull())
    left = settled(base.select(F.col(stream).alias("s"), F.col(ts).alias("t"), F.floor(F.col(ts) / max(within, 1)).alias("b"), rank.alias("r")))
    kept, rounds = None, 0
    while not left.isEmpty():
        best = settled(left.groupBy("s", "b").agg(F.min("r").alias("r")).select("s", "b", "r", F.col("r.t").alias("t")))
        beside = best.select(F.col("s").alias("s2"), F.col("b").alias("of"), F.explode(F.array(F.col("b") - 1, F.col("b") + 1)).alias("b2"), F.col("r").alias("r2"), F.col("t").alias("t2"))
        better = F.col("s").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2")) & (F.abs(F.col("t") - F.col("t2")) <= within) & (F.col("r") < F.col("r2"))
        beaten = left.join(beside, better).select("s2", "of").distinct()
        won = settled(best.join(beaten, best.s.eqNullSafe(beaten.s2) & (best.b == beaten.of), "left_anti"))
        around = won.select(F.col("s").alias("s2"), F.explode(F.sequence(F.col("b") - 1, F.col("b") + 1)).alias("b2"), F.col("t").alias("t2"))
        near = F.col("s").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2")) & (F.abs(F.col("t") - F.col("t2")) <= within)
        left = settled(left.join(around, near, "left_anti"))
        kept = won if kept is None else kept.unionByName(won)
        rounds += 1
    names = kept.select(F.col("s").alias("__s"), "r") if kept is not None else left.select(F.col("s").alias("__s"), "r")
    return base.join(names, F.col(stream).eqNullSafe(F.col("__s")) & (rank == F.col("r")), "left_semi"), rounds
