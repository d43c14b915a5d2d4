"""Streaming operators over rows (user_id, stream, event_id, at timestamp): all take a stream or a table and return the like."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(rows: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Rows per window and stream; rows later than late behind the newest are dropped from a stream."""
    g = rows.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "stream")
    return g.agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), "stream", "n")


def rates(rows: DataFrame, width: str, seconds: float, floor_hz: float, late: str = "10 minutes") -> DataFrame:
    """Rates per window and stream, those under a floor left out."""
    return tumbling_counts(rows, width, late).withColumn("hz", F.col("n") / seconds).filter(F.col("hz") >= floor_hz).drop("n")


def panels(rows: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: they open at a row and fold when none comes for gap; a row just then opens the next."""
    # session windows that touch are merged, so they end a microsecond before
    g = rows.withWatermark("at", late).groupBy(F.session_window("at", f"{gap} -1 microseconds").alias("w"), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("open_us"), (F.unix_micros("w.end") + 1).alias("fold_us"), "n")


def firsts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, each when it is first seen; the state holds one entry per key."""
    return rows.select(*keys).dropDuplicates(keys)


STEPS = "user_id long, at_us long, state string"


def presence(rows: DataFrame, idle_us: int, away_us: int) -> DataFrame:
    """(user_id, at_us, state) of each change: online at a row, idle and away when none came for so long.

    The state is the time of a user's last row. A change by silence is told when the next row comes, with the time at which it
    took place, so the result does not depend on how rows are batched. Rows that come before the last one of their user change nothing.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(x for part in parts for x in part["at_us"]):
            if last is None or t - last > idle_us:
                if last is not None:
                    out.append((key[0], last + idle_us, "idle"))
                    if t - last > away_us:
                        out.append((key[0], last + away_us, "away"))
                out.append((key[0], t, "online"))
            last = t if last is None else max(last, t)
        state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "at_us", "state"])

    return rows.select("user_id", F.unix_micros("at").alias("at_us")).groupBy("user_id").applyInPandasWithState(step, STEPS, "last long", "append", GroupStateTimeout.NoTimeout)


def released(rows: DataFrame, opens: str, held: str) -> DataFrame:
    """(event_id) of held rows, let out once their user's first opening row has come; those stamped before it are dropped.

    The state holds a user's opening time and, until it is known, the held rows' ids and times.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, ids, times = state.get if state.exists else (None, [], [])
        part = pd.concat(list(parts))
        first = part.loc[part["stream"] == opens, "at_us"]
        if opened is None and len(first):
            opened = int(first.min())
        mine = part[part["stream"] == held]
        ids, times = [*ids, *mine["event_id"].tolist()], [*times, *mine["at_us"].tolist()]
        if opened is None:
            state.update((None, ids, times))
            return
        state.update((opened, [], []))
        yield pd.DataFrame({"event_id": [i for i, t in zip(ids, times, strict=True) if t >= opened]}, dtype="int64")

    wanted = rows.filter(F.col("stream").isin(opens, held)).select("user_id", "stream", "event_id", F.unix_micros("at").alias("at_us"))
    return wanted.groupBy("user_id").applyInPandasWithState(step, "event_id long", "opened long, ids array<long>, times array<long>", "append", GroupStateTimeout.NoTimeout)
