"""Verdicts on a link's measurements, as ordered grades: 0 good, 1 borderline, 2 bad."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: (good, borderline) limits; latency and signal in ms and dBm, throughput in Mbit/s, share and cpu in percent
LATENCY, THROUGHPUT, SHARE, SIGNAL, CPU = (100, 250), (20, 5), (70, 30), (-60, -70), (70, 90)
GRADES = ("good", "borderline", "bad")


def below(value: Column, limits: tuple[float, float]) -> Column:
    """Grade of a value that should be low: under the first limit good, up to the second borderline; null where it is null."""
    return F.when(value < limits[0], 0).when(value <= limits[1], 1).when(value.isNotNull(), 2)


def above(value: Column, limits: tuple[float, float]) -> Column:
    """Grade of a value that should be high: from the first limit on good, from the second on borderline."""
    return F.when(value >= limits[0], 0).when(value >= limits[1], 1).when(value.isNotNull(), 2)


def named(grade: Column) -> Column:
    return F.when(grade.isNull(), "info").otherwise(F.element_at(F.array(*[F.lit(g) for g in GRADES]), (grade + 1).cast("int")))


def worse(*grades: Column) -> Column:
    """The worse of grades; a missing one counts as good."""
    return F.greatest(*[F.coalesce(g, F.lit(0)) for g in grades])


def comfortable(p95: Column, mbps: Column, offered_bps: Column, latency_ms: float = LATENCY[0], share: float = 0.9) -> Column:
    """Whether a paced run kept the delay low and nearly all that was offered arrived; an idle or unpaced one did not."""
    return (offered_bps > 0) & (p95 < latency_ms) & (mbps >= share * offered_bps / 1e6)


def scale(n: Column, low: Column, high: Column, least: Column, most: Column, span: float = 1000) -> Column:
    """How a pool of n numbers is drawn: null if flat, log if none is below 0 and they span that many times the least size other than 0, else linear."""
    return F.when((n < 2) | (high <= low), None).when((low >= 0) & (most / least > span), "log").otherwise("linear")
