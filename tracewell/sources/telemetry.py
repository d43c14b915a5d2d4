"""Telemetry of a network recorder: files of JSON lines, a day each, with samples, events and the start of each run.

Files are read by Spark's own JSON source with a fixed schema; a line that is no JSON object is kept aside, told by broken(), and is in no other table.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBERS = "link double, level double, noise double, disc_retry long, disc_misc long, missed_beacon long"
DELTAS = "rx_bytes long, tx_bytes long, rx_packets long, tx_packets long, tx_errors long, tx_dropped long, rx_dropped long"
RADIO = "bssid string, freq double, signal double, tx_retries long, tx_failed long, beacon_loss long, tx_mbit double, rx_mbit double"
SOCKET = "port long, peer string, recvq long, sendq long, rtt double, retrans long, cwnd long"
SCHEMA = (
    f"t string, k string, iface string, ports array<long>, gateway string, pid long, w struct<{NUMBERS}>, d struct<{DELTAS}>, iw struct<{RADIO}>, socks array<struct<{SOCKET}>>, "
    "sys struct<load1 double, mem_avail_kb long, temp_c double>, ping map<string, struct<rtt double, loss long>>, kind string, n long, line string, _broken string"
)
DAY = r"(\d{4}-\d\d-\d\d)\.jsonl$"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines, with the file, its day and the time; a field of another type than it should have is null."""
    raw = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    day = F.regexp_extract(F.input_file_name(), DAY, 1)
    return raw.withColumn("at", F.try_to_timestamp("t")).withColumn("day", F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date"))


def broken(spark: SparkSession, path: str) -> DataFrame:
    """(day, n) of lines that are no JSON object, or whose kind is not told; all columns are read, as Spark asks for before it tells."""
    return lines(spark, path).filter("k IS NULL").groupBy("day").agg(F.count("*").alias("n"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).filter("k = 's'").select("at", "t", "w", "d", "iw", "socks", "sys", "ping")


def events(spark: SparkSession, path: str) -> DataFrame:
    """(at, kind, n, line); a line without a count stands for one event."""
    return lines(spark, path).filter("k = 'e'").select("at", "kind", F.when(F.coalesce("n", F.lit(0)) == 0, 1).otherwise(F.col("n")).alias("n"), "line")


def report(spark: SparkSession, path: str) -> DataFrame:
    """One row: samples, their first and last stamp, the signal's range, the worst send queue and the first stamp that has it (null if none is over 0), retransmissions of the
    last sample's sockets, and probes sent and lost. No row without samples."""
    s = samples(spark, path)
    queue = F.coalesce(F.array_max(F.transform("socks", lambda x: F.coalesce(x["sendq"], F.lit(0)))), F.lit(0))
    retrans = F.coalesce(F.aggregate("socks", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["retrans"], F.lit(0))), F.lit(0))
    probes = F.coalesce(F.size(F.map_values("ping")), F.lit(0))
    lost = F.coalesce(F.size(F.filter(F.map_values("ping"), lambda p: F.coalesce(p["loss"], F.lit(0)) != 0)), F.lit(0))
    rows = s.select("t", F.col("iw.signal").alias("signal"), F.greatest(queue, F.lit(0)).alias("q"), retrans.alias("retrans"), F.greatest(probes, F.lit(0)).alias("probes"), F.greatest(lost, F.lit(0)).alias("lost"))
    g = rows.agg(
        F.count("*").alias("samples"), F.min("t").alias("first"), F.max("t").alias("last"), F.min("signal").alias("signal_low"), F.max("signal").alias("signal_high"), F.max("q").alias("worst_sendq"),
        F.max_by("t", F.struct("q", F.lit(0) - F.unix_micros(F.try_to_timestamp("t")))).alias("worst_at"), F.max_by("retrans", "t").alias("retrans"), F.sum("probes").alias("probes"), F.sum("lost").alias("lost"),
    )
    return g.filter("samples > 0").withColumn("worst_at", F.when(F.col("worst_sendq") > 0, F.col("worst_at")))


def recent(df: DataFrame, today: str, days: int) -> DataFrame:
    """Lines of files that are at most so many days old; the filter is on the file's day, and lines of files without one stay."""
    return df.filter(F.col("day").isNull() | (F.col("day") >= F.date_sub(F.lit(today).cast("date"), days)))


def write_daily(rows: DataFrame, path: str, today: str, keep_days: int) -> None:
    """Rows (at, ...) appended as JSON lines to a folder of days; those of days before the last keep_days are left out, and folders of such days are emptied.

    A day is written anew only if rows has some of it.
    """
    spark = rows.sparkSession
    cutoff = F.date_sub(F.lit(today).cast("date"), keep_days)
    rows.withColumn("day", F.to_date("at")).filter(F.col("day") >= cutoff).write.mode("append").partitionBy("day").json(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    first = spark.range(1).select(cutoff.cast("string")).first()[0]
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("day=") and name[4:] < first:
            fs.delete(status.getPath(), True)
