"""Connected components of a link table, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import settled


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node that links reach. Only nodes with a link to another have a row.

    Each round hangs a node's neighbours under the least of them, which halves paths and keeps the number of links from
    growing; a centre with many links is a partial minimum and a join that adaptive execution can split. Only a count
    and a checksum reach the driver. Each round is settled, so a lost executor costs no earlier round.
    """
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct()
    links = settled(links)
    mark = None
    for _ in range(most_rounds):
        both = links.union(links.select(F.col("b"), F.col("a")).toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        links = settled(small.select("e.a", "e.b").filter("a > b").distinct())
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    ends = links.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return ends.unionByName(roots)
