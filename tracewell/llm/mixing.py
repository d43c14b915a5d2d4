"""Mixing sources to target weights, with DataFrame operations only.

The words of a source, document after document, are cut into blocks of equal length. The mix is a row of output shards of
shard_slots slots. How many slots of a shard each source has is a multinomial draw with the targets as probabilities, given
the totals: a pseudorandom permutation of all slots scatters each source's exact number of slots over the shards, and their
counts per shard and source are the draw. From these counts everything follows: a source's slots are numbered shard
after shard, their numbers go through a pseudorandom permutation of its block indices, anew for each pass over the
source, and slots join blocks by index. So no block is taken a second time before all have been taken once, and none more than twice.

Permutations are swap-or-not networks: each round maps index x to (key - x) mod n or leaves it, by a hash that both
share; every round is its own inverse, for any n, with no table and no walk. Prefix sums are taken in two levels
(within a chunk of a source, then over chunk totals), so a source with a third of all rows is never one task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import settled

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
ROUNDS = 12
#: Longest block in words; a small source has 1 / PARTS of its size, one word at least, so that its slots can meet its target.
BLOCK_WORDS, PARTS = 64, 512
SHARD_SLOTS = 4096
#: Shards whose counts are summed in one window.
MANY_SHARDS = 1024
#: Sources up to which the table of sources is broadcast (about 100 bytes each).
BROADCAST_SOURCES = 20_000


def permuted(df: DataFrame, x: str, n: str, keys: list[Column], out: str, rounds: int = ROUNDS) -> DataFrame:
    """df with out: x, in 0 .. n - 1, through a permutation of that range that the keys choose."""
    seeds = F.array(*[F.struct(F.pmod(F.xxhash64(F.lit(r), F.col(n), *keys), F.col(n)).alias("k"), F.xxhash64(F.lit(r + 1000), *keys).alias("h")) for r in range(rounds)])

    def turn(at: Column, seed: Column) -> Column:
        other = F.pmod(seed["k"] - at, F.col(n))
        return F.when(F.xxhash64(seed["h"], F.greatest(at, other)) % 2 == 0, at).otherwise(other)

    # a fold, and not a column per round: the optimizer would inline those into an expression of 3 ** rounds terms
    return df.withColumn(out, F.aggregate(seeds, F.col(x), turn))


def targets(sizes: DataFrame, total_share: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, source_size, source_no, target): the level L at which sum(min(most * size, L * weight)) is the total wanted.

    Equal to sharing by weight and sharing excess over most times a source's size anew until there is none. One row per
    source; the windows run over that table, not over documents.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    by = Window.orderBy("ratio", "source_no")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    # sources in order of the level at which they are full: the level if exactly those before this one are full
    s = s.withColumn("level", (F.lit(total_share) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    return s.select("source", "source_size", "source_no", F.least("most", F.coalesce("level", F.lit(float("inf"))) * F.col("w")).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    total_share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    key: Column | None = None,
    pieces: bool = False,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(key, doc_id, size, source_size, target, taken) per row of docs, and with pieces what is taken of it.

    size counts words `[^\\x20\\x09-\\x0D]+`. Sources in order of code points, null last (a source of its own), have the
    weights in turn and share total_share of all words; no target exceeds most (2 at most) times its source's size.
    taken counts the document's words in the mix, repeats counted, and is within most times its size. pieces is an array
    of (shard, slot, pass, first word, words) in that order. Null or empty texts have size 0 and nothing taken; rows
    that repeat an id are taken each; an empty table gives an empty result; other columns are ignored. Equal input gives
    an equal mix, however it is partitioned. key: identifies a row (by default a number made here).
    """
    row_key = F.monotonically_increasing_id() if key is None else key
    base = settled(
        docs.select(
            row_key.alias("key"),
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
    )
    sources = settled(targets(base, total_share, weights, most))
    counts = sources.agg(F.count("*"), F.sum("source_size")).first()
    small = F.broadcast if counts[0] <= BROADCAST_SOURCES else (lambda x: x)
    words = int(counts[1] or 0)

    # slots and blocks of each source
    plan = (
        sources.filter("source_size > 0")
        .withColumn("length", F.least(F.lit(BLOCK_WORDS), F.greatest(F.lit(1), F.floor(F.col("source_size") / PARTS))).cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long"))
        .withColumn("slots", F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.floor(F.lit(most) * F.col("blocks")).cast("long")))
        .withColumn("first", F.sum("slots").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("all", F.sum("slots").over(Window.partitionBy(F.lit(0))))
        .na.fill({"first": 0})
    )
    parts = max(8, words // 2_000_000)
    slots = (
        plan.filter("slots > 0")
        .withColumn("part", F.explode(F.expr("sequence(0L, (slots - 1) div 8192)")))
        .repartition(parts, "source_no", "part")
        .withColumn("j", F.explode(F.expr("sequence(part * 8192, least(slots, (part + 1) * 8192) - 1)")))
    )
    # the draw: slots of each source in each shard
    slots = permuted(slots.withColumn("g", F.col("first") + F.col("j")), "g", "all", [F.lit(seed + 1)], "place")
    drawn = slots.groupBy("source_no", F.expr(f"place div {SHARD_SLOTS}").alias("shard")).agg(F.count("*").alias("n")).withColumn("many", F.expr(f"shard div {MANY_SHARDS}"))
    drawn = settled(drawn)
    # where in its source's row of slots a shard's share begins, in two levels; and where in the shard a source's share does
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = drawn.groupBy("source_no", "many").agg(F.sum("n").alias("most")).withColumn("lo", F.coalesce(F.sum("most").over(upto("source_no").orderBy("many")), F.lit(0)))
    drawn = drawn.join(before.drop("most"), ["source_no", "many"]).withColumn("lo", F.col("lo") + F.coalesce(F.sum("n").over(upto("source_no", "many").orderBy("shard")), F.lit(0)))
    if pieces:
        drawn = drawn.withColumn("from", F.coalesce(F.sum("n").over(upto("shard").orderBy("source_no")), F.lit(0))).withColumn("held", F.sum("n").over(Window.partitionBy("shard")))
    # few rows that become many: spread by number, which adaptive execution leaves as it is
    slots = drawn.join(small(plan.select("source_no", "blocks")), "source_no").repartition(parts, "source_no", "shard").withColumn("i", F.explode(F.expr("sequence(0L, n - 1)"))).withColumn("j", F.col("lo") + F.col("i"))
    slots = slots.withColumn("pass", F.expr("j div blocks")).withColumn("j", F.col("j") % F.col("blocks"))
    slots = permuted(slots, "j", "blocks", [F.lit(seed), F.col("source_no"), F.col("pass")], "block")
    if pieces:
        slots = permuted(slots.withColumn("i", F.col("from") + F.col("i")), "i", "held", [F.lit(seed + 2), F.col("shard")], "slot")
        slots = slots.select("source_no", "block", F.struct("shard", "slot", "pass").alias("at"))
        drawn = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"), F.collect_list("at").alias("ats"))  # two at most
    else:
        drawn = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))

    # where each document's words stand in its source: order by chunk (a hash of the id), then id
    chunks = max(1, int((words**0.5) / 8))
    with_no = base.join(small(sources), base.source.eqNullSafe(sources.source)).drop(sources.source)
    with_no = with_no.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.lit(chunks)))
    totals = with_no.groupBy("source_no", "chunk").agg(F.sum("size").alias("chunk_size"))
    totals = totals.withColumn("chunk_first", F.coalesce(F.sum("chunk_size").over(Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("source_no", "chunk").orderBy("doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        with_no.withColumn("lo", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(totals.hint("merge"), ["source_no", "chunk"])
        .join(small(plan.select("source_no", "length")), "source_no", "left")
        .withColumn("lo", F.col("lo") + F.col("chunk_first"))
    )
    # a document without words gets a block of its own that no slot has
    cut = placed.withColumn(
        "block", F.explode(F.expr("CASE WHEN size > 0 THEN sequence(lo div length, (lo + size - 1) div length) ELSE array(-1L - pmod(xxhash64(key), 1000000L)) END"))
    )
    cut = cut.withColumn("from", F.greatest(F.col("lo"), F.col("block") * F.col("length")) - F.col("lo")).withColumn(
        "n", F.least(F.col("lo") + F.col("size"), (F.col("block") + 1) * F.col("length")) - F.col("lo") - F.col("from")
    )
    met = cut.join(drawn.hint("merge"), ["source_no", "block"], "left")
    aggregates = [F.coalesce(F.sum(F.col("n") * F.col("times")), F.lit(0)).cast("long").alias("taken")]
    if pieces:
        own = F.transform(F.col("ats"), lambda a: F.struct(a["shard"].alias("shard"), a["slot"].alias("slot"), a["pass"].alias("pass"), F.col("from").alias("from"), F.col("n").alias("n")))
        aggregates.append(F.sort_array(F.flatten(F.collect_list(F.coalesce(own, F.array().cast("array<struct<shard:bigint,slot:bigint,pass:bigint,from:bigint,n:bigint>>"))))).alias("pieces"))
    return met.groupBy("key", "doc_id", "size", "source_size", "target").agg(*aggregates)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents with docs' own columns: one row per document and pass that takes any of it.

    A pass that takes all of a document keeps its text as it is; one that takes part of it has the words taken, in order,
    joined by one space. n_chars, where there is such a column, follows the text. Rows equal in id, source and text
    count as one document.
    """
    key = lambda: F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"), F.lit(0))
    unique = docs.dropDuplicates(["doc_id", "source", "text"])
    plan = mix(unique, key=key(), pieces=True, **options).filter("taken > 0")
    runs = F.sort_array(F.collect_list(F.struct(F.col("p.from").alias("from"), F.col("p.n").alias("n"))))
    passes = (
        plan.select(F.col("key").alias("__key"), F.col("size").alias("__size"), F.explode("pieces").alias("p"))
        .groupBy("__key", "__size", F.col("p.pass").alias("__pass"))
        .agg(F.sum("p.n").alias("__n"), runs.alias("__runs"))
    )
    out = unique.withColumn("__key", key()).join(passes, "__key")
    taken = F.array_join(F.flatten(F.transform("__runs", lambda r: F.slice(F.col("__words"), (r["from"] + 1).cast("int"), r["n"].cast("int")))), " ")
    out = out.withColumn("__words", F.when(F.col("__n") < F.col("__size"), F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1))))
    out = out.withColumn("text", F.when(F.col("__n") == F.col("__size"), F.col("text")).otherwise(taken))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
