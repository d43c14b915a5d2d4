"""A training corpus from documents: quality rules, line dedup, near-duplicate removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm import jaccard_join, line_dedup, mixing, pieces, queries, repetition
from tracewell.llm.tables import settled, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep. Each row is judged by its own text, so ids may repeat or be null."""
    return repetition.kept_rows(docs).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur earlier; those with no line left go. n_chars follows the text."""
    out = line_dedup.dedupe_lines(docs)
    out = out.filter((F.col("n_removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.col("n_removed_lines") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, similarity 0.8): that of the least doc_id, null last.

    Rows are told apart by a hash of doc_id and text. Rows alike in both are copies, of which one stays, unless they hold no word.
    """
    keyed = docs.withColumn("__key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    near = jaccard_join.near_documents(keyed, n=5, num=8, den=10, id_col="__key").filter("n_shingles > 0")
    near = settled(near.groupBy(F.col("doc_id").alias("__key"), "component_id").agg(F.count("*").alias("rows")))
    groups = near.groupBy("component_id").agg(F.count("*").alias("keys")).filter("keys > 1")
    members = near.join(groups, "component_id").select("component_id", "__key")
    # a key's rows have one doc_id
    ranked = keyed.select("__key", "doc_id").join(members, "__key").select("component_id", F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "__key").alias("rank"))
    winners = ranked.groupBy("component_id").agg(F.min("rank").alias("rank")).select("component_id", F.col("rank.__key").alias("winner"))
    marked = near.join(winners, "component_id", "left").withColumn("stays", F.col("__key") == F.coalesce("winner", "__key"))
    marked = settled(marked.filter("NOT stays OR rows > 1").select("__key", "stays"))
    out = keyed.join(marked, "__key", "left")
    alone = out.filter("stays IS NULL").select(*docs.columns)
    copies = out.filter("stays")
    order = Window.partitionBy("__key").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")])
    return alone.unionByName(copies.withColumn("__copy", F.row_number().over(order)).filter("__copy = 1").select(*docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each document and pass that takes any of it, with the words taken."""
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded) of each document of the mix."""
    return pieces.encode_decode(docs, queries.model_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding),
]
#: Line dedup by edit distance and the merge encoding are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
