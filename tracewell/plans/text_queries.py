"""Telemetry, verdicts, logs and transcripts: events stand for samples, conversations for transcripts, documents for logs."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .profile_queries import E, events
from .registry import query, table

IP = "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"
# the first pattern that a line meets names its kind
KINDS = (("address", IP), ("license", "(?i)license"), ("mail", "@[a-z0-9-]+[.]"), ("number", "[0-9]{4}"))


def kind_sql(text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{k}'" for k, p in KINDS) + " ELSE 'other' END"


@query(f"SELECT doc_id, {kind_sql('text')} AS kind FROM documents")
def classify_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit("other")
    for k, p in reversed(KINDS):
        kind = F.when(F.col("text").rlike(p), k).otherwise(kind)
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"))


@query(f"SELECT kind, count(*) AS n FROM (SELECT {kind_sql('text')} AS kind FROM documents) GROUP BY kind")
def event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_events(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT user_id, arg_max(event_id, (value, -ts_us, -event_id)) AS worst_id, max(value) AS worst FROM {E} WHERE value > 0 GROUP BY user_id")
def sendq_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest reading; of ties, the earliest."""
    g = events(spark, sf_dir).filter("value > 0").groupBy("user_id")
    return g.agg(F.max_by("event_id", F.struct("value", -F.col("ts_us"), -F.col("event_id"))).alias("worst_id"), F.max("value").alias("worst"))


@query(f"SELECT user_id, count(*) AS total, count(*) FILTER (stream = 'error') AS lost FROM {E} GROUP BY user_id")
def ping_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("stream") == "error").alias("lost"))


@query("SELECT user_id, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY user_id")
def json_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))


@query(
    f"""SELECT user_id, CASE WHEN max(value) FILTER (i = least(n - 1, floor(0.95 * n))) < 430 THEN 'good' WHEN max(value) FILTER (i = least(n - 1, floor(0.95 * n))) <= 460 THEN 'borderline' ELSE 'bad' END AS verdict
    FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM {E}) GROUP BY user_id"""
)
def link_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    r = events(spark, sf_dir).select("user_id", "value", (F.row_number().over(w.orderBy("value")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    p95 = F.max(F.when(F.col("i") == F.least(F.col("n") - 1, F.floor(F.lit(0.95) * F.col("n"))), F.col("value")))
    return r.groupBy("user_id").agg(F.when(p95 < 430, "good").when(p95 <= 460, "borderline").otherwise("bad").alias("verdict"))


@query(
    """SELECT c_nationkey, max(c_custkey) FILTER (c_acctbal < 5000) AS last_good, max(c_acctbal) AS best, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS best_run FROM customer GROUP BY c_nationkey"""
)
def comfortable_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last run under the limit, and the best one (the first of ties)."""
    best = F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey")))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max(F.when(F.col("c_acctbal") < 5000, F.col("c_custkey"))).alias("last_good"), F.max("c_acctbal").alias("best"), best.alias("best_run"))


@query("SELECT url_host AS host, count(*) AS n, min(page_id) AS first_id, max(page_id) AS last_id FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS url_host FROM pages) GROUP BY 1")
def logins_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("host")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"))


@query("SELECT source, lang, substr(regexp_extract(text, '^[^=]*'), 1, 60) AS head, count(*) AS n FROM documents GROUP BY 1, 2, 3 HAVING count(*) > 1")
def warn_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.substring(F.regexp_extract("text", "^[^=]*", 0), 1, 60)
    return table(spark, sf_dir, "documents").groupBy("source", "lang", head.alias("head")).agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY conv_id DESC, turn DESC) AS i FROM conversations) WHERE i = 1 ORDER BY conv_id DESC, turn DESC LIMIT 500")
def history_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of equal messages, the newest 500 of them."""
    last = table(spark, sf_dir, "conversations").groupBy("text").agg(F.max(F.struct("conv_id", "turn")).alias("m"))
    return last.select("m.*").orderBy(F.desc("conv_id"), F.desc("turn")).limit(500)


@query("SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'agent' WHEN role = 'user' THEN 'human' ELSE coalesce(role, 'unknown') END AS role FROM conversations")
def role_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("role") == "assistant", "agent").when(F.col("role") == "user", "human").otherwise(F.coalesce("role", F.lit("unknown")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", role.alias("role"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def message_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").filter("text IS NOT NULL").groupBy("conv_id").agg(F.array_join(F.transform(blocks, lambda b: b["text"]), "\n").alias("text"))


@query("SELECT conv_id, turn, regexp_extract('[tool:' || role || '] ' || text, '^\\[tool:([^\\]]*)\\] ', 1) AS tool, length(regexp_replace('[tool:' || role || '] ' || text, '^\\[tool:[^\\]]*\\] ', '')) AS n FROM conversations")
def tool_prefix_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("[tool:"), F.col("role"), F.lit("] "), F.col("text"))
    rest = F.regexp_replace(line, r"^\[tool:[^\]]*\] ", "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract(line, r"^\[tool:([^\]]*)\] ", 1).alias("tool"), F.char_length(rest).cast("long").alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS n FROM documents WHERE regexp_matches(text, '[0-9]')")
def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike("[0-9]")).select("doc_id", F.regexp_count("text", F.lit("[0-9]+")).cast("long").alias("n"))


@query("SELECT event_id, '/robot' || CASE WHEN event_type LIKE '/%' THEN event_type ELSE '/' || event_type END AS topic FROM events")
def namespace_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.concat(F.lit("/robot/"), F.regexp_replace("event_type", "^/", ""))
    return table(spark, sf_dir, "events").select("event_id", topic.alias("topic"))
