"""The registered queries of this subpackage: each reads whole tables, applies one operator and derives the contract's columns."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automaton_dedup, byte_bpe, cap_filters, fill_middle, hard_negatives, jaccard_join, line_dedup, mixing, page_text, pieces, pii, repetition, suffix_dedup


def model_path() -> str:
    """The production tokenizer's file; it is installed beside Python on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def ranks_path() -> str:
    """The production rank file, installed in the same way."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymized(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode_decode(table(spark, sf_dir, "documents"), model_path())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedupe_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "text")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_documents(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(table(spark, sf_dir, "pages"))


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op10_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = automaton_dedup.remove_repeated_words(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives.hard_negatives(rows.withColumn("label", F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)")))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.encode_decode(table(spark, sf_dir, "documents"), ranks_path())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c, 256)  # noqa: E731
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fill_middle.restored()).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_pii": op2_pii,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_cap_filters": op4_cap_filters,
    "op5_line_dedup": op5_line_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_page_text": op8_page_text,
    "op9_repetition": op9_repetition,
    "op10_automaton_dedup": op10_automaton_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_fill_middle": op13_fill_middle,
}
#: The words of documents, each with its place from 1.
WORDS = r"""d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
    w AS (SELECT doc_id, len(l) AS n, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS p FROM d)"""


def windows(n: int) -> str:
    """The n words from each on, as one text; fewer at a document's end."""
    return f"string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS g{n}"


def repeated(n: int) -> str:
    return f"p <= n - {n - 1} AND count(*) OVER (PARTITION BY doc_id, g{n}, p <= n - {n - 1}) > 1 AS u{n}"


def covering(n: int) -> str:
    return f"max(u{n}::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}"


SHARES = repetition.NGRAM_SHARES
COVERED = (repetition.WINDOW, *SHARES)


ORACLE_SQL: dict[str, str] = {
    "op9_repetition": rf"""WITH {WORDS}, g AS (SELECT *, {", ".join(map(windows, COVERED))} FROM w), u AS (SELECT *, {", ".join(map(repeated, COVERED))} FROM g), c AS (SELECT doc_id, length(w) AS k, {", ".join(map(covering, COVERED))} FROM u),
        a AS (SELECT doc_id, count(*) AS n_words, sum(k)::BIGINT AS word_chars, sum(c3)::BIGINT AS n_repeat_words, {", ".join(f"sum(k * c{n}) / sum(k) AS s{n}" for n in SHARES)} FROM c GROUP BY doc_id),
        l AS (SELECT doc_id, line, length(regexp_replace(line, '[ 	-]', '', 'g')) AS k, row_number() OVER (PARTITION BY doc_id, line) AS i FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
        r AS (SELECT doc_id, count(*) AS n_dup_lines, sum(k) AS dup FROM l WHERE k > 0 AND i > 1 GROUP BY doc_id),
        m AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
            {", ".join(f"coalesce(s{n}, 0.0)::DOUBLE AS dup_{n}gram_share" for n in SHARES)}, (coalesce(dup, 0) / greatest(coalesce(word_chars, 0), 1))::DOUBLE AS dup_line_share FROM d LEFT JOIN a USING (doc_id) LEFT JOIN r USING (doc_id))
        SELECT *, NOT base_failed AND dup_line_share <= {repetition.LINE_SHARE} AND {" AND ".join(f"dup_{n}gram_share <= {most}::DOUBLE" for n, most in SHARES.items())} AS kept
        FROM (SELECT *, n_words < {repetition.LEAST_WORDS} OR 100 * n_repeat_words > {repetition.REPEAT_PERCENT} * n_words AS base_failed FROM m)""",
    "op10_automaton_dedup": f"""WITH {WORDS}, g AS (SELECT doc_id, p, {windows(20)}, n FROM w), r AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY g20 ORDER BY doc_id, p) AS i FROM g WHERE p <= n - 19) WHERE i > 1),
        gone AS (SELECT DISTINCT doc_id, p + unnest(range(20)) AS p FROM r), k AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS kept FROM w ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, len(l) AS n_words, len(l) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op11_hard_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_dot_product(a.q, v.q)::BIGINT AS score FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS i FROM s WHERE same) WHERE i <= 5),
        n AS (SELECT p.*, vec_id, score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS i
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, i::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM n WHERE i <= 10""",
    "op13_fill_middle": """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
        u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, [('0x' || h[8 * i + 1 : 8 * i + 8])::BIGINT FOR i IN range(4)] AS h FROM h),
        c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT *, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 : n], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
        sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256 FROM p""",
}
