"""The registered queries: their columns and types, and those that SQL can express against it, on whole tables."""

import hashlib

import duckdb
import pytest

from tracewell.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op3_sentencepiece": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op4_cap_filters": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op6_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op7_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op8_page_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op9_repetition": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op10_automaton_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op11_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    "op12_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op13_fill_middle": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_whole_table(spark, duck, name):
    out = queries.QUERIES[name](spark, SF)
    types = dict(out.dtypes)
    assert COLUMNS.get(name, {}).items() <= types.items()
    rows = out.toArrow()
    of = {"op4_cap_filters": "embeddings", "op8_page_text": "pages", "op11_hard_negatives": None}.get(name, "documents")
    if of:
        assert rows.num_rows == duck.sql(f"SELECT count(*) FROM {of}").fetchall()[0][0]
    if name in queries.ORACLE_SQL:
        want = duck.sql(queries.ORACLE_SQL[name]).to_arrow_table()
        assert sorted(rows.column_names) == sorted(want.column_names)
        plain = lambda t: sorted(tuple(r[c] for c in sorted(t.column_names)) for r in t.to_pylist())
        assert plain(rows) == plain(want)


def test_digests_of_removed_bytes(spark, duck):
    """sha256 columns against the operators' own texts."""
    from tracewell.llm.automaton_dedup import remove_repeated_words
    from tracewell.llm.suffix_dedup import remove_repeated_bytes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, out in (("op7_suffix_dedup", remove_repeated_bytes(docs, length=100)), ("op10_automaton_dedup", remove_repeated_words(docs, window=20))):
        kept = {r.doc_id: r.kept for r in out.select("doc_id", "kept").collect()}
        want = {i: hashlib.sha256(k.encode() if isinstance(k, str) else bytes(k)).hexdigest() for i, k in kept.items()}
        assert {r.doc_id: r.kept_sha256 for r in queries.QUERIES[name](spark, SF).collect()} == want
