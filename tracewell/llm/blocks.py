"""Cutting a table into blocks of bounded text, and reading Arrow groups back."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a block is meant to hold.
BLOCK_BYTES = 4 << 20
LEAST_BLOCKS = 32


def block_count(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks such that each holds about block_bytes; one number is all that reaches the driver."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(LEAST_BLOCKS, -(-int(total) // block_bytes))


def in_blocks(docs: DataFrame, n: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, doc_id, text): rows of one id share a block; ids spread evenly whatever they are."""
    return docs.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(n)).alias("block"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
    )


def by_id(table: pa.Table) -> pa.Table:
    """Rows by doc_id (null first), then text (null first), so a block looks alike whenever it is read."""
    order = pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
    return table.take(order)
