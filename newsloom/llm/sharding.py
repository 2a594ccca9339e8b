"""A reproducible shuffle into shards: a Feistel permutation, with cycle walking, of global row numbers.

Law `rows`: of N rows, the one numbered i goes to place p = permute(i, N), that is to shard
p mod S and slot p div S. Counts differ by one at most, slots have no gaps, and both ways
can be computed for any row without the table: `place` and `row_at`.

Rows are numbered in the order of the named columns (NULLs first). Rows equal in all of them are
interchangeable: which of them gets which of their numbers is open. A missing text counts as empty;
an empty table gives no rows; columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import text_or_empty, without
from newsloom.operators.ordering import number_rows

ROUNDS = 6


def _mixed(values: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64(key)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    start = _mixed(np.array([seed % 2**64], np.uint64), 0x9E3779B97F4A7C15)
    return [int(_mixed(start, 0xD1B54A32D192ED03 * (r + 1) % 2**64)[0]) for r in range(ROUNDS)]


def _once(values: np.ndarray, bits: int, keys: Sequence[int], back: bool) -> np.ndarray:
    """One pass over the domain of 2**bits; the halves swap widths in every round."""
    low = bits - bits // 2
    left, right = values >> np.uint64(low), values & np.uint64((1 << low) - 1)
    wide, narrow = np.uint64((1 << low) - 1), np.uint64((1 << (bits - low)) - 1)
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        # In round r the left half has the narrow width if r is even.
        mask = wide if r % 2 else narrow
        if back:
            left, right = right ^ (_mixed(left, keys[r]) & mask), left
        else:
            left, right = right, left ^ (_mixed(right, keys[r]) & mask)
    return (left << np.uint64(low)) | right


def permute(numbers: np.ndarray, total: int, seed: int, back: bool = False) -> np.ndarray:
    """The permutation of 0..total-1, or its inverse; walks on while a value lies outside."""
    values = np.asarray(numbers).astype(np.uint64)
    bits = max(2, (total - 1).bit_length())
    keys = _keys(seed)
    values = _once(values, bits, keys, back)
    while (outside := values >= np.uint64(total)).any():
        values[outside] = _once(values[outside], bits, keys, back)
    return values.astype(np.int64)


def place(number: int, total: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of a row number."""
    at = int(permute(np.array([number]), total, seed)[0])
    return at % shards, at // shards


def row_at(shard: int, slot: int, total: int, shards: int, seed: int) -> int:
    """The row number found in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), total, seed, back=True)[0])


def shard_rows(rows: DataFrame, order_by: Sequence[str], shards: int, seed: int = 0) -> DataFrame:
    """``rows`` with row_number, shard and slot."""
    source = without(rows, "row_number", "shard", "slot", "__tie", "__range", "__place", "__start", "__at")
    numbered, total = number_rows(source, order_by, "row_number")

    @F.pandas_udf("bigint")
    def target(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), total, seed))

    placed = numbered.withColumn("__at", target("row_number"))
    shard = F.pmod("__at", F.lit(shards)).cast("int")
    return placed.select("*", shard.alias("shard"), F.expr(f"__at div {shards}").alias("slot")).drop("__at")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, in slot order within each file; a shard may take several files."""
    width = int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = sharded.repartitionByRange(width, "shard", "slot").sortWithinPartitions("shard", "slot")
    ranged.write.partitionBy("shard").parquet(path)


def sharded_documents(documents: DataFrame, shards: int, seed: int) -> DataFrame:
    """The contract's columns: id, size, checksum, law, shard and slot; texts themselves are not moved."""
    text = text_or_empty()
    narrow = documents.select(
        "doc_id", (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = shard_rows(narrow, ["doc_id", "size", "text_crc32"], shards, seed)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


