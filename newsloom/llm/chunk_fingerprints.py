"""Fingerprints from content-defined chunks.

A gear hash runs over the UTF-8 bytes: each step shifts it by one bit and adds the table's value of the byte, so that it
depends on the last 32 bytes only. A chunk ends where the hash has its upper bits zero: more of them
before the normal size, fewer after it, none asked for at the largest. Boundaries move with the content, so an edit changes
the chunks it touches and few others. A fingerprint is the set of (digest, length) of the chunks, as text:
16 hexadecimal digits and the length of each, in ascending order.

Likeness is containment: the length of the shared chunks over the length of the shorter set. Equal texts have equal
fingerprints; NULL and empty ones the empty fingerprint, which is like an empty one (1) and like no other (0).

Texts of any length are read whole. Repeated rows each get a row: the next document of one is the next row with its id, in the order of a hash of the texts,
and among equal rows an equal one. An empty table gives no rows; the only document follows itself. A column named fingerprint is replaced, other columns
are kept (`with_fingerprints`) or not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import slices, text_or_empty, with_columns

LEAST, NORMAL, MOST = 32, 96, 384  # bytes in a chunk
STRICT, EASY = 9, 5  # zero bits before and after the normal size
BLOCK = 1 << 20  # bytes hashed at a time
MISSING = -(2**62)  # where ranges of ids put rows without one

# The gear table: one random-looking number for each byte, from a digest.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, all at once: sums over 1, 2, 4, ... 32 bytes."""
    hashes = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        older = np.zeros_like(hashes)
        older[shift:] = hashes[:-shift] << np.uint32(shift)
        hashes = hashes + older
    return hashes


def boundaries(raw: bytes) -> list[int]:
    """The ends of the chunks."""
    easy: list[np.ndarray] = []
    strict: list[np.ndarray] = []
    data = np.frombuffer(raw, np.uint8)
    for start in range(0, len(raw), BLOCK):
        lead = min(start, 32)
        hashes = gear_hashes(data[start - lead : start + BLOCK])[lead:]
        at = np.flatnonzero(hashes >> np.uint32(32 - EASY) == 0)
        easy.append(at + (start + 1))
        strict.append(at[hashes[at] >> np.uint32(32 - STRICT) == 0] + (start + 1))
    easier = np.concatenate(easy) if easy else np.zeros(0, np.int64)
    stricter = np.concatenate(strict) if strict else easier
    ends, begin, size = [], 0, len(raw)
    easy_list, strict_list = easier.tolist(), stricter.tolist()
    e = s = 0
    while begin < size:
        end = min(begin + MOST, size)
        while s < len(strict_list) and strict_list[s] < begin + LEAST:
            s += 1
        while e < len(easy_list) and easy_list[e] < begin + NORMAL:
            e += 1
        if s < len(strict_list) and strict_list[s] < begin + NORMAL:
            end = min(end, strict_list[s])
        elif e < len(easy_list):
            end = min(end, easy_list[e])
        ends.append(end)
        begin = end
    return ends


def fingerprint(text: str) -> str:
    raw, chunks, begin = text.encode(), set(), 0
    for end in boundaries(raw):
        chunk = raw[begin:end]
        chunks.add(f"{hashlib.blake2b(chunk, digest_size=8).hexdigest()}:{len(chunk)}")
        begin = end
    return " ".join(sorted(chunks))


def likeness(left: str, right: str) -> float:
    """Weighted containment of the smaller chunk set in the other, 0 to 1."""
    one, other = {*left.split()}, {*right.split()}
    if not one or not other:
        return float(not one and not other)
    weight = lambda chunks: sum(int(c[17:]) for c in chunks)
    return weight(one & other) / min(weight(one), weight(other))


def with_fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the fingerprint of each text."""
    return with_columns(df, text, "fingerprint string", lambda: lambda texts: [pa.array([*map(fingerprint, texts)], pa.string())])


def _ranges(keys: DataFrame, parts: int) -> list[int]:
    """Ids at which new ranges begin; an id that fills several ranges comes several times."""
    numbers = keys.select(F.coalesce("doc_id", F.lit(MISSING)).cast("double").alias("n"))
    found = numbers.stat.approxQuantile("n", [i / parts for i in range(1, parts)], 0.2 / parts)
    return sorted(int(x) for x in found)


def followed(documents: DataFrame, compute: Callable, added: str, parts: int | None = None) -> DataFrame:
    """Rows of ``documents`` (doc_id, text) with what a function gives for a text and the next one in the order of doc_id.

    ``compute()`` is called once per task and gives that function.

    NULL ids come first; equal ids are ordered by a hash of their text, and the last document is followed
    by the first. Texts are moved once, to ranges of ids; only the smallest key of each range
    reaches the driver, and that row alone is sent to the range before as well. An id that fills whole
    ranges is spread over them by the hash.
    """
    spark = documents.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select("doc_id", text_or_empty().alias("text"))
    cuts = np.array(_ranges(rows.select("doc_id"), parts) if parts > 1 else [], np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        known = ids.to_numpy().astype(np.int64)
        first, last = np.searchsorted(cuts, known, "left"), np.searchsorted(cuts, known, "right")
        # Between two cuts at the same id its rows go by hash, in ascending order.
        spread = (hashes.to_numpy().astype(np.float64) / 2**64 + 0.5) * (last - first)
        inner = first + 1 + np.minimum(spread.astype(np.int64), last - first - 1)
        return pd.Series(np.where(last > first, inner, last).astype(np.int32))

    keyed = rows.withColumn("h", F.xxhash64("text")).withColumn("r", range_of(F.coalesce("doc_id", F.lit(MISSING)), "h"))
    key = F.struct("doc_id", "h")
    heads = keyed.groupBy("r").agg(F.min(key).alias("head")).orderBy("r").collect()
    if not heads:
        return spark.createDataFrame([], f"doc_id {dict(documents.dtypes)['doc_id']}, {added}")
    before = {row["r"]: heads[i - 1]["r"] for i, row in enumerate(heads)}
    # One row per range, hence safe to broadcast; the planner cannot know.
    head_rows = spark.createDataFrame(
        [(row["r"], row["head"]["doc_id"], row["head"]["h"], before[row["r"]]) for row in heads], "r int, i bigint, g bigint, b int"
    )
    at_head = (keyed["r"] == head_rows["r"]) & keyed["doc_id"].eqNullSafe(head_rows["i"]) & (keyed["h"] == head_rows["g"])
    guests = keyed.join(F.broadcast(head_rows), at_head).groupBy("b").agg(F.min("text").alias("text"))
    guests = guests.select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit(0).cast("bigint").alias("h"), F.col("b").alias("r"), F.lit(1).alias("guest"))
    dealt = keyed.withColumn("guest", F.lit(0)).unionByName(guests).repartitionById(parts, "r")
    names = [part.split()[0] for part in added.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = compute()

        def emit(pending: list[tuple]) -> pa.RecordBatch:
            values = [function(mine, other) for _, mine, other in pending]
            columns = [pa.array([p[0] for p in pending], pa.int64()), *(pa.array(list(c)) for c in zip(*values))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", *names])

        pending: list[tuple] = []
        held = None
        for part in slices(batches):
            for doc, text, guest in zip(*(part.column(k).to_pylist() for k in range(3))):
                if held:
                    pending.append((*held, text))
                held = None if guest else (doc, text)
            if pending:
                yield emit(pending)
                pending = []

    ordered = dealt.sortWithinPartitions("r", "guest", "doc_id", "h").select("doc_id", "text", "guest")
    return ordered.mapInArrow(run, f"doc_id bigint, {added}")


def edited(text: str, following: str) -> str:
    """The text, its last half replaced by as much of the beginning of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def document_fingerprints(documents: DataFrame) -> DataFrame:
    """The contract's columns: fingerprints of each document and of its edited text, and likenesses."""

    def comparer() -> Callable[[str, str], tuple]:
        of = lru_cache(2)(fingerprint)  # the next text of one row is the text of the one after it

        def compare(text: str, following: str) -> tuple:
            changed = edited(text, following)
            mine, after, other = of(text), of(following), fingerprint(changed)
            digest = hashlib.sha256(changed.encode()).hexdigest()
            return len(text), digest, mine, other, likeness(mine, other), likeness(mine, after)

        return compare

    columns = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return followed(documents, comparer, columns)
