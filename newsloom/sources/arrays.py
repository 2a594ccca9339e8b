"""JSON arrays too large for one task: records found by many tasks in parallel.

A file is read in pieces that end at a `}`, which Spark splits by byte ranges like lines. What a range of bytes does to a JSON reader is
a small function: whether it turns being inside a string into being outside, and by how much it changes the depth of nesting, for both
ways in which it may be entered. Such functions compose, so one pass computes that of each split, a running composition over the
splits of a file tells how each is entered, and a second pass finds the records. A record that crosses splits comes as fragments,
which are put together afterwards; all others never leave their task.

The running composition handles one short row per split; the splits' entries, 30 bytes for each, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from newsloom.session import stored

QUOTE, BACKSLASH = ord('"'), ord("\\")
OPENING, CLOSING = (ord("["), ord("{")), (ord("]"), ord("}"))
STEPS = np.zeros(256, np.int8)
STEPS[list(OPENING)], STEPS[list(CLOSING)] = 1, -1

# Characters of a split that are looked at together, but for longer pieces.
STRETCH = 1 << 20


@dataclass(frozen=True)
class Transition:
    """What a stretch of JSON does: ``flips`` in and out of strings, and changes the depth if entered outside or inside one."""

    flips: bool
    outside: int
    inside: int

    def then(self, other: Transition) -> Transition:
        """Of two stretches one after the other."""
        after_outside = other.inside if self.flips else other.outside
        after_inside = other.outside if self.flips else other.inside
        return Transition(self.flips != other.flips, self.outside + after_outside, self.inside + after_inside)


NOTHING = Transition(False, 0, 0)


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Where brackets are, by how much each changes the depth, how many quotes that begin or end a string are before it, and how many there are.

    Positions are kept of quotes, backslashes and brackets only. A stretch never begins after a backslash.
    """
    quotes, slashes = np.flatnonzero(data == QUOTE), np.flatnonzero(data == BACKSLASH)
    if len(slashes):
        # A quote after an odd number of backslashes is part of its string.
        last = np.append(np.diff(slashes) != 1, True)
        ends = np.flatnonzero(last)
        odd = np.diff(np.append(-1, ends)) % 2 == 1
        quotes = quotes[~np.isin(quotes, slashes[ends[odd]] + 1)]
    steps = STEPS[data]
    brackets = np.flatnonzero(steps)
    return brackets, steps[brackets].astype(np.int64), np.searchsorted(quotes, brackets), len(quotes)


def transition(raw: bytes) -> Transition:
    """The function of a stretch that does not begin in the middle of an escape."""
    _, steps, before, quotes = _marks(np.frombuffer(raw, np.uint8))
    even = before % 2 == 0
    return Transition(bool(quotes % 2), int(steps[even].sum()), int(steps[~even].sum()))


def records(raw: bytes, inside: bool, depth: int) -> tuple[list[tuple[int, int]], bool, int]:
    """Where elements of the array begin and end, by opening and closing braces at depth 1, and the state after the stretch.

    A start without an end is (start, -1), an end without a start (-1, end).
    """
    data = np.frombuffer(raw, np.uint8)
    at, steps, before, quotes = _marks(data)
    outside = (before + inside) % 2 == 0
    at, steps = at[outside], steps[outside]
    after = depth + np.cumsum(steps)
    begin = at[(steps == 1) & (after == 2) & (data[at] == OPENING[1])]
    end = at[(steps == -1) & (after == 1) & (data[at] == CLOSING[1])]
    found: list[tuple[int, int]] = []
    starts, ends = begin.tolist(), (end + 1).tolist()
    if ends and (not starts or ends[0] <= starts[0]):
        found.append((-1, ends.pop(0)))
    found += list(zip(starts, ends))
    if len(starts) > len(ends):
        found.append((starts[-1], -1))
    return found, inside != bool(quotes % 2), int(after[-1]) if len(after) else depth


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "}").text(path)
    return lines.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), "value")


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """((file, block, …), bytes) of neighbouring pieces of one split; a split comes in stretches, whatever the size of the batches."""
    last, held, size = None, [], 0
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        keys = zip(*(c for c in (*columns[:2], *columns[3:])))
        for scalars, value in zip(keys, columns[2]):
            key = tuple(scalar.as_py() for scalar in scalars)
            if held and (key != last or size >= STRETCH):
                yield last, "".join(held).encode()
                held, size = [], 0
            piece = value.as_py() + "}"
            last, size = key, size + len(piece)
            held.append(piece)
    if held:
        yield last, "".join(held).encode()


def _transitions(pieces: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: tuple, found: Transition) -> pa.RecordBatch:
            values = {"file": [key[0]], "block": [key[1]], "flips": [found.flips], "outside": [found.outside], "inside": [found.inside]}
            return pa.RecordBatch.from_pydict(values)

        last, found = None, NOTHING
        for key, raw in _splits(batches):
            if last is not None and key != last:
                yield row(last, found)
                found = NOTHING
            last, found = key, found.then(transition(raw))
        if last is not None:
            yield row(last, found)

    return pieces.mapInArrow(run, "file string, block bigint, flips boolean, outside bigint, inside bigint")


def split_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, inside, depth, closed): the state in which each split is entered, and whether its file ends as an array does.

    What is read has a `}` too many after the last piece, so a whole array leaves the depth at -1.
    """
    rows = stored(_transitions(_pieces(spark, path)), "transitions")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    flips = F.coalesce(F.sum(F.col("flips").cast("int")).over(earlier), F.lit(0))
    entered = rows.withColumn("inside_now", flips % 2 == 1)
    change = F.when(F.col("inside_now"), F.col("inside")).otherwise(F.col("outside"))
    whole = Window.partitionBy("file")
    deep = entered.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(earlier), F.lit(0)))
    closed = (F.sum("change").over(whole) == -1) & (F.sum(F.col("flips").cast("int")).over(whole) % 2 == 0)
    return deep.select("file", "block", F.col("inside_now").alias("inside"), "depth", closed.alias("closed"))


def _located(pieces: DataFrame) -> DataFrame:
    """(file, block, row, part, value): whole records (part 0), and beginnings (1), middles (2) and ends (3) of those that cross splits."""
    names = ["file", "block", "row", "part", "value"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        inside, depth, row = False, 0, 0
        held: list[bytes] = []
        begun = False  # the record that is being held began in this split

        def rest() -> list[tuple]:
            return [(last[0], last[1], row, 1 if begun else 2, b"".join(held).decode())] if held else []

        for key, raw in _splits(batches):
            out: list[tuple] = []
            if key != last:
                if last is not None:
                    out += rest()
                last, (inside, depth), row, held, begun = key, key[2:], 0, [], False
            open_before = depth >= 2
            found, inside, depth = records(raw, inside, depth)
            for start, end in found:
                if start >= 0 and end >= 0:
                    out.append((key[0], key[1], row, 0, raw[start:end].decode()))
                    row += 1
                elif start >= 0:
                    held, begun = [raw[start:]], True
                else:
                    held.append(raw[:end])
                    out.append((key[0], key[1], row, 0 if begun else 3, b"".join(held).decode()))
                    held, begun = [], False
                    row += 1
            if not found and open_before:
                held.append(raw)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        if last is not None and held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rest()), kinds)], names)

    return pieces.mapInArrow(run, "file string, block bigint, row bigint, part int, value string")


def read_records(spark: SparkSession, path: str, broken: str = "fail") -> DataFrame:
    """(position, value): the objects of JSON arrays, each as text, with their position as (file, block, row).

    A file that does not end where its array does ends the job at once, or is left out if ``broken`` is "skip". Elements that
    are no objects are passed over; records are not parsed here.
    """
    entries = stored(split_entries(spark, path), "split-entries")
    if broken == "fail":
        bad = [r.file for r in entries.where(~F.col("closed")).select("file").distinct().limit(5).collect()]
        if bad:
            raise ValueError(f"not a whole JSON array: {', '.join(bad)}")
    # One short row per split of a file, by its hash.
    split = F.xxhash64("file", "block")
    known = entries.where("closed").select(split.alias("__split"), "inside", "depth")
    pieces = _pieces(spark, path).withColumn("__split", split)
    entered = pieces.join(F.broadcast(known), "__split").select("file", "block", "value", "inside", "depth")
    found = _located(entered)
    fragments = stored(found.where("part > 0"), "fragments")
    # A fragment belongs to the last beginning before it, in the order of splits; a beginning is the last row of its split.
    order = Window.partitionBy("file").orderBy("block", F.col("part") % 3, "row")
    owner = F.last(F.when(F.col("part") == 1, F.struct("block", "row")), ignorenulls=True).over(order)
    owned = fragments.select("file", "block", "part", "row").withColumn("owner", owner)
    texts = fragments.join(owned, ["file", "block", "part", "row"]).groupBy("file", "owner")
    parts = F.array_sort(F.collect_list(F.struct("block", (F.col("part") % 3).alias("kind"), "value")))
    # Up to the end; what follows is no object, nor is what never ends.
    size = F.array_position(F.transform("parts", lambda x: x["kind"]), 0)
    joined = texts.agg(parts.alias("parts")).withColumn("size", size).where("size > 0 AND owner IS NOT NULL")
    value = F.array_join(F.transform(F.slice("parts", 1, F.col("size").cast("int")), lambda x: x["value"]), "")
    joined = joined.select("file", "owner", value.alias("value"))
    schema = T._parse_datatype_string("struct<file: string, block: bigint, row: bigint>")
    whole = found.where("part = 0").select(F.struct("file", "block", "row").cast(schema).alias("position"), "value")
    return whole.unionByName(joined.select(F.struct("file", "owner.block", "owner.row").cast(schema).alias("position"), "value"))
