"""Removal of byte strings that occur more than once, by suffix arrays.

A byte goes if a 200-byte string that covers it also starts anywhere else, in the same text or in another one.

Every window of 200 bytes has one anchor: the 64-byte gram in it with the least hash, the leftmost such. Equal windows have
equal anchors in equal places, so they meet at the anchor's gram and nowhere else has to be
looked at. The windows of one anchor lie next to each other; the bytes they cover are its context. Grams that occur once are
left out by a semi-join. Of the others equal contexts are counted before anything is shuffled with
its bytes: a context that occurs twice is repeated as a whole. What is left are grams with several distinct contexts, as at
the edges of copied passages. Each distinct one of them is fetched once, cut down to what the
nearest others in the order of its right and of its left side share with it, and a suffix array over these pieces
(see `suffix_groups`) brings equal windows next to each other; in it the common gram is one symbol.

The contexts of a gram with more than `PART` distinct ones, a common passage with many surroundings, are first cut down by all of them
together: their sides are sorted by range partitions, and neighbours, also those across the edge of two partitions, tell how much a side
shares with any other. What differs everywhere is gone then, at no row per window. If more than `PART` contexts are still
left they are dealt to several parts; each part adds up the windows left by its own suffix array and sends one digest per distinct one,
whose counts decide. So neither copies, hot passages nor hot grams gather in one task, and nothing is left out.

Texts are named by a 64-bit hash and their length. A NULL or empty text has no bytes and no spans; texts under 200 bytes
are kept whole. Repeated rows are copies of each other: their texts go, from 200 bytes on. An empty table gives
no rows. Columns named like the added ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import fields, slices, text_or_empty, without
from newsloom.llm.suffix_groups import suffix_array
from newsloom.session import stored

WINDOW, GRAM = 200, 64
AROUND = WINDOW - GRAM  # bytes of a window besides its gram
PART = 2048  # distinct contexts of a gram in one suffix array
BUFFER = 1 << 18  # bytes hashed at a time
PIECE = 1 << 17  # windows of a text taken at a time
SYMBOLS = 1 << 18  # symbols in a suffix array, apart from larger groups
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
POSITION = (1 << 24) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Anchors:
    """Anchors of many texts at once; holds the powers that its hashes need."""

    def __init__(self) -> None:
        size = BUFFER + PIECE + WINDOW + 1
        self.powers = np.cumprod(np.append(np.uint64(1), np.full(size, BASE, np.uint64)))
        self.inverses = np.cumprod(np.append(np.uint64(1), np.full(size, INVERSE, np.uint64)))

    def of(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """For each anchor: gram hash, context hash, number of its text, and where: gram position, most and least bytes before it."""
        pieces: list[tuple[int, int, bytes]] = []
        held = 0
        for i, raw in enumerate(texts):
            for start in range(0, len(raw) - WINDOW + 1, PIECE):
                pieces.append((i, start, raw[start : start + PIECE + WINDOW - 1]))
                held += len(pieces[-1][2])
                if held >= BUFFER:
                    yield self._of_pieces(pieces)
                    pieces, held = [], 0
        if pieces:
            yield self._of_pieces(pieces)

    def _of_pieces(self, pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(raw for _, _, raw in pieces), np.uint8)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * self.inverses[: len(data) - GRAM + 1])
        # The hash, then the position: of equal hashes the leftmost.
        least = (grams & np.uint64(2**64 - 1 - POSITION)) | np.arange(len(grams), dtype=np.uint64)
        span, width = 1, AROUND + 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: span - width], least[width - span :])
        at = (least & np.uint64(POSITION)).astype(np.int64)
        # A run of windows with one anchor, cut where windows would reach into the next piece.
        sizes = np.array([len(raw) for _, _, raw in pieces])
        begins = np.cumsum(sizes) - sizes
        inside = np.ones(len(at), bool)
        for edge in begins[1:].tolist():
            inside[edge - WINDOW + 1 : edge] = False
        new = np.append(True, at[1:] != at[:-1])
        new |= np.append(True, inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        first, last = first[inside[first]], last[inside[first]]
        anchor = at[first]
        most, few = (anchor - first).astype(np.uint64), (anchor - last).astype(np.uint64)
        context = (sums[last + WINDOW] - sums[first]) * self.inverses[first]
        context = _mixed(context ^ _mixed(most * np.uint64(1000) + few + np.uint64(1)))
        piece = np.searchsorted(begins, first, "right") - 1
        offset = np.array([start for _, start, _ in pieces]) - begins
        where = ((anchor + offset[piece]).astype(np.uint64) << np.uint64(16)) | (most << np.uint64(8)) | few
        row = np.array([i for i, _, _ in pieces])[piece]
        return grams[anchor].view(np.int64), context.view(np.int64), row, where.view(np.int64)


def _keyed(documents: DataFrame) -> DataFrame:
    """Texts as bytes, named by hash and length."""
    text = text_or_empty()
    return documents.select(F.xxhash64(text).alias("k"), F.octet_length(text).cast("bigint").alias("n"), text.cast("binary").alias("raw"))


def anchors(documents: DataFrame) -> DataFrame:
    """(g, c, k, n, at): gram, context, name of the text and place of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Anchors()
        for part in slices(batches):
            k, n = (part.column(i).to_numpy() for i in (0, 1))
            for gram, context, row, where in found.of(part.column(2).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, context, k[row], n[row], where)], ["g", "c", "k", "n", "at"])

    return _keyed(documents).where(f"n >= {WINDOW}").mapInArrow(run, "g bigint, c bigint, k bigint, n bigint, at bigint")


def grams(documents: DataFrame) -> DataFrame:
    """(g): the gram of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Anchors()
        for part in slices(batches):
            for gram, *_ in found.of(part.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(gram)], ["g"])

    return _keyed(documents).where(f"n >= {WINDOW}").select("raw").mapInArrow(run, "g bigint")


def _shared(groups: np.ndarray, sides: list[bytes]) -> np.ndarray:
    """How many leading bytes each side shares with another one of its group: with a neighbour in their order."""
    size = len(sides)
    table = np.zeros((size, 8 + AROUND), np.uint8)
    table[:, :4] = groups.astype(">u4").view(np.uint8).reshape(-1, 4)
    lengths = np.array([len(s) for s in sides])
    flat = np.frombuffer(b"".join(sides), np.uint8)
    table[:, 4 : 4 + AROUND][np.arange(AROUND) < lengths[:, None]] = flat
    # A side that ends in NULs looks like a shorter one, padded: the shorter one comes first.
    table[:, 4 + AROUND :] = lengths.astype(">u4").view(np.uint8).reshape(-1, 4)
    order = np.argsort(table.view(f"S{8 + AROUND}")[:, 0], kind="stable")
    ordered, long = table[order, : 4 + AROUND], lengths[order]
    differ = ordered[1:] != ordered[:-1]
    equal = np.where(differ.any(axis=1), differ.argmax(axis=1), 4 + AROUND) - 4
    equal = np.minimum(equal, np.minimum(long[1:], long[:-1]))
    shared = np.full(size + 1, -1)
    shared[1:size] = equal
    most = np.maximum(shared[:-1], shared[1:])
    result = np.empty(size, np.int64)
    result[order] = most
    return result


def repeated_windows(
    groups: np.ndarray,
    before: np.ndarray,
    contexts: list[bytes],
    counts: np.ndarray,
    bounds: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of contexts by class, from the suffix array of the contexts.

    ``groups`` numbers the grams, ``before`` tells where in its context each gram begins. Gives for each window: its
    context, how many bytes it begins before the gram, the class of windows equal to it, and how often its class occurs.
    Windows that cannot have an equal one among these contexts are left out, or those outside ``bounds``, the least and most bytes
    that windows begin before the gram.
    """
    if bounds is not None:
        low, high = bounds
    else:
        low = before + WINDOW - np.array([len(c) for c in contexts])
        high = before.copy()
        right = _shared(groups, [c[b + GRAM :] for c, b in zip(contexts, before.tolist())])
        left = _shared(groups, [c[:b][::-1] for c, b in zip(contexts, before.tolist())])
        low, high = np.maximum(low, AROUND - right), np.minimum(high, left)
    chosen = np.flatnonzero(low <= high)
    if not len(chosen):
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing, nothing
    symbols: list[int] = []
    bases = []
    for i in chosen.tolist():
        context, b = contexts[i], int(before[i])
        bases.append(len(symbols))
        symbols += context[b - int(high[i]) : b]
        symbols.append(257 + int(groups[i]))
        symbols += context[b + GRAM : b + WINDOW - int(low[i])]
        symbols.append(256)
    symbols.append(-1)
    # The windows of a context start at its first symbols, the one that begins earliest first.
    width = (high - low + 1)[chosen]
    owner = np.repeat(chosen, width)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width)
    start = np.repeat(np.array(bases), width) + step
    distance = high[owner] - step
    rank = np.empty(len(symbols), np.int64)
    rank[suffix_array(symbols)] = np.arange(len(symbols))
    order = np.argsort(rank[start])
    values, ordered = np.array(symbols, np.int32), start[order]
    same = np.zeros(len(order), bool)
    for at in range(1, len(order), 4096):
        windows = values[ordered[at - 1 : at + 4096, None] + np.arange(AROUND + 1)]
        same[at : at + 4096] = (windows[1:] == windows[:-1]).all(axis=1)
    classes = np.empty(len(order), np.int64)
    classes[order] = np.cumsum(~same) - 1
    total = np.bincount(classes, weights=counts[owner])[classes].astype(np.int64)
    return owner, distance, classes, total


def _ranges(owner: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive distances of one owner as (owner, lowest, highest)."""
    order = np.lexsort((distance, owner))
    owner, distance = owner[order], distance[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (distance[1:] != distance[:-1] + 1))[: len(owner)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner))[: len(first)] - 1
    return owner[first], distance[first], distance[last]


def _shared_by_any(sides: DataFrame) -> DataFrame:
    """(g, c, shared): how many leading bytes the side of (g, c, side) shares with any other of its gram.

    The sides of a gram may fill many partitions. Of each partition the first and the last side reach the driver, to be
    compared with their neighbours.
    """
    names = ["g", "c", "shared", "edge", "range", "side"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        last: tuple | None = None
        met = 0  # bytes that the last row shares with the one before it

        def row(*values: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for part in slices(batches, 4096):
            g, c, side = (part.column(i).to_pylist() for i in range(3))
            if not g:
                continue
            if last is None:
                yield row(g[0], c[0], 0, 0, number, side[0])
            else:
                g, c, side = [last[0], *g], [last[1], *c], [last[2], *side]
            next_to = [_common(a, b) if x == y else 0 for x, y, a, b in zip(g, g[1:], side, side[1:])]
            both = np.maximum([met, *next_to], [*next_to, 0])[:-1]
            columns = [pa.array(g[:-1]), pa.array(c[:-1]), pa.array(both, pa.int64())]
            size = len(g) - 1
            nothing = [pa.nulls(size, k) for k in kinds[3:]]
            yield pa.RecordBatch.from_arrays([*(x.cast(pa.int64()) for x in columns), *nothing], names)
            last, met = (g[-1], c[-1], side[-1]), next_to[-1] if next_to else met
        if last is not None:
            yield row(*last[:2], met, 1, number, last[2])

    width = int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sides.select("g", "c", "side").repartitionByRange(width, "g", "side", "c").sortWithinPartitions("g", "side", "c")
    found = stored(dealt.mapInArrow(run, "g bigint, c bigint, shared bigint, edge int, range int, side binary"), "shared-sides")
    edges = found.where("edge IS NOT NULL").orderBy("range", "edge").collect()
    across = []
    for before, after in zip(edges[1::2], edges[2::2]):
        if before.g == after.g:
            size = _common(before.side, after.side)
            across += [(before.g, before.c, size), (after.g, after.c, size)]
    more = sides.sparkSession.createDataFrame(across, "g bigint, c bigint, shared bigint")
    return found.select("g", "c", "shared").union(more).groupBy("g", "c").agg(F.max("shared").alias("shared"))


def _common(one: bytes, two: bytes) -> int:
    size = min(len(one), len(two))
    if one[:size] == two[:size]:
        return size
    low, high = 0, size  # equal up to low, not up to high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if one[:middle] == two[:middle] else (low, middle)
    return low


def _cut_down(contexts: DataFrame, part: int) -> DataFrame:
    """Contexts of common grams with low and high as far as another context shares both sides; dealt to parts if still many."""
    before = F.col("before").cast("int")
    right = F.substring("context", before + (GRAM + 1), F.octet_length("context"))
    left = F.reverse(F.hex(F.substring("context", F.lit(1), before)))
    sides = [_shared_by_any(contexts.select("g", "c", side.alias("side"))) for side in (right, left.cast("binary"))]
    shared = sides[0].withColumnRenamed("shared", "right").join(sides[1].withColumnRenamed("shared", "nibbles"), ["g", "c"])
    low = F.greatest(F.col("before") + WINDOW - F.octet_length("context"), AROUND - F.col("right"))
    high = F.least(F.col("before"), F.floor(F.col("nibbles") / 2))
    cut = contexts.drop("low", "high", "part", "parts").join(shared, ["g", "c"]).withColumns({"low": low, "high": high})
    left_over = stored(cut.where("low <= high").drop("right", "nibbles"), "cut-contexts")
    kinds = left_over.groupBy("g").agg(F.ceil(F.count("*") / part).alias("parts"))
    dealt = left_over.join(stored(kinds, "kinds"), "g").withColumn("part", F.pmod("c", "parts"))
    return dealt.select(*contexts.columns)


def _decided(contexts: DataFrame) -> DataFrame:
    """From distinct contexts (g, part, parts, c, times, before, context, low, high): ranges (g, c, low, high) of repeated windows.

    Of a gram in several parts, also a row for each distinct window: digest and weight (2: repeated within its
    part), with the context of those not decided yet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decide(rows: list[tuple], trim: bool) -> Iterator[pa.RecordBatch]:
            numbers: dict[int, int] = {}
            groups = np.array([numbers.setdefault(r[0], len(numbers)) for r in rows])
            gram, context = np.array([r[0] for r in rows]), np.array([r[3] for r in rows])
            times, before = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
            raw = [r[6] for r in rows]
            bounds = None if trim else (np.array([r[7] for r in rows]), np.array([r[8] for r in rows]))
            owner, distance, classes, total = repeated_windows(groups, before, raw, times, bounds)
            again = (total > 1) & (times[owner] == 1)
            who, low, high = _ranges(owner[again], distance[again])
            none = pa.nulls(len(who), pa.int64())
            yield batch(pa.array(gram[who]), pa.array(context[who]), pa.array(low), pa.array(high), none, none)
            if not trim:
                _, first = np.unique(classes, return_index=True)
                starts = (before[owner[first]] - distance[first]).tolist()
                windows = (raw[i][s : s + WINDOW] for i, s in zip(owner[first].tolist(), starts))
                digests = [int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True) for w in windows]
                weight = np.minimum(total[first], 2)
                open_context = pa.array(context[owner[first]], mask=weight > 1)
                at = pa.array(distance[first])
                yield batch(pa.array(gram[owner[first]]), open_context, at, at, pa.array(digests, pa.int64()), pa.array(weight))

        def batch(*columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([c.cast(pa.int64()) for c in columns], ["g", "c", "low", "high", "digest", "weight"])

        held: list[tuple] = []
        group: list[tuple] = []
        size = 0
        for part in slices(batches, 1024):
            for row in zip(*(part.column(i).to_pylist() for i in range(9))):
                if group and group[-1][:2] != row[:2]:
                    if group[0][2] > 1:
                        yield from decide(group, False)
                    else:
                        held += group
                        size += sum(len(r[6]) for r in group)
                    group = []
                    if size >= SYMBOLS:
                        yield from decide(held, True)
                        held, size = [], 0
                group.append(row)
        if group and group[0][2] > 1:
            yield from decide(group, False)
        else:
            held += group
        if held:
            yield from decide(held, True)

    width = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.repartition(width, "g", "part").sortWithinPartitions("g", "part")
    return dealt.mapInArrow(run, "g bigint, c bigint, low bigint, high bigint, digest bigint, weight bigint")


def _fetched(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The distinct contexts of (k, n, wants), where wants lists (at, g, parts, c, times); low and high are not bound yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "parts", "c", "times", "before", "context"]
        for part in slices(batches):
            rows = []
            for raw, wants in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for want in wants:
                    position, most, few = want["at"] >> 16, want["at"] >> 8 & 255, want["at"] & 255
                    context = raw[position - most : position - few + WINDOW]
                    rows.append((want["g"], want["parts"], want["c"], want["times"], most, context))
            columns = list(zip(*rows)) or [()] * 6
            arrays = [pa.array(c, pa.binary() if name == "context" else pa.int64()) for c, name in zip(columns, names)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    joined = _keyed(documents).where(f"n >= {WINDOW}").join(wanted, ["k", "n"]).select("raw", "wants")
    found = joined.mapInArrow(run, "g bigint, parts bigint, c bigint, times bigint, before bigint, context binary").distinct()
    unbound = F.lit(None).cast("bigint")
    return found.select("g", F.lit(0).cast("bigint").alias("part"), "parts", "c", "times", "before", "context", unbound.alias("low"), unbound.alias("high"))


def repeated_spans(documents: DataFrame, part: int | None = None) -> DataFrame:
    """(k, n, spans): for texts with repeated strings, the bytes these cover, as (start, end) pairs that may overlap.

    ``part`` is the number of distinct contexts in one suffix array, `PART` if not given.
    """
    part = part or PART
    often = stored(grams(documents).groupBy("g").count().where("count > 1").select("g"), "grams")
    places = stored(anchors(documents).join(often, "g", "left_semi"), "anchors")
    distinct = stored(
        places.groupBy("g", "c").agg(F.count("*").alias("times"), F.min(F.struct("k", "n", "at")).alias("sample")), "contexts"
    )
    # Grams with several distinct contexts; those with very many are cut down together first.
    kinds = stored(distinct.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    mixed = distinct.join(kinds, "g").withColumn("parts", F.ceil(F.col("kinds") / part))
    wants = F.collect_list(F.struct("sample.at", "g", "parts", "c", "times"))
    wanted = mixed.groupBy("sample.k", "sample.n").agg(wants.alias("wants"))
    fetched = _fetched(documents, wanted)
    if not kinds.where(f"kinds > {part}").isEmpty():
        fetched = stored(fetched, "fetched")
        fetched = fetched.where("parts = 1").unionByName(_cut_down(fetched.where("parts > 1"), part))
    decided = stored(_decided(fetched), "decided")
    # Windows of grams in several parts: repeated if all parts together hold two.
    open_windows = decided.where("digest IS NOT NULL")
    more = open_windows.groupBy("g", "digest").agg(F.sum("weight").alias("all")).where("all > 1").select("g", "digest")
    joined = open_windows.where("c IS NOT NULL").join(more, ["g", "digest"], "left_semi")
    at = F.col("sample.at")
    whole = distinct.where("times > 1").select("g", "c", at.bitwiseAND(255).alias("low"), F.shiftright(at, 8).bitwiseAND(255).alias("high"))
    ranges = decided.where("digest IS NULL").select("g", "c", "low", "high").union(joined.select("g", "c", "low", "high")).union(whole)
    position = F.shiftright("at", 16)
    span = F.struct((position - F.col("high")).alias("start"), (position - F.col("low") + WINDOW).alias("end"))
    return places.join(ranges, ["g", "c"]).groupBy("k", "n").agg(F.collect_set(span).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs: overlapping and touching spans become one."""
    runs: list[list[int]] = []
    for start, end in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return [(s, e) for s, e in runs]


def without_repeats(documents: DataFrame, part: int | None = None) -> DataFrame:
    """``documents`` with n_bytes, removed (the maximal runs, as start and end) and kept (the remaining bytes)."""
    added = ("n_bytes", "removed", "kept")
    source = without(documents, *added, "__k", "__n", "__raw")
    spans = repeated_spans(source, part).select(F.col("k").alias("__k"), F.col("n").alias("__n"), "spans")
    text = text_or_empty()
    named = source.withColumns({"__k": F.xxhash64(text), "__n": F.octet_length(text).cast("bigint")})
    joined = named.join(spans.withColumnRenamed("spans", "__spans"), ["__k", "__n"], "left").drop("__k", "__n")
    joined = joined.withColumn("__spans", F.coalesce("__spans", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    names = source.columns
    position = [c.lower() for c in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for part in slices(batches):
            sizes, removed, kept = [], [], []
            for text, found in zip(part.column(position).to_pylist(), part.column(len(names)).to_pylist()):
                raw = (text or "").encode()
                runs = merged([(s["start"], s["end"]) for s in found or ()])
                edges = [0, *(x for r in runs for x in r), len(raw)]
                sizes.append(len(raw))
                removed.append([{"start": s, "end": e} for s, e in runs])
                kept.append(b"".join([raw[s:e] for s, e in zip(edges[::2], edges[1::2])]))
            columns = [pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pair)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *columns], [*names, *added])

    schema = f"{fields(source)}, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary"
    return joined.select(*source.columns, "__spans").mapInArrow(run, schema)


def drop_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with what is left of each text; n_chars, if there, is counted anew.

    Characters of which only some bytes are left go as well, as do rows whose text is gone altogether; texts that
    were empty before stay.
    """
    own = {c: f"__own_{i}" for i, c in enumerate(documents.columns) if c.lower() != "text"}
    found = without_repeats(documents.withColumnsRenamed(own)).where("size(removed) = 0 OR octet_length(kept) > 0")
    # Broken characters become U+FFFD; those of the text itself were whole, so none is lost with them but by a removal.
    cleaned = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    text = F.when(F.size("removed") > 0, cleaned).otherwise(F.col("text"))
    changed = found.withColumn("text", text).select(*(F.col(own.get(c, c)).alias(c) for c in documents.columns))
    if "n_chars" in changed.columns:
        kind = dict(documents.dtypes)["n_chars"]
        changed = changed.withColumn("n_chars", F.length("text").cast(kind))
    return changed


def _length(run: Column) -> Column:
    return run["end"] - run["start"]


def document_repeats(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = without_repeats(documents.select("doc_id", text_or_empty().alias("text")))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda total, run: total + _length(run))
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
