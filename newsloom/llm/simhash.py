"""SimHash fingerprints and their near-duplicate classes, compared bit-sliced.

A fingerprint bit is set if it is set in over half the hashes of the text's shingles. Candidates come from buckets: by pairs
of blocks of the fingerprint (with radius + 2 blocks, two fingerprints within the radius agree on two at
least, so nothing is lost; by triples of radius + 3 or quadruples of radius + 4 for very many fingerprints), or, for wide fingerprints and large radii, by pairs of minimal shingle hashes.

Within a bucket fingerprints lie vertically: plane b holds bit b of 64 of them. A fingerprint is compared with
64 at once: three planes of differences at a time go through a carry-save adder into bitwise counters, and the comparison
with a block of 64 is abandoned once all its counters exceed the radius. A bucket yields one edge per
fingerprint that is linked, to the smallest of its local component, not all pairs. A bucket larger
than `CELL` is cut into parts and compared part against part in separate groups, so that none grows with the input.

Where near duplicates are dropped, fingerprints only propose. They are made of the set of shingles, and the radius is wide enough to
lose next to none (`radius_for`). Of the texts with such a neighbour the sets are hashed again and brought into the buckets, and only pairs
with the Jaccard similarity asked for are linked. A pair that shares several buckets is compared in the first
one, if its texts have no reason to be in the others.

What fingerprints and buckets miss is found by an exact join of the sets (`missed_edges`). In any one order of all shingles two similar sets share one
of their first few; only there, and only between the classes found so far, pairs are compared: by sizes, by the parities of 512 parts of
the sets, which differ in no more places than the sets do, by how many of the first few they share, and then by the sets. Frequent shingles
come last in that order.

Equal fingerprints meet once. NULL and empty texts have the zero fingerprint, which is linked like any other. Rows
without doc_id are linked as well; a class of which no row has one has a NULL id. An empty table gives no
rows. Columns named like the added ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import text_or_empty, with_columns, without
from newsloom.llm.components import components
from newsloom.session import stored

BUCKET = 256  # fingerprints in a bucket, by the mean of all possible ones, beyond which keys get longer
CELL = 4096  # fingerprints of one bucket in one group
SEED = 42
BANDS, PER_BAND = 8, 2
BATCH = 1 << 15  # fingerprints compared in one go, apart from larger buckets
CELL_BYTES = 32 << 20  # shingle hashes of one bucket in one group
LOOKS = 8  # neighbours in each block of 64 that are looked at for one that no earlier bucket compares
PLANES = 12  # differences between two looks at whether a block is still alive
SAMPLE = 4096  # texts that show which shingles are frequent; it changes no link
FREQUENT, AMONG = 1 << 16, 4  # how many such shingles are told apart, and in how many of those texts each is at least
HELD = 1 << 20  # rows of one class and shingle looked at before they are passed on
LINK_CELL = 1 << 15  # rows of one shingle in one group
PAIRS = 1 << 18  # pairs compared in one go
PARITIES = 512


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of each shingle; of the whole sequence where it is shorter; none without words."""
    import xxhash

    words = text.encode().lower().split()  # on bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hashed(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    starts = np.append(0, ends[:-1] + 1)
    pairs = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.fromiter((hashed(joined[s:e], SEED) for s, e in pairs), np.uint64, len(words) - size + 1)


def _remixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Another hash of each hash; the same one for number 0."""
    if not number:
        return hashes
    x = hashes ^ np.uint64(number * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        block = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def with_fingerprints(
    df: DataFrame, shingle: int = 4, words: int = 1, bands: bool = False, text: str = "text", similarity: Fraction = Fraction(1), frequent: list[int] | None = None
) -> DataFrame:
    """``df`` with fingerprint, an array of 64-bit words, and, if asked for, band keys, and hash, size, prefix and parity of the set of shingles.

    With bands the fingerprint is that of the set: repeated shingles count once. ``similarity`` and ``frequent`` are for the prefix.
    """
    last = np.array(frequent or [], np.int64).view(np.uint64)

    def compute() -> Callable[[list[str]], list]:
        import xxhash

        rank = np.argsort(last, kind="stable")
        sorted_last = last[rank]

        def columns(texts: list[str]) -> list:
            prints, keys, nodes, sizes, prefixes, parities = [], [], [], [], [], []
            for hashes in (shingle_hashes(t, shingle) for t in texts):
                if bands:
                    hashes = np.unique(hashes)
                    nodes.append([xxhash.xxh64_intdigest(hashes.tobytes(), k) for k in range(2)])
                    sizes.append(len(hashes))
                    prefixes.append(prefix(hashes, similarity, sorted_last, rank).view(np.int64))
                    parities.append(parity(hashes))
                prints.append([majority(_remixed(hashes, k)) for k in range(words)])
                if bands:
                    least = [int(_remixed(hashes, 100 + k).min()) if len(hashes) else 0 for k in range(BANDS * PER_BAND)]
                    keys.append([hash_pair(least[k * PER_BAND : (k + 1) * PER_BAND]) for k in range(BANDS)])
            found = [pa.array([_signed(p) for p in prints], pa.list_(pa.int64()))]
            if bands:
                found += [pa.array([_signed(x) for x in some], pa.list_(pa.int64())) for some in (keys, nodes)]
                found.append(pa.array(sizes, pa.int64()))
                found += [pa.array(some, pa.list_(pa.int64())) for some in (prefixes, parities)]
            return found

        return columns

    added = "fingerprint array<bigint>" + ", bands array<bigint>, node array<bigint>, size bigint, prefix array<bigint>, parity array<bigint>" * bands
    return with_columns(df, text, added, compute)


def prefix(hashes: np.ndarray, similarity: Fraction, last: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set (sorted) in an order common to all sets, as many as make two similar sets share one of them.

    The order is that of the hashes, but for those in ``last`` (sorted), which come behind, by ``rank``.
    """
    least = -(-len(hashes) * similarity.numerator // similarity.denominator)
    if len(last):
        at = np.minimum(np.searchsorted(last, hashes), len(last) - 1)
        behind = last[at] == hashes
        if behind.any():
            hashes = hashes[np.argsort(np.where(behind, rank[at] + 1, 0), kind="stable")]
    return hashes[: len(hashes) - least + 1]


def parity(hashes: np.ndarray) -> np.ndarray:
    """Whether each of ``PARITIES`` parts of a set holds an odd number of hashes, as 64-bit words."""
    odd = np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def hash_pair(values: list[int]) -> int:
    mixed = 0
    for value in values:
        mixed = (mixed ^ value) * 0x9E3779B97F4A7C15 % 2**64
        mixed ^= mixed >> 31
    return mixed


def agreeing_blocks(fingerprints: int, radius: int) -> int:
    """How many blocks a key takes so that buckets stay small: 2, or up to 4 for more fingerprints. It changes no result."""
    agree = 2
    while agree < 4 and fingerprints >> 64 * agree // (radius + agree) > BUCKET:
        agree += 1
    return agree


def block_keys(radius: int, agree: int = 2) -> Column:
    """Keys of a one-word fingerprint: the bits of every choice of ``agree`` of its radius + agree blocks."""
    blocks = radius + agree
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(edges, edges[1:])]
    word = F.element_at("fingerprint", 1)
    signed = [int(_signed([sum(chosen)])[0]) for chosen in combinations(masks, agree)]
    return F.array(*(word.bitwiseAND(F.lit(mask).cast("bigint")) for mask in signed))


def linked_lanes(prints: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compare all fingerprints of each bucket, bit-sliced.

    ``prints`` (rows x words) lists bucket after bucket. Gives (row, first row of the block of 64, lanes):
    the lanes set are rows within the radius of the row, itself included.
    """
    total = 64 * prints.shape[1]
    # Blocks of 64 rows, whatever their buckets; plane b of a block has bit b of its rows.
    padded = np.zeros((-(-len(prints) // 64) * 64, prints.shape[1]), "<u8")
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little").reshape(-1, 64, total)
    packed = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    planes = np.ascontiguousarray(packed).view("<u8")[:, :, 0]
    # Every row meets the blocks that its bucket reaches into; lanes of other buckets count as exceeded.
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    low, high = starts[bucket], starts[bucket] + sizes[bucket]
    repeat = (high - 1) // 64 - low // 64 + 1
    row = np.repeat(np.arange(len(prints)), repeat)
    block = low[row] // 64 + np.arange(len(row)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    full = np.uint64(2**64 - 1)
    below = np.maximum(low[row] - 64 * block, 0).astype(np.uint64)
    above = np.maximum(64 * block + 64 - high[row], 0).astype(np.uint64)

    depth = max(2, radius.bit_length())
    counters = [np.zeros(len(row), np.uint64) for _ in range(depth)]
    over = ~((full << below) & (full >> above))

    def add(bits: np.ndarray, level: int) -> None:
        nonlocal over
        for k in range(level, depth):
            carry = counters[k] & bits
            counters[k] ^= bits
            bits = carry
        over |= bits

    def difference(bit: int) -> np.ndarray:
        word, shift = divmod(bit, 64)
        mine = (prints[:, word] >> np.uint64(shift)) & np.uint64(1)
        return planes[bit][block] ^ (np.uint64(0) - mine)[row]

    for bit in range(0, total, 3):
        if bit + 2 < total:
            a, b, c = (difference(bit + k) for k in range(3))
            add(a ^ b ^ c, 0)
            add((a & b) | (c & (a ^ b)), 1)
        else:
            for k in range(bit, total):
                add(difference(k), 0)
        if bit % PLANES == 0 or bit + 3 >= total:
            # Vertical comparison with the radius, from the highest counter down.
            more, same = over, ~over
            for k in reversed(range(depth)):
                if radius >> k & 1:
                    same = same & counters[k]
                else:
                    more = more | (same & counters[k])
                    same = same & ~counters[k]
            alive = ~more != 0
            if bit + 3 >= total:
                return row[alive], 64 * block[alive], ~more[alive]
            if alive.mean() < 0.9:
                row, block, over = row[alive], block[alive], over[alive]
                counters = [x[alive] for x in counters]
    raise AssertionError("a fingerprint has planes")


def _lowest(lanes: np.ndarray) -> np.ndarray:
    """Number of the lowest set lane."""
    return np.bitwise_count((lanes & (np.uint64(0) - lanes)) - np.uint64(1)).astype(np.int64)


def local_roots(prints: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """For each row the first row of its component within the bucket."""
    row, first, lanes = linked_lanes(prints, starts, sizes, radius)
    roots = np.arange(len(prints))
    own = np.uint64(1) << np.minimum(row - first, 63).clip(0).astype(np.uint64)
    alone = (np.bincount(row, minlength=len(prints)) == 1)[row] & (lanes == own) & (row >= first) & (row < first + 64)
    row, first, lanes = row[~alone], first[~alone], lanes[~alone]
    while len(row):
        # A row takes the smallest root among its neighbours: of each block the lowest lane's at once, and
        # the others' lane by lane while they still hold a smaller one.
        before = roots.copy()
        rest, live = lanes.copy(), np.arange(len(row))
        while len(live):
            neighbour = first[live] + _lowest(rest[live])
            np.minimum.at(roots, row[live], roots[neighbour])
            np.minimum.at(roots, neighbour, roots[row[live]])
            rest[live] &= rest[live] - np.uint64(1)
            # Lanes that already share the row's root have nothing to give.
            live = live[rest[live] != 0]
        while (roots != roots[roots]).any():
            roots = roots[roots]
        if (roots == before).all():
            return roots
    return roots


def bucket_edges(prints: DataFrame, keys: Column, radius: int, words: int) -> DataFrame:
    """Edges (a, b) between fingerprints that one bucket links, from distinct ``prints``."""
    located = prints.select("fingerprint", F.posexplode(keys).alias("kind", "key"))
    large = located.groupBy("kind", "key").count().where(F.col("count") > CELL)
    large = large.select(F.col("kind").alias("k"), F.col("key").alias("v"), F.ceil(F.col("count") / CELL).cast("int").alias("parts"))
    large = stored(large, "large-buckets")
    at = (F.col("kind") == F.col("k")) & (F.col("key") == F.col("v"))
    parted = located.join(large, at, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, part) * F.col("parts") + F.greatest(o, part))
    names = [f"w{k}" for k in range(words)]
    split = [F.element_at("fingerprint", k + 1).alias(name) for k, name in enumerate(names)]
    grouped = parted.select("kind", "key", F.explode(cells).alias("cell"), *split)
    width = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = grouped.repartition(width, "kind", "key", "cell").sortWithinPartitions("kind", "key", "cell", *names)
    out = [f"{side}{k}" for side in "ab" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(keys: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(rows)))
            several = sizes > 1
            chosen = np.repeat(several, sizes)
            rows, sizes = rows[chosen], sizes[several]
            starts = np.cumsum(sizes) - sizes
            found: list[np.ndarray] = []
            if len(rows):
                roots = local_roots(np.ascontiguousarray(rows).view(np.uint64), starts, sizes, radius)
                linked = np.flatnonzero(roots != np.arange(len(rows)))
                found = [np.hstack([rows[roots[linked]], rows[linked]])]
            values = np.concatenate(found) if found else np.zeros((0, 2 * words), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in values.T], out)

        held_keys, held_rows = np.zeros((0, 3), np.int64), np.zeros((0, words), np.int64)
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            held_keys = np.concatenate([held_keys, np.stack(columns[:3], axis=1)])
            held_rows = np.concatenate([held_rows, np.stack(columns[3:], axis=1)])
            if len(held_rows) < BATCH:
                continue
            # The last bucket may go on in the next batch.
            change = np.flatnonzero((held_keys[1:] != held_keys[:-1]).any(axis=1))
            if len(change):
                cut = int(change[-1]) + 1
                yield compared(held_keys[:cut], held_rows[:cut])
                held_keys, held_rows = held_keys[cut:], held_rows[cut:]
        if len(held_rows):
            yield compared(held_keys, held_rows)

    edges = dealt.mapInArrow(run, ", ".join(f"{name} bigint" for name in out))
    return edges.select(*(F.array(*(f"{side}{k}" for k in range(words))).alias(side) for side in "ab")).distinct()


def fingerprint_classes(prints: DataFrame, keys: Column, radius: int, words: int) -> DataFrame:
    """(fingerprint, root) for every fingerprint that is not the smallest of its class."""
    edges = bucket_edges(prints, keys, radius, words)
    return components(edges).withColumnRenamed("node", "fingerprint")


def classified(rows: DataFrame, keys: Column, radius: int, words: int) -> DataFrame:
    """``rows`` (with fingerprint) with component_id, the smallest doc_id of the class."""
    distinct = stored(rows.select("fingerprint", keys.alias("keys")).distinct(), "fingerprints")
    roots = fingerprint_classes(distinct, F.col("keys"), radius, words)
    rooted = rows.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    # Stored, so that no aggregation sits between the shuffle and the join and AQE can split a large class.
    least = stored(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "classes")
    return without(rooted, "component_id").join(least, "root").drop("root")


def linked_documents(documents: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """The contract's columns: fingerprint in hexadecimal and the smallest doc_id reachable by links."""
    texts = documents.select("doc_id", text_or_empty().alias("text"))
    rows = stored(with_fingerprints(texts, shingle).drop("text"), "simhash")
    found = classified(rows, block_keys(radius, agreeing_blocks(rows.count(), radius)), radius, 1)
    hexadecimal = F.lower(F.lpad(F.hex(F.element_at("fingerprint", 1)), 16, "0"))
    return found.select("doc_id", hexadecimal.alias("fingerprint"), "component_id")


# ---- near duplicates: fingerprints propose, sets of shingles decide ----


def with_sets(df: DataFrame, shingle: int) -> DataFrame:
    """``df`` with shingles, the sorted distinct shingle hashes as bytes."""

    def compute() -> Callable[[list[str]], list]:
        return lambda texts: [pa.array([np.unique(shingle_hashes(t, shingle)).astype("<u8").tobytes() for t in texts], pa.binary())]

    return with_columns(df, "text", "shingles binary", compute, rows=32)


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Sorted rows by whole cells (kind, key, cell, the first columns): the rows of cells with several, their starts and sizes."""

    def several(table: pa.Table, keys: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        sizes = np.diff(np.append(starts, len(keys)))
        table, sizes = table.filter(pa.array(np.repeat(sizes > 1, sizes))).combine_chunks(), sizes[sizes > 1]
        return table, np.cumsum(sizes) - sizes, sizes

    held: list[pa.RecordBatch] = []
    rows = bytes_held = 0
    for batch in batches:
        held.append(batch)
        rows, bytes_held = rows + batch.num_rows, bytes_held + batch.nbytes
        if rows < BATCH and bytes_held < CELL_BYTES:
            continue
        # The last cell may go on in the next batch.
        table = pa.Table.from_batches(held)
        keys = columns_of(table, ["kind", "key", "cell"])
        change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
        if len(change):
            cut = int(change[-1]) + 1
            yield several(table.slice(0, cut), keys[:cut])
            held = table.slice(cut).combine_chunks().to_batches()
            rows, bytes_held = sum(b.num_rows for b in held), sum(b.nbytes for b in held)
    if rows:
        table = pa.Table.from_batches(held)
        yield several(table, columns_of(table, ["kind", "key", "cell"]))


def columns_of(table: pa.Table, names: list[str]) -> np.ndarray:
    """Whole-number columns side by side."""
    if not table.num_rows:
        return np.zeros((0, len(names)), np.int64)
    return np.ascontiguousarray(np.stack([table.column(n).to_numpy().astype(np.int64) for n in names], axis=1))


def _dealt(rows: DataFrame) -> DataFrame:
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(width, "kind", "key", "cell").sortWithinPartitions("kind", "key", "cell", "n0", "n1")


def proposed_rows(prints: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int, bands: np.ndarray, kinds: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Which rows may have a neighbour within the radius that no earlier bucket and no other cell of this one compares them with."""
    row, first, lanes = linked_lanes(prints, starts, sizes, radius)
    inside = (row >= first) & (row < first + 64)
    lanes = lanes & ~np.where(inside, np.uint64(1) << np.where(inside, row - first, 0).astype(np.uint64), np.uint64(0))
    chosen = np.zeros(len(prints), bool)
    live = np.flatnonzero(lanes)
    for _ in range(LOOKS):
        mine, other = row[live], first[live] + _lowest(lanes[live])
        before = (bands[mine] == bands[other]) & (np.arange(bands.shape[1]) < kinds[mine][:, None])
        new = (sides[mine] != sides[other]) & ~before.any(axis=1)
        chosen[mine[new]] = chosen[other[new]] = True
        lanes[live] &= lanes[live] - np.uint64(1)
        live = live[(lanes[live] != 0) & ~chosen[row[live]]]
        if not len(live):
            return chosen
    chosen[row[live]] = True  # not looked at to the end: compared, needed or not
    return chosen


def similar_roots(prints: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int, sets: list[np.ndarray], similarity: Fraction) -> np.ndarray:
    """For each row the first row of its component within the bucket; pairs within the radius are linked by their sets."""
    row, first, lanes = linked_lanes(prints, starts, sizes, radius)
    # Each pair once, at its later row.
    below = np.clip(row - first, 0, 64)
    lanes = lanes & np.where(below == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(below, 63).astype(np.uint64)) - np.uint64(1))
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    roots = np.arange(len(prints))
    amounts = np.array([len(s) for s in sets])
    over, under = similarity.numerator, similarity.denominator

    def similar(i: int, j: int) -> bool:
        both = np.concatenate((sets[i], sets[j]))
        both.sort(kind="stable")
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        return common * under >= over * (len(both) - common)

    live = np.flatnonzero(lanes)
    while len(live):
        # One pair of each row at a time, so that most others are connected before they are looked at.
        at = live[np.append(True, row[live][1:] != row[live][:-1])]
        mine, other = row[at], first[at] + _lowest(lanes[at])
        lanes[at] &= lanes[at] - np.uint64(1)
        less, more = np.minimum(amounts[mine], amounts[other]), np.maximum(amounts[mine], amounts[other])
        tested = (roots[mine] != roots[other]) & (less * under >= more * over)
        pairs = [(i, j) for i, j in zip(mine[tested].tolist(), other[tested].tolist()) if similar(i, j)]
        if pairs:
            a, b = np.array(pairs).T
            while (roots[a] != roots[b]).any():
                np.minimum.at(roots, np.maximum(roots[a], roots[b]), np.minimum(roots[a], roots[b]))
                while (roots != roots[roots]).any():
                    roots = roots[roots]
            # Rows of their bucket's largest component have no business with each other any more.
            count, largest = np.bincount(roots, minlength=len(roots)), starts.copy()
            for k in np.flatnonzero(sizes > 2).tolist():
                largest[k] += count[starts[k] : starts[k] + sizes[k]].argmax()
            inside = roots == largest[bucket]
            padded = np.zeros(-(-len(roots) // 64) * 64, bool)
            padded[: len(roots)] = inside
            masks = np.packbits(padded, bitorder="little").view("<u8")
            done = live[inside[row[live]]]
            lanes[done] &= ~masks[first[done] // 64]
        live = live[lanes[live] != 0]
    return roots


def similar_edges(nodes: DataFrame, texts: DataFrame, radius: int, words: int, shingle: int, similarity: float) -> DataFrame:
    """Edges (a, b) between the sets of shingles that are similar, from ``nodes`` (one row per set) and ``texts`` (of nodes, by doc_id and __hash)."""
    names, keys = [f"w{k}" for k in range(words)], [f"b{k}" for k in range(BANDS)]
    ids = [F.element_at("node", k + 1).alias(f"n{k}") for k in range(2)]
    split = [F.element_at("fingerprint", k + 1).alias(name) for k, name in enumerate(names)]
    located = nodes.select("node", "fingerprint", "bands", "size", F.posexplode("bands").alias("kind", "key"))
    weighed = located.groupBy("kind", "key").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / CELL, F.sum("size") * 8 / CELL_BYTES)).cast("int").alias("parts"))
    large = stored(weighed.where("n > 1 AND parts > 1").select(F.col("kind").alias("k"), F.col("key").alias("v"), "parts"), "large-buckets")
    parted = located.join(large, (F.col("kind") == F.col("k")) & (F.col("key") == F.col("v")), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, part) * F.col("parts") + F.greatest(o, part))
    bands = [F.element_at("bands", k + 1).alias(name) for k, name in enumerate(keys)]
    spread = parted.select("kind", "key", F.explode(cells).alias("cell"), "parts", part.alias("part"), *ids, *split, *bands)
    # Rows of one part meet in the cell of that part alone.
    alone = F.expr("cell div parts = cell % parts")
    side = F.when(alone, F.col("n0")).otherwise(F.col("part").cast("bigint")).alias("side")
    dealt = _dealt(spread.select("kind", "key", F.col("cell").cast("bigint").alias("cell"), "n0", "n1", *names, *keys, side))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, sizes in whole_cells(batches):
            if len(sizes):
                held = columns_of(table, ["kind", "key", "cell", "n0", "n1"])
                prints = columns_of(table, names).view(np.uint64)
                chosen = proposed_rows(prints, starts, sizes, radius, columns_of(table, keys), held[:, 0], table.column("side").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in held[chosen].T], ["kind", "key", "cell", "n0", "n1"])

    found = stored(dealt.mapInArrow(propose, "kind bigint, key bigint, cell bigint, n0 bigint, n1 bigint"), "proposed")
    wanted = nodes.select(F.col("first.doc_id").alias("__id"), F.col("first.__hash").alias("__h"), *ids, *split).join(found.select("n0", "n1").distinct(), ["n0", "n1"], "left_semi")
    chosen = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")))
    sets = with_sets(chosen.select("n0", "n1", *names, "text"), shingle).drop("text")
    placed = _dealt(found.join(sets, ["n0", "n1"]).select("kind", "key", "cell", "n0", "n1", *names, "shingles"))
    exact = Fraction(str(similarity))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, sizes in whole_cells(batches):
            if len(sizes):
                held = columns_of(table, ["n0", "n1"])
                sets = [np.frombuffer(x.as_buffer(), "<u8") for chunk in table.column("shingles").chunks for x in chunk]
                roots = similar_roots(columns_of(table, names).view(np.uint64), starts, sizes, radius, sets, exact)
                linked = np.flatnonzero(roots != np.arange(len(roots)))
                both = np.hstack([held[roots[linked]], held[linked]])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in both.T], ["a0", "a1", "b0", "b1"])

    edges = placed.mapInArrow(decide, "a0 bigint, a1 bigint, b0 bigint, b1 bigint")
    return edges.select(F.array("a0", "a1").alias("a"), F.array("b0", "b1").alias("b")).distinct()


def with_shingles(df: DataFrame, shingle: int) -> DataFrame:
    """``df`` with shingles, the distinct shingle hashes."""

    def compute() -> Callable[[list[str]], list]:
        return lambda texts: [pa.array([np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts], pa.list_(pa.int64()))]

    return with_columns(df, "text", "shingles array<bigint>", compute, rows=32)


def frequent_shingles(texts: DataFrame, shingle: int) -> list[int]:
    """The shingles most frequent in some thousand distinct texts, the most frequent last. They order prefixes, and so change no link."""
    every = max(1, texts.count() // SAMPLE)
    some = texts.where(F.pmod("__hash", F.lit(every)) == 0).select("__hash", "text").dropDuplicates(["__hash"])
    counts = with_shingles(some.select("text"), shingle).select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    most = counts.where(F.col("n") >= AMONG).orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect()
    return [row["shingle"] for row in reversed(most)]


def close_pairs(
    starts: np.ndarray, counts: np.ndarray, classes: np.ndarray, sides: np.ndarray, sizes: np.ndarray, parities: np.ndarray, similarity: Fraction
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell, different classes and sides whose sets may be similar. Rows are sorted by class within each cell.

    No similar pair is left out: parities differ in no more places than the sets do.
    """
    over, under = similarity.numerator, similarity.denominator
    total = len(classes)
    changes = np.append(True, classes[1:] != classes[:-1])
    changes[starts] = True
    runs = np.append(np.flatnonzero(changes), total)
    behind = runs[np.cumsum(changes)]  # the first row of the next class or cell
    amount = np.repeat(starts + counts, counts) - behind
    upto = np.append(0, np.cumsum(amount))
    at = 0
    while at < total:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
        i = np.repeat(np.arange(at, to), amount[at:to])
        j = behind[i] + np.arange(len(i)) - (upto[i] - upto[at])
        less, more = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        fit = (less * under >= more * over) & (sides[i] != sides[j])
        i, j = i[fit], j[fit]
        apart = np.bitwise_count(parities[i] ^ parities[j]).sum(axis=1, dtype=np.int64)
        fit = apart * (under + over) <= (under - over) * (sizes[i] + sizes[j])
        if fit.any():
            yield i[fit], j[fit]
        at = to


def missed_edges(nodes: DataFrame, texts: DataFrame, roots: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """Edges (a, b) between all similar sets whose classes by ``roots`` (node, root) differ, from ``nodes`` and ``texts`` as in ``similar_edges``."""
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    located = nodes.join(roots, "node", "left").select(F.explode("prefix").alias("key"), F.xxhash64(F.coalesce("root", "node")).alias("n0"), F.col("num").alias("n1"))
    names = ["key", "n0", "n1"]

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose key is in several classes."""

        def passed(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names)

        held, known = np.zeros((0, 3), np.int64), None
        for batch in batches:
            rows = np.concatenate([held, columns_of(pa.Table.from_batches([batch]), names)])
            if not len(rows):
                continue
            starts = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
            ends = np.append(starts[1:], len(rows))
            chosen = rows[starts, 1] != rows[ends - 1, 1]
            chosen[0] |= rows[0, 0] == known
            # The last key may go on in the next batch; too many rows of one class go on unseen.
            chosen[-1] |= ends[-1] - starts[-1] > HELD
            known = rows[-1, 0] if chosen[-1] else None
            held = rows[:0] if chosen[-1] else rows[starts[-1] :].copy()
            if chosen.any():
                yield passed(rows[np.repeat(chosen, ends - starts)])

    dealt = located.repartition(width, "key").sortWithinPartitions(*names)
    found = stored(dealt.mapInArrow(several, "key bigint, n0 bigint, n1 bigint"), "shared")
    large = found.groupBy(F.col("key").alias("v")).agg(F.ceil(F.count("*") / LINK_CELL).cast("int").alias("parts")).where("parts > 1")
    parted = found.join(stored(large, "large-buckets"), F.col("key") == F.col("v"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("n1"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, part) * F.col("parts") + F.greatest(o, part))
    spread = parted.select("key", F.explode(cells).alias("cell"), "parts", part.alias("part"), "n0", "n1")
    side = F.when(F.expr("cell div parts = cell % parts"), F.col("n1")).otherwise(F.col("part").cast("bigint")).alias("side")
    words = [f"p{k}" for k in range(PARITIES // 64)]
    of_sets = nodes.select(F.col("num").alias("n1"), "size", *(F.element_at("parity", k + 1).alias(name) for k, name in enumerate(words)))
    kind, cell = F.lit(0).cast("bigint").alias("kind"), F.col("cell").cast("bigint").alias("cell")
    placed = _dealt(spread.join(of_sets, "n1").select(kind, "key", cell, "n0", "n1", side, "size", *words))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, counts in whole_cells(batches):
            if len(counts):
                classes, ids, sides, sizes = columns_of(table, ["n0", "n1", "side", "size"]).T
                for i, j in close_pairs(starts, counts, classes, sides, sizes, columns_of(table, words).view(np.uint64), similarity):
                    columns = (ids[i], ids[j], sizes[i], sizes[j])  # the smaller class first, whatever the key
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "size_a", "size_b"])

    # Of the prefix that ends first all but the shingles that may differ are in the other one.
    over, under = similarity.numerator, similarity.denominator
    counted = placed.mapInArrow(compare, "a bigint, b bigint, size_a bigint, size_b bigint").groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("n"))
    least = F.expr(f"(({over} * (size_a + size_b) + {over + under - 1}) div {over + under}) - (({over} * greatest(size_a, size_b) + {under - 1}) div {under}) + 1")
    pairs = stored(counted.where(F.col("n") >= least).select("a", "b"), "pairs")
    wanted = nodes.select(F.col("first.doc_id").alias("__id"), F.col("first.__hash").alias("__h"), "num", "node")
    # Stored, so that where they are few the texts need not be shuffled to meet them.
    wanted = stored(wanted.join(pairs.select(F.explode(F.array("a", "b")).alias("num")).distinct(), "num", "left_semi"), "wanted")
    chosen = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h"))).select("num", "node", "text").dropDuplicates(["num"])
    sets = stored(with_shingles(chosen, shingle).drop("text"), "sets")
    sides = [sets.select(F.col("num").alias(x), F.col("node").alias(f"node_{x}"), F.col("shingles").alias(f"set_{x}")) for x in "ab"]
    together = pairs.join(sides[0], "a").join(sides[1], "b")
    common = F.size(F.array_intersect("set_a", "set_b")).cast("bigint")
    union = F.size("set_a") + F.size("set_b") - common
    similar = common * under >= union * over
    return together.where(similar).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


@cache
def _differing(similarity: float) -> float:
    """The largest expected share of differing bits of two sets at least so similar: of large sets, and of small ones, where ties matter."""
    largest = math.acos(2 * similarity / (1 + similarity)) / math.pi
    least = Fraction(str(similarity))
    for common in range(1, 17):
        for a in range(common + 1):
            for b in range(a, common + 1):
                if Fraction(common, common + a + b) < least:
                    break
                share = 0.0
                for ones in range(common + 1):
                    p, q = (sum(math.comb(n, k) for k in range(n + 1) if 2 * (ones + k) > common + n) / 2**n for n in (a, b))
                    share += math.comb(common, ones) / 2**common * (p * (1 - q) + q * (1 - p))
                largest = max(largest, share)
    return largest


def radius_for(similarity: float, words: int) -> int:
    """Differing bits that sets at least so similar pass only beyond four standard deviations, whatever their sizes."""
    share, bits = _differing(similarity), 64 * words
    return round(bits * share + 4 * math.sqrt(bits * share * (1 - share)))


def drop_near_duplicates(documents: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 8) -> DataFrame:
    """``documents`` with one row of each class of near duplicates: one with the smallest doc_id.

    Texts are near duplicates if the Jaccard similarity of their shingle sets is ``similarity`` or more, and in one class
    if a chain of such pairs connects them; no such pair is missed. Texts are hashed where they are read. Rows without a doc_id stay only where no
    row of their class has one. Among rows equal in doc_id and text any one stays.
    """
    # The key of a row within its class; distinct texts with one doc_id are ordered by their hash.
    keyed = without(documents, "__hash", "__keep", "__copies").withColumn("__hash", F.xxhash64(text_or_empty()))
    texts = keyed.select("doc_id", F.col("__hash"), text_or_empty().alias("text"))
    exact = Fraction(str(similarity))
    rows = stored(with_fingerprints(texts, shingle, words, bands=True, similarity=exact, frequent=frequent_shingles(texts, shingle)).drop("text"), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__hash"))
    sets = rows.groupBy("node", "fingerprint", "bands", "size").agg(first.alias("first"), *(F.any_value(c).alias(c) for c in ("prefix", "parity")))
    nodes = stored(sets.withColumn("num", F.monotonically_increasing_id()), "fingerprints")
    edges = stored(similar_edges(nodes, texts, radius_for(similarity, words), words, shingle, similarity), "links")
    roots = components(edges)
    missed = stored(missed_edges(nodes, texts, roots, shingle, exact), "links")
    if not missed.isEmpty():
        roots = components(edges.unionByName(missed))
    rooted = rows.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "doc_id", "__hash")
    kept = rooted.groupBy("root").agg(first.alias("first")).select(F.col("first.doc_id").alias("__keep"), F.col("first.__hash").alias("__h"))
    copies = rows.groupBy("doc_id", "__hash").count().where("count > 1").select(F.col("doc_id").alias("__twice"), F.col("__hash").alias("__t"))
    kept = stored(kept.join(copies, F.col("__keep").eqNullSafe(F.col("__twice")) & (F.col("__h") == F.col("__t")), "left").select("__keep", "__h", F.col("__t").isNotNull().alias("__copies")), "kept")
    stays = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("__keep")) & (F.col("__hash") == F.col("__h")))
    once = stays.where("NOT __copies")
    several = stays.where("__copies").dropDuplicates(["doc_id", "__hash"])
    return once.unionByName(several).drop("__hash", "__keep", "__h", "__copies")
