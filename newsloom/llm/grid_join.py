"""Near-duplicate vectors by an epsilon grid order join.

Two vectors are linked if their cosine, in double precision, reaches a threshold; as points of the unit sphere they are then at
most `eps` apart. The distinct vectors are projected on their leading principal dimensions, put into cells of side `eps` there and sorted by
the cells' coordinates, then by the coordinates. A projection does not lengthen distances, so two stretches of this order, *intervals*,
need no comparison if their bounding boxes there are further apart than `eps`.

The join starts with the whole order against itself and splits intervals in `SPLIT`, round by round, as a table of pairs of intervals that
joins with the table of boxes; pairs that are provably distant go at once. What is left are pairs of intervals of `SPLIT` blocks.
Their blocks, `BLOCK` vectors each in one row, are dealt to these pairs; a task goes on splitting down to pieces of
`PIECE` vectors, and compares those by matrix products: in single precision first, and all that come near the threshold in double.
A task holds one pair of intervals whatever the data. From each pair of blocks come numbers of links and a spanning forest of
them, not the pairs themselves, so a dense cluster costs comparisons but no rows.

Equal vectors are one vector with a number of copies, so copies meet nowhere. The principal dimensions are fitted to at most `SAMPLE`
vectors, those with the least hash, on the driver: any axes give the same links, good ones skip more. Where vectors fill all dimensions alike
few blocks are distant, and the comparisons grow with the square of their number; that is the price of missing no link.

Vectors that are NULL, empty or zero, or that hold a NULL, NaN or infinity, link with nothing, nor do vectors of different lengths. Rows
with a repeated or NULL vec_id each count as a vector; component_id is the smallest vec_id of the component that is not NULL. An
empty table gives no rows. Long vectors make blocks of fewer vectors. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from newsloom.llm.common import quoted
from newsloom.llm.components import components
from newsloom.operators.ordering import number_rows
from newsloom.session import stored

AXES = 8  # leading principal dimensions
SAMPLE = 4096
SPLIT = 8
BLOCK = 1024
PIECE = 256
SLACK = 1e-4  # what single precision may lose of a cosine
LOWS, HIGHS = [f"low{k}" for k in range(AXES)], [f"high{k}" for k in range(AXES)]
CELLS, PLACES = [f"cell{k}" for k in range(AXES)], [f"place{k}" for k in range(AXES)]


def usable(vector: Column) -> Column:
    """Vectors that have a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    # Divided by the largest component first, since squares may exceed the range of doubles.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The leading principal dimensions, as columns, of the ``sample`` vectors (k1, vector) with the least hash."""
    chosen = [r.vector for r in vectors.orderBy("k1").limit(sample).select("vector").collect()]
    if not chosen:
        return np.zeros((1, AXES))
    width = max(map(len, chosen))
    units = np.zeros((len(chosen), width))
    for i, vector in enumerate(chosen):
        units[i, : len(vector)] = _units(np.array([vector]))[0]
    units -= units.mean(axis=0)
    _, axes = np.linalg.eigh(units.T @ units)
    leading = axes[:, ::-1][:, :AXES]
    return np.pad(leading, ((0, 0), (0, AXES - leading.shape[1])))


def _matrix(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the rows, rows) of the vectors of each length."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield rows, flat[offsets[rows][:, None] + np.arange(length)]


def _placed(vectors: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """``vectors`` (k1, k2, vector, copies, least) with cells and places on the leading dimensions."""
    names = vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.zeros((batch.num_rows, AXES))
            for rows, matrix in _matrix(batch.column(names.index("vector"))):
                shared = min(matrix.shape[1], len(axes))
                places[rows] = _units(matrix)[:, :shared] @ axes[:shared]
            cells = np.floor(places / eps).astype(np.int32)
            added = [pa.array(np.ascontiguousarray(c)) for c in (*cells.T, *places.T)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*names, *CELLS, *PLACES])

    kinds = ", ".join([*(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in vectors.schema), *(f"{c} int" for c in CELLS), *(f"{c} double" for c in PLACES)])
    return vectors.mapInArrow(run, kinds)


def _blocks(numbered: DataFrame, block: int) -> DataFrame:
    """One row per block of the order: its number, first vector, vectors as lists of numbers, copies and bounding box."""
    kind = numbered.schema["vector"].dataType.elementType
    rows = numbered.select(F.floor(F.col("number") / block).alias("block"), "number", "vector", "copies", *PLACES)
    width = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(width, "block").sortWithinPartitions("number")
    names = ["block", "number", "vectors", "copies", *LOWS, *HIGHS]

    def made(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        places = np.stack([table.column(c).to_numpy() for c in PLACES], axis=1)
        lists = [table.column(c).combine_chunks() for c in ("vector", "copies")]
        lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
        ends = pa.array([0, table.num_rows], pa.int32())
        own = [pa.array([table.column(c)[0].as_py()], pa.int64()) for c in ("block", "number")]
        boxes = [pa.array([float(x)]) for x in (*places.min(axis=0), *places.max(axis=0))]
        return pa.RecordBatch.from_arrays([*own, *(pa.ListArray.from_arrays(ends, x) for x in lists), *boxes], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), batch.num_rows]
            if held and numbers[0] != held[-1].column(0)[-1].as_py():
                yield made(held)
                held = []
            for start, end in zip(cuts, cuts[1:]):
                if start:
                    yield made(held)
                    held = []
                held.append(batch.slice(start, end - start))
        if held:
            yield made(held)

    element = kind.simpleString()
    schema = f"block bigint, number bigint, vectors array<array<{element}>>, copies array<bigint>, " + ", ".join(f"{c} double" for c in (*LOWS, *HIGHS))
    return dealt.mapInArrow(run, schema)


def _boxes(blocks: DataFrame, level: int) -> DataFrame:
    bounds = [*(F.min(c).alias(c) for c in LOWS), *(F.max(c).alias(c) for c in HIGHS)]
    return blocks.groupBy(F.floor(F.col("block") / SPLIT**level).alias("at")).agg(*bounds)


def interval_pairs(blocks: DataFrame, count: int, eps: float) -> DataFrame:
    """(a, b), a <= b: intervals of `SPLIT` blocks that are not provably distant, by splitting the whole order against itself."""
    levels = 1
    while SPLIT**levels < count:
        levels += 1
    boxes = stored(blocks.select("block", *LOWS, *HIGHS), "boxes")
    pairs = boxes.sparkSession.createDataFrame([(0, 0)], "a bigint, b bigint")
    for level in range(levels - 1, 0, -1):
        parts = stored(_boxes(boxes, level).withColumn("of", F.floor(F.col("at") / SPLIT)), "intervals")
        left = parts.select(F.col("of").alias("a"), F.col("at").alias("x"), *(F.col(c).alias(f"x_{c}") for c in (*LOWS, *HIGHS)))
        right = parts.select(F.col("of").alias("b"), F.col("at").alias("y"), *(F.col(c).alias(f"y_{c}") for c in (*LOWS, *HIGHS)))
        apart = [F.greatest(F.lit(0.0), F.col(f"x_{low}") - F.col(f"y_{high}"), F.col(f"y_{low}") - F.col(f"x_{high}")) for low, high in zip(LOWS, HIGHS)]
        distance = sum((a * a for a in apart), F.lit(0.0))
        near = pairs.join(left, "a").join(right, "b").where((F.col("x") <= F.col("y")) & (distance <= eps * eps))
        pairs = stored(near.select(F.col("x").alias("a"), F.col("y").alias("b")), "pairs")
    return pairs


class _Block:
    """Vectors of a block as units in both precisions, and boxes of its pieces on the leading dimensions."""

    def __init__(self, number: int, vectors: pa.ListArray, copies: np.ndarray, axes: np.ndarray) -> None:
        self.number, self.copies = number, copies
        self.lengths = np.diff(vectors.offsets.to_numpy())
        width = max(int(self.lengths.max()), len(axes))
        self.units = np.zeros((len(copies), width))
        for rows, matrix in _matrix(vectors):
            self.units[rows, : matrix.shape[1]] = _units(matrix)
        places = self.units[:, : len(axes)] @ axes
        starts = np.arange(0, len(copies), PIECE)
        self.low, self.high = np.minimum.reduceat(places, starts), np.maximum.reduceat(places, starts)
        self.single = self.units.astype(np.float32)

    def box(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the pieces from one to another."""
        return self.low[start:end].min(axis=0), self.high[start:end].max(axis=0)


def _candidates(one: _Block, two: _Block, first: tuple[int, int], second: tuple[int, int], eps: float) -> Iterator[tuple[int, int]]:
    """Pairs of pieces of two blocks that are not provably distant, by halving the longer interval."""
    (low, high), (below, above) = one.box(*first), two.box(*second)
    apart = np.maximum(0.0, np.maximum(low - above, below - high))
    if apart @ apart > eps * eps or (one is two and first[0] >= second[1]):
        return
    if first[1] - first[0] == 1 and second[1] - second[0] == 1:
        yield first[0], second[0]
    elif first[1] - first[0] >= second[1] - second[0]:
        middle = (first[0] + first[1]) // 2
        yield from _candidates(one, two, (first[0], middle), second, eps)
        yield from _candidates(one, two, (middle, first[1]), second, eps)
    else:
        middle = (second[0] + second[1]) // 2
        yield from _candidates(one, two, first, (second[0], middle), eps)
        yield from _candidates(one, two, first, (middle, second[1]), eps)


def linked(one: _Block, two: _Block, cosine: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``one``, row of ``two``) whose cosine reaches the threshold; of one block with itself each pair once."""
    width = max(one.units.shape[1], two.units.shape[1])
    found = []
    pieces = _candidates(one, two, (0, len(one.low)), (0, len(two.low)), eps)
    for i, j in pieces:
        rows, columns = slice(i * PIECE, (i + 1) * PIECE), slice(j * PIECE, (j + 1) * PIECE)
        shared = min(one.units.shape[1], two.units.shape[1], width)
        near = one.single[rows, :shared] @ two.single[columns, :shared].T >= cosine - SLACK
        if one is two:
            near &= np.arange(len(near))[:, None] + i * PIECE < np.arange(near.shape[1]) + j * PIECE
        a, b = np.nonzero(near)
        if not len(a):
            continue
        if len(a) * 8 > near.size:
            exact = (one.units[rows, :shared] @ two.units[columns, :shared].T)[a, b]
        else:
            exact = np.einsum("ij,ij->i", one.units[rows, :shared][a], two.units[columns, :shared][b])
        a, b = a + i * PIECE, b + j * PIECE
        kept = (exact >= cosine) & (one.lengths[a] == two.lengths[b])
        found.append((a[kept], b[kept]))
    if not found:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member) of the classes that pairs of numbers make, for all but the least."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        np.minimum.at(root, before, root.copy())
        root = root[root]
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _compared(blocks: DataFrame, pairs: DataFrame, axes: np.ndarray, cosine: float, eps: float) -> DataFrame:
    """(number, links, other): vectors linked with ``number`` by a pair of blocks, counted with copies; or an edge to ``other``."""
    width = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("interval"))
    parts = blocks.select("block", "number", "vectors", "copies", F.floor(F.col("block") / SPLIT).alias("interval"))
    dealt = parts.join(ends, "interval").select("a", "b", "block", "number", "vectors", "copies")
    dealt = dealt.repartition(width, "a", "b").sortWithinPartitions("a", "b", "block")
    names = ["number", "links", "other"]

    def compared(pair: tuple[int, int], held: list[_Block], numbers: list[int]) -> Iterator[pa.RecordBatch]:
        own = [x for x, n in zip(held, numbers) if n // SPLIT == pair[0]]
        rest = own if pair[0] == pair[1] else [x for x, n in zip(held, numbers) if n // SPLIT == pair[1]]
        for i, one in enumerate(own):
            for two in rest[i:] if rest is own else rest:
                a, b = linked(one, two, cosine, eps)
                if not len(a):
                    continue
                for block, at, to in ((one, a, two.copies[b]), (two, b, one.copies[a])):
                    sums = np.bincount(at, weights=to, minlength=len(block.copies)).astype(np.int64)
                    some = np.flatnonzero(sums)
                    yield rows(some + block.number, sums[some], None)
                yield rows(*_swapped(_forest(a + one.number, b + two.number)))

    def _swapped(edges: tuple[np.ndarray, np.ndarray]) -> tuple:
        return edges[0], None, edges[1]

    def rows(number: np.ndarray, links: np.ndarray | None, other: np.ndarray | None) -> pa.RecordBatch:
        columns = [pa.nulls(len(number), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (number, links, other)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Block] = []
        numbers: list[int] = []
        last = None
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, block, number = (batch.column(k)[i].as_py() for k in range(4))
                if last != (a, b):
                    if held:
                        yield from compared(last, held, numbers)
                    held, numbers, last = [], [], (a, b)
                copies = batch.column(5)[i].values.to_numpy(zero_copy_only=False)
                held.append(_Block(number, batch.column(4)[i].values, copies, axes))
                numbers.append(block)
        if held:
            yield from compared(last, held, numbers)

    return dealt.mapInArrow(run, "number bigint, links bigint, other bigint")


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row, linking vectors of at least this ``cosine`` (above 0)."""
    kind = T.FloatType() if rows.schema[vector].dataType.elementType == T.FloatType() else T.DoubleType()
    values = F.col(quoted(vector)).cast(T.ArrayType(kind))
    # Two hashes name a vector; those that are of no use have no name.
    named = rows.select(F.col(quoted(vec_id)).alias("vec_id"), F.when(usable(values), values).alias("vector"))
    known = F.col("vector").isNotNull()
    k1, k2 = F.when(known, F.xxhash64("vector")), F.when(known, F.xxhash64(F.lit(1), "vector"))
    named = stored(named.select("vec_id", "vector", k1.alias("k1"), k2.alias("k2")), "vectors")
    grouped = named.where(known).groupBy("k1", "k2")
    classes = stored(grouped.agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least")), "classes")
    # A little more than the distance that belongs to the threshold, for rounding.
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    axes = principal_axes(classes)
    placed = stored(_placed(classes, axes, eps), "placed")
    numbered, count = number_rows(placed, [*CELLS, *PLACES], "number")
    blocks = stored(_blocks(numbered, block), "blocks")
    pairs = interval_pairs(blocks, -(-count // block), eps)
    found = stored(_compared(blocks, pairs, axes, cosine, eps), "links")
    links = found.where("links IS NOT NULL").groupBy("number").agg(F.sum("links").alias("links"))
    roots = components(found.where("other IS NOT NULL").select(F.col("number").alias("a"), F.col("other").alias("b")))
    joined = numbered.select("number", "k1", "k2", "copies", "least").join(links, "number", "left")
    rooted = joined.join(roots.withColumnRenamed("node", "number"), "number", "left").withColumn("root", F.coalesce("root", "number"))
    rooted = stored(rooted.select("k1", "k2", "copies", "least", "root", F.coalesce("links", F.lit(0)).alias("links")), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    judged = rooted.join(least, "root").select("k1", "k2", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("judged"))
    result = named.select("vec_id", "k1", "k2").join(stored(judged, "judged"), ["k1", "k2"], "left")
    component = F.when(F.col("judged"), F.col("component_id")).otherwise(F.col("vec_id"))
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def linked_embeddings(embeddings: DataFrame) -> DataFrame:
    """The contract's columns."""
    return near_vectors(embeddings.select("vec_id", "embedding"))
