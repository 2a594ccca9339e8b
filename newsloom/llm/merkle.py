"""Merkle manifest of a dataset, its upper proofs gathered by butterfly exchange.

Every row is a leaf. The leaves of a group (here: a language) ascend by their order column; every `FANOUT` consecutive nodes become
the hash of their digests until one, the group's subroot, is left; the subroots in turn lead to the root. A proof lists, level by level,
the digests to the left and to the right of the path; ``folded`` recomputes the root from a leaf and its proof.

Leaves are dealt to aligned blocks of `BLOCK` = 8^3 consecutive ones. A first pass over the blocks hashes the root of each. Then blocks
exchange: in round r a block meets the blocks whose numbers differ from its own in octal digit r only, and each passes on the root of the
8^r blocks that it stands for. All of them hash the common ancestor, redundantly, so after the last round each block
holds the root and the digests beside its whole upper path, and no pass leads down again. At the ragged end of a group, where a
subtree has fewer blocks than its peers, its blocks stand in for the missing ones, each for an equal share. A round shuffles one narrow
row per block. Subroots exchange in the same way. A second pass over the blocks puts the lower levels
in front.

No task holds more than a block and no node more than eight digests, however large a group is; the driver sees numbers of rows only.

A NULL group is a group of its own and comes first, as do rows with a NULL in the order column within their group; rows that tie there are
ordered by leaf, so equal rows may swap without changing any digest. Empty texts are values of zero bytes, not NULL. Texts are hashed whole
where they are read, at any length. An empty table has no rows and no root. Other columns are carried along; those named like the added ones
are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import fields, quoted, without
from newsloom.operators.ordering import number_rows
from newsloom.session import stored

FANOUT = 8
LEVELS = 3  # levels of a block
BLOCK = FANOUT**LEVELS
PROOF = "array<struct<left: string, right: string>>"


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 of columns in hexadecimal: `-` for NULL, else the number of UTF-8 bytes, a colon, the value."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, one after the other."""
    return F.aggregate(proof, F.lit(""), lambda text, level: F.concat(text, level["left"], level["right"]))


def _height(count: int) -> int:
    levels = 0
    while count > 1:
        count = -(-count // FANOUT)
        levels += 1
    return levels


def exchanged(nodes: DataFrame) -> DataFrame:
    """Butterfly exchange of (g, p, n, digest): upper (the proof of node p among the n of its group) and top (their root).

    Positions p are gapless from 0 within a group g.
    """
    held = nodes.withColumns({"upper": F.array().cast(PROOF), "top": F.col("digest")})
    most = nodes.agg(F.max("n")).first()[0] or 0
    for turn in range(_height(most)):
        span, wide = FANOUT**turn, FANOUT ** (turn + 1)
        start = F.floor(F.col("p") / wide) * wide
        digit, low = F.floor((F.col("p") - start) / span), F.col("p") % span
        # Blocks present in the subtree that a block stands for; each also serves its share of those missing, if anyone asks.
        present = F.least(F.lit(span), F.col("n") - start - digit * span)
        several = (start > 0) | (F.col("n") > span)
        alone = F.col("n") - start <= span
        last = F.when(alone, low).otherwise(F.lit(span - 1))
        held = held.withColumns({"__start": start, "__digit": digit, "__low": low})
        sent = held.where(F.col("n") > span).withColumn("__for", F.explode(F.sequence(low, last, present)))
        meeting = ["g", "__start", "__for"]
        met = sent.groupBy(*meeting).agg(F.array_sort(F.collect_list(F.struct("__digit", F.col("top").alias("d")))).alias("__met"))
        joined = held.join(met.withColumnRenamed("__for", "__low"), ["g", "__start", "__low"], "left")

        def digests(keep) -> Column:
            return F.array_join(F.transform(F.filter("__met", keep), lambda x: x["d"]), "")

        level = F.struct(digests(lambda x: x["__digit"] < F.col("__digit")).alias("left"), digests(lambda x: x["__digit"] > F.col("__digit")).alias("right"))
        active = several & F.col("__met").isNotNull()
        held = joined.select(
            "g",
            "p",
            "n",
            "digest",
            F.when(active, F.concat("upper", F.array(level))).otherwise(F.col("upper")).cast(PROOF).alias("upper"),
            F.when(active, F.sha2(digests(lambda x: F.lit(True)), 256)).otherwise(F.col("top")).alias("top"),
        )
        held = stored(held, "exchanged")
    return held


def _levels(leaves: list[str], count: int) -> list[list[str]]:
    """Nodes of a block by level, its root last; a block that is its whole group ends where one node is left."""
    rows = [leaves]
    for _ in range(_height(count) if count <= BLOCK else LEVELS):
        below = rows[-1]
        runs = ("".join(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT))
        rows.append([hashlib.sha256(run.encode()).hexdigest() for run in runs])
    return rows


def _blocks(batches: Iterator[pa.RecordBatch], keys: Sequence[int]) -> Iterator[pa.Table]:
    """The rows of one block at a time, from rows that are sorted by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in keys])
        edges = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        first = values[:, 0].tolist()
        if held and first != [held[-1].column(i)[-1].as_py() for i in keys]:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *edges.tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if start:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _dealt(rows: DataFrame) -> DataFrame:
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(width, "__g", "__b").sortWithinPartitions("__g", "__b", "__p")


def _block_roots(leaves: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, (0, 1)):
            g, b, n = (block.column(i)[0].as_py() for i in (0, 1, 3))
            root = _levels(block.column(4).to_pylist(), n)[-1][0]
            yield pa.RecordBatch.from_pydict({"g": [g], "p": [b], "n": [-(-n // BLOCK)], "digest": [root]})

    narrow = _dealt(leaves.select("__g", "__b", "__p", "__n", "__leaf"))
    return narrow.mapInArrow(run, "g bigint, p bigint, n bigint, digest string")


def _with_lower_levels(leaves: DataFrame, uppers: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the leaves with subroot, root and proof; a block's upper digests travel as its first row."""
    heads = uppers.select(F.lit(-1).cast("bigint").alias("__p"), "__g", "__b", "__n", "__upper", "__subroot", "__root")
    rows = _dealt(leaves.unionByName(heads, allowMissingColumns=True))
    names = rows.columns
    at = {name: i for i, name in enumerate(names)}
    kind = pa.struct([("left", pa.string()), ("right", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, (at["__g"], at["__b"])):
            head, below = block.slice(0, 1), block.slice(1)
            upper = [(x["left"], x["right"]) for x in head.column(at["__upper"])[0].as_py()]
            levels = _levels(below.column(at["__leaf"]).to_pylist(), head.column(at["__n"])[0].as_py())[:-1]
            sides = []
            for nodes in levels:
                runs = [i - i % FANOUT for i in range(len(nodes))]
                sides.append([("".join(nodes[s:i]), "".join(nodes[i + 1 : s + FANOUT])) for i, s in enumerate(runs)])
            proofs = [(*(side[i // FANOUT**k] for k, side in enumerate(sides)), *upper) for i in range(below.num_rows)]
            flat = [level for proof in proofs for level in proof]
            pairs = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.string()) for k in (0, 1)], fields=list(kind))
            ends = np.arange(below.num_rows + 1, dtype=np.int32) * (len(sides) + len(upper))
            added = [pa.array([head.column(at[c])[0].as_py()] * below.num_rows, pa.string()) for c in ("__subroot", "__root")]
            kept = [below.column(at[c]).combine_chunks() for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *added, pa.ListArray.from_arrays(ends, pairs)], [*columns, "subroot", "root", "proof"])

    return rows.mapInArrow(run, f"{fields(leaves.select(*map(quoted, columns)))}, subroot string, root string, proof {PROOF}")


def manifest(leaves: DataFrame, group: str, order: str, leaf: str = "leaf") -> DataFrame:
    """``leaves`` (a digest per row, and whatever else they carry) with subroot, root and proof.

    ``leaves`` is read twice; it should be narrow and stored.
    """
    source = without(leaves, "subroot", "root", "proof")
    kept = source.columns
    renamed = source.withColumns({"__leaf": F.col(quoted(leaf)), "__lang": F.col(quoted(group)), "__at": F.col(quoted(order))})
    numbered, _ = number_rows(renamed, ["__lang", "__at", "__leaf"], "__number")
    # One row per group: where it starts and how many leaves it has.
    sizes = numbered.groupBy("__lang").agg(F.min("__number").alias("__first"), F.count("*").alias("__n"))
    groups, total = number_rows(stored(sizes, "groups"), ["__lang"], "__g")
    groups = stored(groups.select(F.col("__lang").alias("__of"), "__first", "__n", "__g"), "groups")
    joined = numbered.join(groups, F.col("__lang").eqNullSafe(F.col("__of"))).withColumn("__p", F.col("__number") - F.col("__first"))
    placed = joined.withColumn("__b", F.floor(F.col("__p") / BLOCK)).select("__g", "__b", "__p", "__n", "__leaf", *map(quoted, kept))
    blocks = exchanged(stored(_block_roots(placed), "block-roots"))
    subroots = blocks.where("p = 0").select(F.lit(0).cast("bigint").alias("g"), F.col("g").alias("p"), F.lit(total).cast("bigint").alias("n"), F.col("top").alias("digest"))
    tops = exchanged(stored(subroots, "subroots"))
    tops = tops.select(F.col("p").alias("__g"), F.col("digest").alias("__subroot"), F.col("top").alias("__root"), F.col("upper").alias("__over"))
    uppers = blocks.select(F.col("g").alias("__g"), F.col("p").alias("__b"), "upper").join(tops, "__g").join(groups.select("__g", "__n"), "__g")
    uppers = uppers.withColumn("__upper", F.concat("upper", "__over")).drop("upper", "__over")
    return _with_lower_levels(placed, uppers, kept)


def document_manifest(documents: DataFrame) -> DataFrame:
    """The contract's columns, with a tampering that the root exposes.

    A NULL doc_id is never tampered with.
    """
    text = F.col("text").cast("string")
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    claimed = F.when(chosen, leaf_digest(*others, lowered))
    leaves = documents.select("doc_id", "lang", leaf_digest(*others, text).alias("leaf"), claimed.alias("__claimed"))
    found = manifest(stored(leaves, "leaves"), "lang", "doc_id")
    root = folded(F.coalesce("__claimed", "leaf"), F.col("proof"))
    result = found.withColumn("folded_root", root).withColumn("proof_sha256", F.sha2(siblings(F.col("proof")), 256))
    return result.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
