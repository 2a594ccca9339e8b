"""Temperature mixing of sources, in Column expressions only.

With p the shares of the sources in all tokens, weights are p**t, normalised. The exponent t is bisected in [0, 1] (1: as
found, 0: all alike) until the entropy of the weights reaches a target, or until no source is
repeated more than `limit` times as often as any other. Weights times budget give each source its tokens. Without a
budget the smallest one holds in which every document is used at least once.

A source's tokens are realised as whole rounds over its documents plus a part of one round. Its documents are
dealt into blocks by hash; each round permutes the blocks, and the part of a round takes the first
blocks of its permutation until its tokens are met, cutting the last block by row hash: sums of its pieces tell in which piece, and
that piece alone is ordered. So the documents of a source never are, and a document is known to be in by two comparisons. `order`
columns (round, block_rank, row_rank) give the training order of a source.

A NULL source is a source of its own. Documents without tokens (NULL or empty text) come along in the whole rounds;
a source without any tokens has one round. An empty table gives no rows. Rows equal in source, doc_id and text share a
hash and are taken together, so a cut is exact up to those. Columns named like the added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.llm.common import WORD, quoted, text_or_empty, without
from newsloom.session import stored

BLOCKS = 1024  # per source
PIECE_BITS = 10  # of the block in which a part round ends: rows ordered are a millionth of the source's
GRID = 16  # exponents tried at once: a step of the bisection narrows the range 17-fold
STEPS = 6


def _profile(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent: the entropy of the weights in bits, and how often the most repeated source is, against the least."""
    columns = []
    for i, t in enumerate(exponents):
        w = F.pow("share", F.lit(t))
        columns += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log2(w)).alias(f"e{i}")]
        rate = w / F.col("share")
        columns.append((F.max(rate) / F.min(rate)).alias(f"r{i}"))
    row = shares.agg(*columns).first()
    return [(math.log2(row[f"z{i}"]) - row[f"e{i}"] / row[f"z{i}"], row[f"r{i}"]) for i in range(len(exponents))]


def exponent(shares: DataFrame, entropy: float | None, limit: float | None) -> float:
    """The largest exponent that reaches the entropy, or else the smallest that keeps to the limit; to 1e-6."""
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        grid = [low + (high - low) * k / (GRID + 1) for k in range(GRID + 2)]
        profile = _profile(shares, grid)
        # Towards 0 the entropy and the repetition both rise.
        flat = [e >= entropy if limit is None else r > limit for e, r in profile]
        if not flat[0]:
            return low
        last = max(i for i, x in enumerate(flat) if x)
        if last == len(grid) - 1:
            return high
        low, high = grid[last], grid[last + 1]
    return round(low if limit is None else high, 6)


def source_weights(
    totals: DataFrame, entropy: float | None = None, limit: float | None = None, budget: int | None = None
) -> DataFrame:
    """From (source, tokens): weight, quota, full rounds and the tokens of the last, part round."""
    if (entropy is None) == (limit is None):
        raise ValueError("give either a target entropy or a repetition limit")
    whole = totals.agg(F.sum("tokens").alias("t"), F.count(F.when(F.col("tokens") > 0, 1)).alias("n")).first()
    if not whole["t"]:
        return totals.select("*", *(F.lit(0.0).alias(c) for c in ("share", "weight", "quota")), *(F.lit(v).cast("bigint").alias(c) for c, v in (("full", 1), ("part", 0))))
    share = F.col("tokens") / F.lit(whole["t"])
    used = totals.where("tokens > 0").select("source", share.alias("share"))
    t = exponent(used, entropy, limit)
    z = used.agg(F.sum(F.pow("share", F.lit(t))).alias("z"), F.max(F.pow("share", F.lit(1 - t))).alias("b")).first()
    # Rounds of a source: weight * budget / tokens. The least is one where the budget is z * max(share**(1 - t)).
    tokens = float(budget) if budget else whole["t"] * z["z"] * z["b"]
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(t)) / F.lit(z["z"])).otherwise(0.0)
    quota = F.col("weight") * F.lit(tokens)
    rounds = F.when(F.col("tokens") > 0, F.round(F.col("quota") / F.col("tokens"), 9)).otherwise(1.0)
    weighed = totals.withColumn("share", share).withColumn("weight", weight).withColumn("quota", quota)
    return weighed.withColumn("full", F.floor(rounds)).withColumn(
        "part", F.greatest(F.lit(0), F.round((rounds - F.floor(rounds)) * F.col("tokens"))).cast("bigint")
    )


def _block_rank(seed: int, of_round: Column) -> Column:
    return F.xxhash64(F.lit(seed), of_round, "source", "block")


def mix_sources(
    docs: DataFrame,
    tokens: Column | None = None,
    entropy: float | None = None,
    limit: float | None = None,
    budget: int | None = None,
    seed: int = 0,
    id_column: str = "doc_id",
) -> DataFrame:
    """The mix: rows of ``docs``, each as often as it is used, with tokens, weight, round, block, block_rank and row_rank."""
    added = ("tokens", "weight", "round", "block", "block_rank", "row_rank")
    amount = F.regexp_count(text_or_empty(), F.lit(WORD)) if tokens is None else tokens
    inner = ("full", "part", "cut_block", "cut_row", "rounds")
    row_hash = F.xxhash64(F.lit(seed), quoted(id_column), text_or_empty())
    source = without(docs.withColumns({"__tokens": amount.cast("bigint"), "__hash": row_hash}), *added, *inner)
    rows = source.withColumnRenamed("__tokens", "tokens").withColumn("block", F.pmod("__hash", F.lit(BLOCKS)))
    mine = F.col("source").eqNullSafe(F.col("__of"))

    blocks = stored(rows.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    totals = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    weights = stored(
        source_weights(totals, entropy, limit, budget).select(F.col("source").alias("__of"), "weight", "full", "part"), "mix-weights"
    )

    # The block in which the part round ends; of a source without one, none.
    ranked = blocks.join(weights, mine).where("part > 0").withColumn("block_rank", _block_rank(seed, F.col("full") + 1))
    running = F.sum("tokens").over(Window.partitionBy("source").orderBy("block_rank", "block"))
    last = (
        ranked.withColumn("upto", running)
        .where("upto >= part AND upto - tokens < part")
        .select(F.col("source").alias("__of"), F.col("block").alias("__block"), F.col("block_rank").alias("cut_block"), (F.col("part") - F.col("upto") + F.col("tokens")).alias("rest"))
    )
    # Within that block: rows up to the first that meets the rest. Sums tell the piece of the block, so that only a piece is ordered.
    inside = rows.select("source", "block", "tokens", "__hash").join(last, mine & (F.col("block") == F.col("__block")))
    inside = stored(inside.select("__of", "cut_block", "rest", "tokens", F.xxhash64("__hash").alias("row_rank")), "mix-cut")
    piece = F.shiftright("row_rank", 64 - PIECE_BITS).alias("piece")
    pieces = inside.groupBy("__of", "rest", piece).agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy("__of").orderBy("piece"))
    met = pieces.withColumn("upto", upto).where("upto >= rest AND upto - tokens < rest")
    met = met.select(F.col("__of").alias("__p"), F.col("piece").alias("__piece"), (F.col("upto") - F.col("tokens")).alias("start"))
    of_piece = Window.partitionBy("__of").orderBy("row_rank")
    earlier = F.sum("tokens").over(of_piece.rangeBetween(Window.unboundedPreceding, 0)) - F.sum("tokens").over(of_piece.rangeBetween(0, 0))
    cut = (
        inside.join(met, F.col("__of").eqNullSafe(F.col("__p")) & (piece == F.col("__piece")))
        .withColumn("before", F.col("start") + earlier)
        .where("before < rest")
        .groupBy("__of")
        .agg(F.first("cut_block").alias("cut_block"), F.max("row_rank").alias("cut_row"))
    )
    of = weights.withColumnRenamed("__of", "__w")
    plan = stored(of.join(cut, F.col("__w").eqNullSafe(F.col("__of")), "left").drop("__of").withColumnRenamed("__w", "__of"), "mix-plan")

    joined = rows.join(plan, mine, "left")
    rank = _block_rank(seed, F.col("full") + 1)
    row_rank = F.xxhash64("__hash")
    within = (rank < F.col("cut_block")) | ((rank == F.col("cut_block")) & (row_rank <= F.col("cut_row")))
    used = F.col("full") + F.when(F.coalesce(within, F.lit(False)), 1).otherwise(0)
    kept = joined.withColumn("__used", used).where("__used > 0")
    each = kept.withColumn("round", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__used"))))
    ordered = each.withColumn("block_rank", _block_rank(seed, F.col("round"))).withColumn("row_rank", row_rank)
    return ordered.drop("full", "part", "cut_block", "cut_row", "__of", "__used", "__hash")


def mixed_documents(documents: DataFrame, limit: float, seed: int) -> DataFrame:
    """One row per use of a document: doc_id, source, tokens, weight and the order columns."""
    text = text_or_empty()
    narrow = documents.select("doc_id", "source", text.alias("text"))
    mixed = mix_sources(narrow, limit=limit, seed=seed)
    return mixed.select("doc_id", "source", "tokens", "weight", "round", "block", "block_rank", "row_rank")
