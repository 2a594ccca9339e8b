"""Quality rules whose thresholds adapt to language and source.

Each signal is a whole number per thousand words or lines. Its distribution in every (lang, source) is kept as a
quantile sketch: a histogram whose buckets are exact up to 63 and keep six leading bits above (at
most 1/32 wide). Sketches merge by adding counts, so partial ones are reduced before the shuffle, the outcome
depends on neither order nor partitioning, and a group has 2,000 buckets at most. A group with fewer than `min_rows`
documents takes the merged sketch of its language, a language with fewer that of all.

The fence of a signal is q50 + spread * (q75 - q25) + slack. A document above any fence is rejected, as is one
with fewer than 10 words or with over 20 % of its words in repeated five-word windows (base_failed).
NULL languages and sources form groups of their own; a NULL or empty text has no words and fails. An empty
table gives no rows. Rows are judged one by one, repeated ones alike. Columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.llm.common import text_or_empty, with_columns, without
from newsloom.session import stored

SYMBOLS = "#*$%&|<>"
WINDOW = 5
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_stutters bigint"

# Per signal: what is counted, per a thousand of what, and the slack of its fence.
SIGNALS = {
    "symbols": ("n_symbols", "n_words", 100),
    "dup_lines": ("n_dup_lines", "n_lines", 400),
    "repeats": ("n_repeat_words", "n_words", 190),
    "stutters": ("n_stutters", "n_words", 100),
    "word_length": ("word_chars", "n_words", 4000),
}
SPREAD = 6
MIN_ROWS = 100


def repeated_words(words: list[bytes]) -> int:
    """Words in five-word windows that occur at least twice in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    runs = ids
    for k in range(1, WINDOW):
        # Runs of k + 1 words, named by number; any two equal names are equal runs.
        pairs = runs[:-1] * len(names) + ids[k:]
        _, runs, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(counts) == len(pairs):
            return 0
    starts = np.flatnonzero(counts[runs] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    return int((np.cumsum(change) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The base counts, in the order of BASE."""
    raw = text.encode()
    words = raw.split()  # bytes are split at ASCII white space only
    lines = [line for line in raw.split(b"\n") if line.strip()]
    white = sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    stutters = sum(map(eq, words, words[1:]))  # words equal to the one before
    return len(words), len(text) - white, symbols, len(lines) - len({*lines}), repeated_words(words), len(lines), stutters


def measured(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with the base counts."""

    def compute() -> Callable[[list[str]], list]:
        return lambda texts: [pa.array(list(c), pa.int64()) for c in zip(*map(measure, texts))]

    return with_columns(documents, text, BASE, compute)


def _signal(name: str) -> Column:
    count, of, _ = SIGNALS[name]
    return F.expr(f"CASE WHEN {of} > 0 THEN (1000 * {count}) div {of} ELSE 0 END")


def bucket(value: Column) -> Column:
    """Lower edge of the sketch's bucket: six leading bits."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def fences(counts: DataFrame, spread: int = SPREAD, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per (lang, source): the fence of each signal, from rows with base counts."""
    pairs = [F.struct(F.lit(s).alias("signal"), bucket(_signal(s)).alias("edge")) for s in SIGNALS]
    sketch = (
        counts.select("lang", "source", F.explode(F.array(*pairs)).alias("at"))
        .groupBy("lang", "source", "at.signal", "at.edge")
        .agg(F.count("*").alias("n"))
    )
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang"), F.col("source")),
        F.struct(F.lit(1).alias("level"), F.col("lang"), F.lit(None).cast("string").alias("source")),
        F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")),
    )
    merged = (
        sketch.select(F.explode(levels).alias("of"), "signal", "edge", "n")
        .groupBy("of.level", "of.lang", "of.source", "signal", "edge")
        .agg(F.sum("n").alias("n"))
    )
    group = Window.partitionBy("level", "lang", "source", "signal")
    running = merged.select("*", F.sum("n").over(group.orderBy("edge")).alias("upto"), F.sum("n").over(group).alias("total"))
    at = {q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("edge"))) for q in (1, 2, 3)}
    slack = F.create_map(*(F.lit(x) for s, (_, _, slack) in SIGNALS.items() for x in (s, slack)))
    fence = at[2] + spread * (at[3] - at[1]) + slack[F.col("signal")]
    by_signal = running.groupBy("level", "lang", "source", "signal").agg(fence.alias("fence"), F.first("total").alias("total"))
    wide = by_signal.groupBy("level", "lang", "source").agg(
        F.first("total").alias("rows"),
        *(F.max(F.when(F.col("signal") == s, F.col("fence"))).alias(f"max_{s}") for s in SIGNALS),
    )
    names = [f"max_{s}" for s in SIGNALS]
    packed = wide.select("level", "lang", "source", "rows", F.struct(*names).alias("own"))
    groups = packed.where("level = 0").select("lang", "source", "rows", "own")
    languages = packed.where("level = 1").select(F.col("lang").alias("l"), F.col("rows").alias("l_rows"), F.col("own").alias("l_own"))
    everything = packed.where("level = 2").select("own").scalar()
    joined = groups.join(languages, F.col("lang").eqNullSafe(F.col("l")))
    chosen = F.when(F.col("rows") >= min_rows, F.col("own")).when(F.col("l_rows") >= min_rows, F.col("l_own")).otherwise(everything)
    return joined.select("lang", "source", chosen.alias("use")).select("lang", "source", "use.*")


def judge(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows with base counts, with base_failed and kept."""
    right = limits.withColumnsRenamed({"lang": "__lang", "source": "__source"} | {f"max_{s}": f"__{s}" for s in SIGNALS})
    joined = without(counts, "base_failed", "kept").join(
        right, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left"
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    within = F.lit(True)
    for s in SIGNALS:
        within = within & (_signal(s) <= F.col(f"__{s}"))
    judged = joined.withColumns({"base_failed": failed, "kept": ~failed & within})
    return judged.drop("__lang", "__source", *(f"__{s}" for s in SIGNALS))


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that pass, unchanged; measured once for the fences and once where they are filtered."""
    limits = stored(fences(measured(texts_of(documents)).drop("text")), "fences")
    own = {c: f"__own_{i}" for i, c in enumerate(documents.columns) if c.lower() not in ("text", "lang", "source")}
    judged = judge(measured(documents.withColumnsRenamed(own)), limits).where("kept")
    return judged.select(*(F.col(own.get(c, c)).alias(c) for c in documents.columns))


def texts_of(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "lang", "source", text_or_empty().alias("text"))
