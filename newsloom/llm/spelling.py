"""Spelling variants by bidirectional FM-index search schemes.

Two words are near if they differ by one inserted, deleted or replaced code point. Of such a pair's first word either the left or the
right half stands in the second unchanged, at its beginning or its end. So every word is looked for twice: its left half is matched exactly,
tied to the beginning of a word and extended to the right across the other half, allowing one error; and the same from the right half
to the left, where words that begin with the left half were found before. The text searched is the vocabulary itself,
each word between delimiters. `FMIndex` keeps a suffix-rank interval in the text and one in its mirror image in step, so a match can
be extended on either side; wavelet matrices over both Burrows-Wheeler transforms give all steps of all
words at once, as array operations.

The vocabulary is dealt, not broadcast: a word goes to a cell by its first `KEY` code points, to be found by its left half, and to another by
its last ones. Cells hold about `CELL` words. A key that more words share is cut into several cells: each of its words is indexed in one of
them and searched for in all, so the result is whole at any skew and no task holds more than a few cells' worth of words.

Chains of forms are followed by pointer jumping: counts grow tenfold at each step, so they are short.

A NULL text has no words, nor has an empty one; a NULL doc_id counts as an empty name in the hash that misspells. Texts are read whole,
at any length, by JVM expressions, and words may have any length. Words of equal count are told apart by code points. Repeated rows count each time. An empty table gives no rows.
Only the two columns asked for are read, whatever others are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.components import followed
from newsloom.session import stored

# Fixed value: runs of letters that count as words.
LETTERS = "[A-Za-zÀ-ÿ]+"
KEY = 3  # code points that deal a word; a half of the shortest word has as many
CELL = 4096  # words in a cell, on average
END, EDGE = 0, 1  # symbols: end of the text, delimiter
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling the length that ranks cover; the last symbol is the least and unique."""
    size = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.zeros(size, np.int64)
        after[: size - width] = rank[width:] + 1
        key = rank * (size + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(size, np.int64)
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        if rank[order[-1]] == size - 1 or width >= size:
            return order
        width *= 2


class Wavelet:
    """Symbols of a sequence within ranges: how many are equal to one, how many are less, and which there are."""

    def __init__(self, symbols: np.ndarray, count: int) -> None:
        self.bits = max(1, int(count - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        rest = symbols.astype(np.int64)
        for bit in range(self.bits - 1, -1, -1):
            digit = (rest >> bit) & 1
            self.ones.append(np.append(0, np.cumsum(digit)).astype(np.int64))
            self.zeros.append(int(len(rest) - digit.sum()))
            rest = np.concatenate([rest[digit == 0], rest[digit == 1]])
        # Where each symbol's block begins after the last level, and how many symbols are less.
        every = np.arange(1 << self.bits)
        self.base, _, _ = self._down(np.zeros(len(every), np.int64), np.zeros(len(every), np.int64), every)
        self.less = np.append(0, np.cumsum(np.bincount(symbols, minlength=len(every))))

    def _down(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        smaller = np.zeros(len(low), np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            low1, high1 = ones[low], ones[high]
            low0, high0 = low - low1, high - high1
            smaller += np.where(one, high0 - low0, 0)
            low, high = np.where(one, zeros + low1, low0), np.where(one, zeros + high1, high0)
        return low, high, smaller

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For ranges and a symbol each: where the range of suffixes that begin with it goes, its size, and how many are less."""
        first, last, smaller = self._down(low, high, symbol)
        return self.less[symbol] + first - self.base[symbol], last - first, smaller

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """All (number of the range, symbol, where, size, less) that occur; branches without a symbol are left at once."""
        owner, symbol, smaller = np.arange(len(low)), np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            low1, high1 = ones[low], ones[high]
            low0, high0 = low - low1, high - high1
            left, right = np.flatnonzero(high0 > low0), np.flatnonzero(high1 > low1)
            smaller = np.concatenate([smaller[left], smaller[right] + (high0 - low0)[right]])
            owner = np.concatenate([owner[left], owner[right]])
            symbol = np.concatenate([symbol[left] << 1, symbol[right] << 1 | 1])
            low = np.concatenate([low0[left], zeros + low1[right]])
            high = np.concatenate([high0[left], zeros + high1[right]])
        return owner, symbol, self.less[symbol] + low - self.base[symbol], high - low, smaller


class FMIndex:
    """Words between delimiters, searched from the inside out. An interval is (in the text, in its mirror image, size)."""

    def __init__(self, words: list[str]) -> None:
        points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
        self.alphabet = np.unique(np.concatenate(points)) if words else np.zeros(0, np.uint32)
        self.symbols = len(self.alphabet) + 3  # the last one stands for code points that no word has
        lengths = np.array([len(p) for p in points])
        self.starts = np.cumsum(lengths + 1) - lengths - 1  # of each word's delimiter
        inner = [x for p in points for x in (np.array([EDGE]), self.coded(p))]
        text = np.concatenate([*inner, np.array([EDGE])])
        self.size = len(text) + 1
        self.places, forward = self._transformed(np.append(text, END))
        _, backward = self._transformed(np.append(text[::-1], END))
        self.forward, self.backward = forward, backward

    def _transformed(self, text: np.ndarray) -> tuple[np.ndarray, Wavelet]:
        order = suffix_order(text)
        return order, Wavelet(text[order - 1], self.symbols)

    def coded(self, points: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.alphabet, points)
        known = at < len(self.alphabet)
        known[known] = self.alphabet[at[known]] == points[known]
        return np.where(known, at + 2, len(self.alphabet) + 2)

    def everywhere(self, count: int) -> np.ndarray:
        state = np.zeros((3, count), np.int64)
        state[2] = self.size
        return state

    def extended(self, state: np.ndarray, symbol: np.ndarray, right: bool) -> np.ndarray:
        """Matches with one more symbol on a side; those that end have size 0."""
        here, there = (1, 0) if right else (0, 1)
        side = self.backward if right else self.forward
        at, size, less = side.step(state[here], state[here] + state[2], symbol)
        result = np.empty_like(state)
        result[here], result[there], result[2] = at, state[there] + less, size
        return result

    def branches(self, state: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All extensions: the number of the match extended, the symbol, the new match."""
        here, there = (1, 0) if right else (0, 1)
        side = self.backward if right else self.forward
        owner, symbol, at, size, less = side.children(state[here], state[here] + state[2])
        result = np.empty((3, len(owner)), np.int64)
        result[here], result[there], result[2] = at, state[there][owner] + less, size
        return owner, symbol, result

    def near(self, words: list[str], right: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of a query, number of a word) with one error outside the query's exact half: its left one if ``right``."""
        points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
        lengths = np.array([len(p) for p in points])
        halves = lengths // 2 if right else lengths - lengths // 2
        # In the order of matching, by length, so that those still matched are a tail.
        order = np.argsort(lengths, kind="stable")
        flat = self.coded(np.concatenate([points[i] if right else points[i][::-1] for i in order]))
        lengths, halves = lengths[order], halves[order]
        begin = np.cumsum(lengths) - lengths
        live = np.arange(len(order))
        state = self.everywhere(len(order))
        for i in range(int(halves.max())):
            going = np.flatnonzero(i < halves[live])
            if len(going):
                state[:, going] = self.extended(state[:, going], flat[begin[live[going]] + i], right)
            kept = state[2] > 0
            live, state = live[kept], state[:, kept]
        # The half stands at the edge of a word.
        state = self.extended(state, np.full(len(live), EDGE), not right)
        kept = state[2] > 0
        live, state = live[kept], state[:, kept]
        # Per number of symbols consumed: exact matches enter when their half is done, those with an error go along.
        found_query, found_state = [], []
        erred, wrong = np.zeros(0, np.int64), np.zeros((3, 0), np.int64)
        waiting, held = live, state
        live, state = np.zeros(0, np.int64), np.zeros((3, 0), np.int64)
        for i in range(int(halves.min()), int(lengths.max()) + 1):
            enter = halves[waiting] == i
            live, state = np.append(live, waiting[enter]), np.hstack([state, held[:, enter]])
            waiting, held = waiting[~enter], held[:, ~enter]
            if not len(live) and not len(erred) and not len(waiting):
                break
            done = lengths[live] == i
            next_symbol = np.where(done, EDGE, flat[np.minimum(begin[live] + i, len(flat) - 1)])
            owner, symbol, branch = self.branches(state, right)
            letter = symbol > EDGE
            other = letter & (symbol != next_symbol[owner])
            # One symbol too many: not the one that comes next, since that may as well come later.
            erred, wrong = np.append(erred, live[owner[other]]), np.hstack([wrong, branch[:, other]])
            # Matches with an error that have all symbols must end here.
            over = lengths[erred] == i
            ended = self.extended(wrong[:, over], np.full(int(over.sum()), EDGE), right)
            hit = ended[2] > 0
            found_query.append(erred[over][hit])
            found_state.append(ended[:, hit])
            erred, wrong = erred[~over], wrong[:, ~over]
            # One step on: exactly, with the next symbol replaced, or left out (of a run of equal ones, the last).
            if len(erred):
                wrong = self.extended(wrong, flat[begin[erred] + i], right)
                on = wrong[2] > 0
                erred, wrong = erred[on], wrong[:, on]
            more = other & ~done[owner]
            second = np.where(i + 1 < lengths[live], flat[np.minimum(begin[live] + i + 1, len(flat) - 1)], -1)
            lacks = ~done & (second != next_symbol)
            erred = np.concatenate([erred, live[owner[more]], live[lacks]])
            wrong = np.hstack([wrong, branch[:, more], state[:, lacks]])
            exact = letter & ~other
            live, state = live[owner[exact]], branch[:, exact]
        query = np.concatenate(found_query) if found_query else np.zeros(0, np.int64)
        match = np.hstack(found_state) if found_state else np.zeros((3, 0), np.int64)
        # A match holds its word's delimiters: it occurs once, and its place in the text tells the word.
        return order[query], np.searchsorted(self.starts, self.places[match[0]])


def _cells(words: DataFrame, cell: int) -> DataFrame:
    """(side, cell, word, n, indexed, searched): the cells that index a word and those that search for it."""
    keys = F.array(F.struct(F.lit(True).alias("side"), F.substring("word", 1, KEY).alias("key")), F.struct(F.lit(False).alias("side"), F.expr(f"right(word, {KEY})").alias("key")))
    keyed = words.select("word", "n", F.explode(keys).alias("k")).select("word", "n", "k.side", "k.key")
    sizes = stored(keyed.groupBy("side", "key").agg(F.count("*").alias("held")), "keys")
    buckets = F.lit(max(1, -(-(sizes.where(f"held <= {cell}").agg(F.sum("held")).first()[0] or 0) // cell)))
    large = F.col("held") > cell
    placed = sizes.select(
        "side",
        "key",
        F.when(large, F.xxhash64("key")).otherwise(F.pmod(F.xxhash64("key"), buckets)).alias("cell"),
        F.when(large, F.col("key")).alias("own"),
        F.when(large, F.ceil(F.col("held") / cell)).otherwise(1).cast("int").alias("parts"),
    )
    joined = keyed.join(placed, ["side", "key"])
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    spread = joined.withColumn("at", part).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return spread.select("side", "cell", "own", "part", "word", "n", (F.col("part") == F.col("at")).alias("indexed"))


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, n, near, near_n): all pairs of the distinct ``words`` (word, n) that are one error apart, each in both directions.

    Words have at least two times `KEY` code points.
    """
    dealt = _cells(words, cell)
    width = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["side", "cell", "own", "part"]
    dealt = dealt.repartition(width, *names).sortWithinPartitions(*names)
    kinds = {"word": pa.string(), "n": pa.int64(), "near": pa.string(), "near_n": pa.int64()}

    def searched(side: bool, rows: list[tuple]) -> pa.RecordBatch:
        indexed = [(word, n) for word, n, own in rows if own]
        result: list[tuple] = []
        if indexed:
            words = [word for word, _ in indexed]
            queries, hits = FMIndex(words).near([r[0] for r in rows], side)
            for q, h in sorted(set(zip(queries.tolist(), hits.tolist()))):
                (word, n, _), (near, near_n) = rows[q], indexed[h]
                # What begins with the left half was found by it.
                if side or not near.startswith(word[: len(word) // 2]):
                    result.append((word, n, near, near_n))
        columns = list(zip(*result)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values())], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:4] != last:
                    yield searched(last[0], held)
                    held = []
                last = row[:4]
                held.append(row[4:])
        if held:
            yield searched(last[0], held)

    return dealt.mapInArrow(run, "word string, n bigint, near string, near_n bigint")


def variants(words: DataFrame, factor: int = 10, cell: int = CELL) -> DataFrame:
    """Distinct ``words`` (word, n) with form, root, n_near and form_n."""
    near = near_words(words, cell)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    found = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(found, "word", "left").withColumn("most", -F.col("best.less"))
    frequent = F.col("most") >= factor * F.col("n")
    chosen = stored(
        joined.select(
            "word",
            F.when(frequent, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(frequent, F.col("most")).alias("form_n"),
        ),
        "forms",
    )
    ends = followed(chosen.where("form IS NOT NULL").select(F.col("word").alias("node"), F.col("form").alias("up")))
    rooted = chosen.join(ends.select(F.col("node").alias("word"), F.col("up").alias("root")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_words(documents: DataFrame, shortest: int = 7, least: int = 2) -> DataFrame:
    """(word, n): words of the contract, every 31st run of letters misspelt, with their occurrences."""
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"({LETTERS})"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    rows = documents.select(name.alias("name"), F.explode(runs).alias("run"))
    lowered = rows.select("name", F.translate("run", UPPER, LOWER).alias("run")).where(F.length("run") >= shortest)
    hashed = F.crc32(F.concat("name", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run"))
    words = lowered.withColumn("h", hashed).select(word.alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def document_variants(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    return variants(stored(document_words(documents), "words"))
