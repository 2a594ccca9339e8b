"""Log probabilities of texts from mixed hashed-context bit predictors.

What is scored is a text's token sequence: words in lower case (A-Z only), one space between them, and an end. Its symbols,
the bytes and the end, are taken bit by bit, by a prefix code that depends on the symbol before (Huffman, from
the training texts' pairs), so that likely symbols take few bits; any code gives a proper distribution.

Each predictor hashes a context (the last 2, 4 or 6 symbols, or the word so far) and the bit's place in the code to a
slot, which holds how often the bit was 0 and 1 there in all training texts. Its stretched probability (log odds) enters a mix whose
weights are chosen by a gate: how well the two longest contexts are known. The weights are learned: slots are counted
without every sixteenth training text first, and Newton's steps on sums over those texts fit the weights of each gate; then their
counts are added. While a text is read the mix is refined: in each gate the log odds are scaled by a factor that starts at 1 and is fitted,
segment after segment, to the text so far.

Beside the bits a word has a second opinion, its exact number among the words of all training texts, a table that grows with the corpus. The two are mixed
word by word, with a share that is fitted to the text so far as well. A known word, with what ends it, so gets probability from both, any other from
its bits alone. Nothing is carried from one text to the next, so a score depends on neither order nor partitioning.

The corpus is kept in compressed blocks, written once. Token counts are exact over all training texts; each block gets those
of its own distinct tokens by a join. Slot counts are summed level by level, chunk by chunk of the tables; what
all tasks need of them has a fixed size (`SLOTS`, 27 MB in all) and is broadcast.

A NULL or empty text has only the end. Rows without an id, repeated rows and equal texts are scored each by itself. Without training
texts all counts are zero and the bits even. An empty table gives no rows. Long texts are read in parts of about 1 MB, each with contexts and
refinement of its own; one with a word beyond that size is scored by its bits alone from there on. Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import slices, text_or_empty
from newsloom.session import stored

END = 256  # the symbol after a text's last byte
ALPHABET = 257
PAIR_BITS = 17  # of the number of a symbol and the one before it
BLOCK_BYTES = 10 << 20  # text in a block
CHUNK_SYMBOLS = 1 << 17  # symbols taken through the model at a time, apart from longer texts
COUNTED = 1 << 19  # symbols whose repeated contexts are counted at once
LAID_OUT = 1 << 14  # symbols whose bits are laid out at a time, so that they stay in the processor's cache
LONG_TEXT = 1 << 20  # a text is read in parts of this many bytes, each with contexts and refinement of its own
SLOTS = (20, 22, 22, 22)  # bits of a slot number, per predictor
CHUNK = 1 << 17  # counters in a chunk of a table
TASKS_A_SUM = 64  # tables added up in one step
SEGMENT = 384  # symbols between two refinements
PACKED = 1 << 20  # counts that a task packs at a time
PRIOR = 0.3  # added to both counts of a slot
UNIT = 256  # steps of stored log odds
CLIP = 7.9
GATES = 16  # four steps of what is known of the last six symbols, in each of them four of what is known of the last four
FITTED_ON = 16  # every so manieth training text is for the weights
FINE = 1 << 14  # parts of one that slopes are added up in
ROUNDS = 3  # of Newton's method on their sums
NEUTRAL, TOWARDS = 0.3, 200.0  # weight of a predictor of which nothing is known, and how many bits that counts as
WORD_SHARE, WORD_TRUST = 0.05, 4.0  # part of the words' own counts in the mix to begin with, and how many words that counts as


def tokens_of(texts: bytes) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words and ends, written as empty words, of normalised texts with line feeds between them, and how many each text has."""
    raw = np.frombuffer(texts, np.uint8)
    stops = np.append(np.flatnonzero((raw == 32) | (raw == 10)), len(raw))
    ends = np.append(raw[stops[:-1]] == 10, True)
    sizes = np.diff(stops, prepend=-1) - 1
    # Behind a text's last word comes its end; an empty text has only this.
    times = 1 + (ends & (sizes > 0))
    last = np.cumsum(times)[ends] - 1
    sizes = np.repeat(sizes, times)
    sizes[last] = 0
    parts = [None, pa.py_buffer(np.append(0, np.cumsum(sizes))), pa.py_buffer(texts.translate(None, b" \n"))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), parts), np.diff(last, prepend=-1)


# ---- symbols, contexts and bits ----


def symbols_of(texts: list[bytes], ended: bool = True) -> np.ndarray:
    """Bytes of the texts, each followed by the end; not so the only part of a text that goes on."""
    if not ended:
        return np.frombuffer(texts[0], np.uint8).astype(np.int64)
    sizes = np.array([len(t) + 1 for t in texts])
    symbols = np.full(int(sizes.sum()), END, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[np.cumsum(sizes) - 1] = False
    symbols[inside] = np.frombuffer(b"".join(texts), np.uint8)
    return symbols


def _scrambled(x: np.ndarray, factor: int) -> np.ndarray:
    x = x * np.uint32(factor)
    return x ^ (x >> np.uint32(15))


@functools.lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor that hashes words, and of its inverse."""
    factor, inverse = np.uint32(0x01000193), np.uint32(pow(0x01000193, -1, 2**32))
    return tuple(np.cumprod(np.append(np.uint32(1), np.full(size, x)), dtype=np.uint32) for x in (factor, inverse))


def symbols_before(symbols: np.ndarray) -> list[np.ndarray]:
    """The six symbols before each symbol, the nearest first. Nothing before a text's start counts: it is the end."""
    size = len(symbols)
    narrow = symbols.astype(np.uint32)
    back, text_ends = [], np.flatnonzero(symbols == END)
    for k in range(1, 7):
        older = np.full(size, END, np.uint32)
        older[k:] = narrow[:-k]
        for behind in range(1, k):
            older[text_ends[text_ends < size - behind] + behind] = END
        back.append(older)
    return back


def by_symbols(back: list[np.ndarray]) -> list[np.ndarray]:
    """Contexts of the last two, four and six symbols, as far as these are given."""
    found: list[np.ndarray] = []
    for at, factor in zip(range(0, len(back), 2), (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)):
        here = back[at] * np.uint32(521) + back[at + 1]
        here = found[-1] ^ here if found else here
        found.append(_scrambled(here + np.uint32(at // 2 + 1), factor))
    return found


def by_word(symbols: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Contexts of the word so far: a polynomial hash from its first symbol."""
    size = len(symbols)
    powers, inverses = _powers(1 << max(size - 1, CHUNK_SYMBOLS).bit_length())
    sums = np.append(np.uint32(0), np.cumsum((symbols.astype(np.uint32) + np.uint32(7)) * powers[:size], dtype=np.uint32))
    first = np.flatnonzero((before == END) | (before == 32))
    sizes = np.diff(first, append=size)
    return _scrambled((sums[:-1] - np.repeat(sums[first], sizes)) * np.repeat(inverses[first], sizes) + np.uint32(4), 0x27D4EB2F)


def contexts_of(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The symbol before each symbol, and the hashed contexts of the predictors."""
    back = symbols_before(symbols)
    return back[0].astype(np.int64), [*by_symbols(back), by_word(symbols, back[0])]


def prefix_codes(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and codes of each symbol after each other one; ``pairs`` counts them. Every symbol gets a code."""
    lengths, codes = (np.zeros((ALPHABET, ALPHABET), np.int64) for _ in range(2))
    for before in range(ALPHABET):
        heap: list[tuple] = [(int(n) + 1, s, None) for s, n in enumerate(pairs[before])]
        heapq.heapify(heap)
        made = ALPHABET
        while len(heap) > 1:
            low, high = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (low[0] + high[0], made, (low, high)))
            made += 1
        open_nodes = [(heap[0], 0, 0)]
        while open_nodes:
            (_, symbol, children), length, code = open_nodes.pop()
            if children is None:
                lengths[before, symbol], codes[before, symbol] = length, code
            else:
                open_nodes += [(child, length + 1, 2 * code + bit) for bit, child in enumerate(children)]
    return lengths, codes


class Code:
    """The bits of every symbol after every other one, laid out one after the other."""

    def __init__(self, lengths: np.ndarray, codes: np.ndarray) -> None:
        self.lengths = lengths.ravel().astype(np.int32)
        ends = np.cumsum(self.lengths, dtype=np.int64)
        self.starts = (ends - self.lengths).astype(np.int32)
        pair = np.repeat(np.arange(len(ends)), self.lengths)
        place = np.arange(len(pair)) - self.starts[pair]
        left, code = self.lengths[pair] - place, codes.ravel()[pair]
        self.value = ((code >> (left - 1)) & 1).astype(np.int8)
        self.sign = (1 - 2 * self.value).astype(np.float32)
        # Which bit of which symbols this is: the bits before it, and the symbol before.
        node = ((np.int64(1) << place) | (code >> left)).astype(np.uint32)
        self.node = node * np.uint32(0x9E3779B1) + (pair // ALPHABET).astype(np.uint32)


class Symbols:
    """The symbols of some texts: each with the one before it, as a pair, and its contexts."""

    def __init__(self, texts: list[bytes], ended: bool = True) -> None:
        self.symbols = symbols_of(texts, ended)
        before, self.contexts = contexts_of(self.symbols)
        self.pairs = before * ALPHABET + self.symbols

    def reordered(self, order: np.ndarray) -> None:
        self.symbols, self.pairs = self.symbols[order], self.pairs[order]
        self.contexts = [c[order] for c in self.contexts]

    def bits(self, code: Code) -> Iterator[tuple[int, Bits]]:
        """The bits of a few symbols at a time, with the number of the first."""
        for at in range(0, len(self.pairs), LAID_OUT):
            here = slice(at, at + LAID_OUT)
            yield at, Bits.of_symbols(self.pairs[here], [c[here] for c in self.contexts], code)


class Bits:
    """The bits of some texts: of which symbol each is, its value, and its slot for each predictor."""

    def __init__(self, texts: list[bytes], code: Code, ended: bool = True) -> None:
        read = Symbols(texts, ended)
        self.symbols = read.symbols
        self._lay_out(read.pairs, read.contexts, code)

    @classmethod
    def of_symbols(cls, pairs: np.ndarray, contexts: list[np.ndarray] | dict[int, np.ndarray], code: Code) -> Bits:
        bits = cls.__new__(cls)
        bits._lay_out(pairs, contexts, code)
        return bits

    def _lay_out(self, pairs: np.ndarray, contexts: list[np.ndarray] | dict[int, np.ndarray], code: Code) -> None:
        self.contexts, self.code = contexts, code
        self.lengths = code.lengths[pairs]
        self.symbol = np.repeat(np.arange(len(pairs)), self.lengths)
        self.at = np.arange(len(self.symbol))
        self.at += (code.starts[pairs] - (np.cumsum(self.lengths, dtype=np.int64) - self.lengths))[self.symbol]
        self.node = code.node[self.at]

    @property
    def value(self) -> np.ndarray:
        return self.code.value[self.at]

    def slots(self, predictor: int) -> np.ndarray:
        mixed = self.contexts[predictor][self.symbol]
        mixed ^= self.node
        mixed *= np.uint32(0x2C1B3C6D)
        mixed >>= np.uint32(32 - SLOTS[predictor])
        return mixed.astype(np.int64)

    def counters(self, predictor: int) -> np.ndarray:
        """Of each bit, in a table that has two for a slot."""
        at = self.slots(predictor)
        at <<= 1
        at |= self.value
        return at


def distinct(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each of some sorted keys once, and how often it occurs."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    times = np.diff(first, append=len(keys)) if times is None else np.add.reduceat(times, first)
    return keys[first], times


def repeated_contexts(texts: list[bytes], ended: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each predictor the distinct pairs and contexts of the texts' symbols, and how often they occur together."""
    symbols = symbols_of(texts, ended)
    back = symbols_before(symbols)
    # Sorted by a symbol and then those before it, nearest first, keys of longer contexts are in order for shorter ones.
    keys, mask = symbols.astype(np.uint64), np.uint64(511)
    for older in back:
        keys <<= np.uint64(9)
        keys |= older
    keys.sort()
    keys, times = distinct(keys)
    for predictor, many in ((2, 6), (1, 4), (0, 2)):
        older = [((keys >> np.uint64(9 * at)) & mask).astype(np.uint32) for at in range(many)][::-1]
        pairs = older[0].astype(np.int64) * ALPHABET + (keys >> np.uint64(9 * many)).astype(np.int64)
        yield predictor, pairs, by_symbols(older)[-1], times
        keys, times = distinct(keys >> np.uint64(18), times)
    keys = by_word(symbols, back[0]).astype(np.uint64)
    keys <<= np.uint64(PAIR_BITS)
    keys |= back[0] * np.uint64(ALPHABET) + symbols.astype(np.uint64)
    keys.sort()
    keys, times = distinct(keys)
    yield 3, (keys & np.uint64((1 << PAIR_BITS) - 1)).astype(np.int64), (keys >> np.uint64(PAIR_BITS)).astype(np.uint32), times


def bundles(texts: list[bytes], symbols: int = CHUNK_SYMBOLS) -> Iterator[tuple[int, list[bytes], bool]]:
    """Texts in runs of some size, with the number of the first; a part of a long text that goes on comes alone, as not ended.

    Parts end after a space, where there is one.
    """
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        while len(text) > LONG_TEXT:
            if held:
                yield start, held, True
            cut = text.rfind(b" ", 0, LONG_TEXT) + 1 or LONG_TEXT
            yield i, [text[:cut]], False
            text = text[cut:]
            start, held, size = i, [], 0
        held.append(text)
        size += len(text)
        if size >= symbols:
            yield start, held, True
            start, held, size = i + 1, [], 0
    if held:
        yield start, held, True


# ---- the model ----


def slot_values(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """What a slot gives: log odds in steps, and in the two lowest bits how well they are known."""
    odds = np.log((ones + PRIOR) / (zeros + PRIOR))
    steps = np.clip(np.round(odds * UNIT), -CLIP * UNIT, CLIP * UNIT).astype(np.int16)
    known = np.minimum(np.log2(1.0 + zeros + ones) / 2, 3).astype(np.int16)
    return (steps << np.int16(2)) | known


class Words:
    """Natural logs of the probability of each word by its number in the training texts, with its end."""

    def __init__(self, words: int, distinct: int, texts: int) -> None:
        self.total = words + distinct
        with np.errstate(divide="ignore"):
            self.goes_on, self.is_last = np.log(np.array([words, texts]) / max(words + texts, 1))

    def logs(self, counts: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of words that go on or are a text's last; minus infinity for unknown ones, whose share stays unused."""
        with np.errstate(divide="ignore"):
            return np.log(counts / max(self.total, 1)) + np.where(last, self.is_last, self.goes_on)


def word_counts(bundle: tuple[int, list[bytes], bool], counts: list[np.ndarray], used: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a bundle's texts its count, and whether it is its text's last. ``used`` says how many words of a
    text were read in earlier parts. An empty text is one unknown word, as is one cut in two and all after it."""
    start, some, ended = bundle
    found, last = [], []
    for i, text in enumerate(some, start):
        whole = ended or text.endswith(b" ")
        words = text.count(b" ") + (ended or not whole)
        at = used.get(i, 0)
        used[i] = at + words if whole else len(counts[i]) + 1
        here = counts[i][at : at + words]
        here = here if len(here) == words else np.zeros(words)
        found.append(here if whole else np.append(here[:-1], 0))
        last.append(np.arange(1, words + 1) == words if ended else np.zeros(words, bool))
    return np.concatenate(found), np.concatenate(last)


class Model:
    def __init__(self, lengths: np.ndarray, codes: np.ndarray, tables: list[np.ndarray], weights: np.ndarray | None = None) -> None:
        """``weights``: one row per gate and one column per predictor; neutral ones if None."""
        self.lengths, self.codes, self.tables = lengths, codes, tables
        self.code = Code(lengths, codes)
        weights = np.full((GATES, len(SLOTS)), NEUTRAL) if weights is None else weights
        self.weights = [np.ascontiguousarray(w) for w in (weights / UNIT).astype(np.float32).T]

    def opinions(self, bits: Bits) -> tuple[list[np.ndarray], np.ndarray]:
        """What each predictor's slots hold for each bit, and its gate."""
        found = [self.tables[k].take(bits.slots(k), mode="clip") for k in range(len(SLOTS))]
        gate = (((found[2] & 3) << 2) | (found[1] & 3)).astype(np.int64)
        return [values >> 2 for values in found], gate

    def odds(self, bits: Bits) -> tuple[np.ndarray, np.ndarray]:
        """Mixed log odds and gate of each bit."""
        found, gate = self.opinions(bits)
        mixed = np.zeros(len(gate), np.float32)
        for k, values in enumerate(found):
            term = self.weights[k].take(gate, mode="clip")
            term *= values
            mixed += term
        return mixed, gate

    def slopes(self, texts: list[bytes]) -> np.ndarray:
        """Per gate, the slope of the loss along each weight and the bend along each two, summed over the texts' bits.

        In whole ``FINE`` parts, so that sums do not depend on their order.
        """
        sums = np.zeros((GATES, 14), np.int64)
        weights = [w * UNIT for w in self.weights]
        for _, some, ended in bundles(texts):
            for _, bits in Symbols(some, ended).bits(self.code):
                found, gate = self.opinions(bits)
                views = [values.astype(np.float32) / UNIT for values in found]
                mixed = sum(weights[k].take(gate, mode="clip") * view for k, view in enumerate(views))
                one = 1 / (1 + np.exp(-mixed))
                wrong, spread = one - bits.value, one * (1 - one)
                terms = [wrong * view for view in views]
                spreads = [spread * view for view in views]
                terms += [spreads[j] * views[k] for j in range(4) for k in range(j, 4)]
                for column, term in enumerate(terms):
                    sums[:, column] += np.bincount(gate, weights=np.rint(term * FINE), minlength=GATES).astype(np.int64)
        return sums

    def losses(self, texts: list[bytes], counts: list[np.ndarray] | None = None, words: Words | None = None) -> np.ndarray:
        """Minus the natural log probability of each text; ``counts`` has the number of each of its words in the training texts."""
        # Texts of like sizes together, so that a bundle has few waves of segments, and wide ones.
        like = np.argsort([len(t) for t in texts], kind="stable")
        texts, counts = [texts[i] for i in like], counts and [counts[i] for i in like]
        result = np.zeros(len(texts))
        used: dict[int, int] = {}
        for bundle in bundles(texts):
            start, some, ended = bundle
            read = Symbols(some, ended)
            sizes = np.array([len(t) + ended for t in some])
            begin = np.cumsum(sizes) - sizes
            # A word goes up to the space or end behind it.
            ends = np.flatnonzero((read.symbols == END) | (read.symbols == 32))
            if not len(ends) or ends[-1] + 1 < len(read.symbols):
                ends = np.append(ends, len(read.symbols) - 1)
            first = np.append(0, ends[:-1] + 1)
            text = np.searchsorted(begin, first, side="right") - 1
            segment = (first - begin[text]) // SEGMENT
            # Texts are numbered anew, those of most segments first, and words put by segment and text: each wave
            # of segments is a slice, and what goes on after it is the front of this slice. Words of a text stay in order.
            most = segment[np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)]
            by_size = np.argsort(-most, kind="stable")
            number = np.empty(len(some), np.int64)
            number[by_size] = np.arange(len(some))
            narrow = np.uint16 if max(most.max(), len(some)) < 1 << 16 else np.int64
            by_wave = np.argsort(number[text].astype(narrow), kind="stable")
            by_wave = by_wave[np.argsort(segment[by_wave].astype(narrow), kind="stable")]
            owners, spans = number[text[by_wave]], (ends + 1 - first)[by_wave]
            symbol_at = np.cumsum(spans) - spans
            read.reordered(np.repeat(first[by_wave] - symbol_at, spans) + np.arange(len(read.symbols)))
            states = np.repeat(owners * GATES, spans)
            word_cuts = np.cumsum(np.bincount(segment))
            going_on = np.searchsorted(-most[by_size], -np.arange(len(word_cuts))).tolist()
            known = None
            if counts is not None:
                known = words.logs(*word_counts(bundle, counts, used))[by_wave]
            # Signed so that right predictions are negative.
            lengths = self.code.lengths[read.pairs]
            bit_at = np.cumsum(lengths, dtype=np.int64) - lengths
            wrong_way = np.empty(int(lengths.sum()), np.float32)
            state = np.empty(len(wrong_way), np.int64)
            for at, bits in read.bits(self.code):
                odds, gate = self.odds(bits)
                here = slice(int(bit_at[at]), int(bit_at[at]) + len(odds))
                np.multiply(odds, self.code.sign.take(bits.at, mode="clip"), out=wrong_way[here])
                np.add(states[at : at + LAID_OUT].take(bits.symbol, mode="clip"), gate, out=state[here])
            word_at = np.append(bit_at[symbol_at], len(wrong_way))
            scale = np.ones(GATES * len(some), np.float32)
            bend = np.full(len(scale), 20.0)
            lost, of_words, seen = (np.zeros(len(some)) for _ in range(3))
            share = np.full(len(some), WORD_SHARE)
            for low_word, high_word, more in zip([0, *word_cuts[:-1].tolist()], word_cuts.tolist(), going_on):
                if low_word == high_word:
                    continue
                low, high = int(word_at[low_word]), int(word_at[high_word])
                z, of = wrong_way[low:high], state[low:high]
                ratio = scale.take(of, mode="clip")
                ratio *= z
                np.exp(np.minimum(ratio, np.float32(60), out=ratio), out=ratio)
                loss = np.add.reduceat(np.log(1 + ratio), word_at[low_word:high_word] - low, dtype=np.float64)
                owner = owners[low_word:high_word]
                front = int(np.searchsorted(owner, more))
                if known is not None:
                    part = share[owner]
                    by_bits = np.log1p(-part) - loss
                    both = np.logaddexp(np.log(part) + known[low_word:high_word], by_bits)
                    loss = -both
                    if front:
                        of_words[:more] += np.bincount(owner[:front], weights=-np.expm1(by_bits - both)[:front], minlength=more)
                        seen[:more] += np.bincount(owner[:front], minlength=more)
                        share[:more] = (WORD_SHARE * WORD_TRUST + of_words[:more]) / (WORD_TRUST + seen[:more])
                        np.clip(share[:more], 1e-4, 1 - 1e-4, out=share[:more])
                here = int(owner[-1]) + 1
                lost[:here] += np.bincount(owner, weights=loss, minlength=here)
                if front:
                    # A step of Newton's method on all segments so far, held towards a factor of 1.
                    end, low_scale = int(word_at[low_word + front]) - low, scale[: GATES * more]
                    z, of, ratio = z[:end], of[:end], ratio[:end]
                    wrong = ratio / (1 + ratio)
                    slope = z * wrong
                    bend[: GATES * more] += np.bincount(of, weights=slope * z * (1 - wrong), minlength=len(low_scale))
                    slope = np.bincount(of, weights=slope, minlength=len(low_scale))
                    low_scale[:] = np.clip(low_scale - slope / bend[: GATES * more], 0.3, 3)
            result[like[start + by_size]] += lost
        return result


# ---- Spark jobs ----


def _narrowed(counters: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on, in as few bytes each as the largest needs."""
    return counters.astype(np.min_scalar_type(counters.max()))


def _widened(data: bytes) -> np.ndarray:
    """The numbers of a chunk of counters, from what ``_narrowed`` made of them."""
    return np.frombuffer(data, f"u{len(data) // CHUNK}")


def _squeezed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _plain(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def corpus_blocks(documents: DataFrame, held_out_of: tuple[int, int] = (7, 2)) -> DataFrame:
    """(block, rows, texts): normalised texts, compressed in blocks of bounded size, written once.

    ``rows`` holds their ids, whether they are held out, and whether they are for the weights, as an Arrow stream.
    """
    modulus, held = held_out_of
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    out = F.pmod(crc, F.lit(modulus)) == held
    fit = ~out & (F.pmod(F.shiftright(crc, 8), F.lit(FITTED_ON)) == 0)
    source = documents.select("doc_id", out.alias("held"), fit.alias("fit"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        held: list[pa.Array] = []
        fit: list[pa.Array] = []
        texts: list[bytes] = []
        size, made = 0, TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in (ids, held, fit)], ["doc_id", "held_out", "fit"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as writer:
                writer.write_batch(rows)
            values = [pa.array([x]) for x in (made, sink.getvalue().to_pybytes(), _squeezed(b"\n".join(texts)))]
            return pa.RecordBatch.from_arrays(values, ["block", "rows", "texts"])

        for part in slices(batches, 64):
            ids.append(part.column(0))
            held.append(part.column(1))
            fit.append(part.column(2))
            texts += [b" ".join((x or "").encode().lower().split()) for x in part.column(3).to_pylist()]
            size += sum(map(len, texts[-part.num_rows :]))
            if size >= BLOCK_BYTES:
                yield block()
                ids, held, fit, texts, size, made = [], [], [], [], 0, made + 1
        if texts:
            yield block()

    return stored(source.mapInArrow(run, "block bigint, rows binary, texts binary"), "blocks")


def _rows(packed: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed).read_next_batch()


def _training_texts(part: pa.RecordBatch, fit: bool | None = None) -> list[bytes]:
    """Of one block, given as (rows, texts); with ``fit`` those for the weights, or the others."""
    rows = _rows(part.column(0)[0].as_py())
    held, fits = rows.column(1).to_pylist(), rows.column(2).to_pylist()
    texts = _plain(part.column(1)[0].as_py()).split(b"\n")
    return [t for t, h, f in zip(texts, held, fits) if not h and (fit is None or fit == f)]


def block_tokens(blocks: DataFrame) -> DataFrame:
    """(token, block, place, n): the distinct tokens of each block, numbered as they first occur, and how often its training texts hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            number, rows, blob = (part.column(i)[0].as_py() for i in range(3))
            found, sizes = tokens_of(_plain(blob))
            found = found.dictionary_encode()
            tokens, trained = found.dictionary, ~np.array(_rows(rows).column(1).to_pylist(), bool)
            n = np.bincount(found.indices.to_numpy(), weights=np.repeat(trained, sizes), minlength=len(tokens)).astype(np.int64)
            for at in range(0, len(tokens), 1 << 16):
                end = min(len(tokens), at + (1 << 16))
                values = [pa.array([number] * (end - at)), pa.array(np.arange(at, end, dtype=np.int32)), pa.array(n[at:end], pa.int64())]
                yield pa.RecordBatch.from_arrays([tokens[at:end].cast(pa.binary()), *values], ["token", "block", "place", "n"])

    return blocks.select("block", "rows", "texts").mapInArrow(run, "token binary, block bigint, place int, n bigint")


def packed_counts(known: DataFrame) -> DataFrame:
    """(block, places, counts) from (block, place, c): what a task has for a block in few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
            block, place, c = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(block, kind="stable")
            block, place, c = block[order], place[order], c[order]
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            rows = [(int(block[i]), place[i:j].tobytes(), c[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])]
            kinds = (pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["block", "places", "counts"])

        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
                size += batch.num_rows
            if size >= PACKED:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return known.select("block", "place", "c").mapInArrow(run, "block bigint, places binary, counts binary")


def symbol_pairs(blocks: DataFrame) -> np.ndarray:
    """How often each symbol follows each other one in the training texts: 257 x 257 numbers, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ALPHABET * ALPHABET, np.int64)
        for part in slices(batches, 1):
            for _, some, ended in bundles(_training_texts(part)):
                symbols = symbols_of(some, ended)
                before = np.append(END, symbols[:-1])
                counts += np.bincount(before * ALPHABET + symbols, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["pair", "n"])

    rows = blocks.select("rows", "texts").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros(ALPHABET * ALPHABET, np.int64)
    for row in rows:
        pairs[row["pair"]] = row["n"]
    return pairs.reshape(ALPHABET, ALPHABET)


def _added(tables: DataFrame, key: list[str], last: bool) -> DataFrame:
    """Chunks of counters added up per key; the last time as slot values."""
    width = int(tables.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished() -> pa.RecordBatch:
            data = slot_values(total[0::2], total[1::2]) if last else _narrowed(total)
            columns = [pa.array([x], pa.int64()) for x in at] + [pa.array([_squeezed(data.tobytes())])]
            return pa.RecordBatch.from_arrays(columns, [*key, "data"])

        at, total = None, np.zeros(0, np.int64)
        for part in slices(batches, 1):
            here = tuple(part.column(i)[0].as_py() for i in range(len(key)))
            if here != at:
                if at is not None:
                    yield finished()
                at, total = here, np.zeros(CHUNK, np.int64)
            total += _widened(_plain(part.column(len(key))[0].as_py())).astype(np.int64)
        if at is not None:
            yield finished()

    dealt = tables.select(*key, "data").repartition(width, *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, ", ".join(f"{k} bigint" for k in key) + ", data binary")


def slot_counts(blocks: DataFrame, lengths: np.ndarray, codes: np.ndarray, fit: bool) -> DataFrame:
    """(kind, chunk, part, data): counters of the training texts for the weights, or of the others, added up over few tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 << bits, np.int32) for bits in SLOTS]
        code, seen = Code(lengths, codes), False
        for part in slices(batches, 1):
            for _, some, ended in bundles(_training_texts(part, fit), COUNTED):
                seen = True
                # A context that comes again with the same symbol is counted at once. Indexes and addends of
                # these types are added in place, several times faster than by sorting all bits.
                for k, pairs, context, times in repeated_contexts(some, ended):
                    for at in range(0, len(pairs), LAID_OUT):
                        here = slice(at, at + LAID_OUT)
                        bits = Bits.of_symbols(pairs[here], {k: context[here]}, code)
                        np.add.at(tables[k], bits.counters(k), times[here].astype(np.int32)[bits.symbol])
        if seen:
            group = TaskContext.get().partitionId() // TASKS_A_SUM
            for k, table in enumerate(tables):
                for chunk in range(len(table) // CHUNK):
                    data = table[chunk * CHUNK : (chunk + 1) * CHUNK]
                    if data.any():
                        columns = [pa.array([x]) for x in (k, chunk, group, _squeezed(_narrowed(data).tobytes()))]
                        yield pa.RecordBatch.from_arrays(columns, ["kind", "chunk", "part", "data"])

    counted = blocks.select("rows", "texts").mapInArrow(run, "kind bigint, chunk bigint, part bigint, data binary")
    groups = -(-blocks.rdd.getNumPartitions() // TASKS_A_SUM)
    added = _added(counted, ["kind", "chunk", "part"], False)
    while groups > TASKS_A_SUM:
        added = _added(added.withColumn("part", F.expr(f"part div {TASKS_A_SUM}")), ["kind", "chunk", "part"], False)
        groups = -(-groups // TASKS_A_SUM)
    return stored(added, "slots")


def _tables(counts: DataFrame) -> list[np.ndarray]:
    tables = [np.zeros(1 << bits, np.int16) for bits in SLOTS]
    half = CHUNK // 2
    for row in _added(counts, ["kind", "chunk"], True).toLocalIterator():
        tables[row["kind"]][row["chunk"] * half : (row["chunk"] + 1) * half] = np.frombuffer(_plain(row["data"]), np.int16)
    return tables


def fitted_weights(blocks: DataFrame, lengths: np.ndarray, codes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Weights by Newton's method on the texts kept back for them. A round brings 16 rows of whole numbers to the driver,
    which add up to the same whatever the tasks."""
    weights = np.full((GATES, len(SLOTS)), NEUTRAL)
    sent = blocks.sparkSession.sparkContext.broadcast((lengths, codes, tables))
    names = [f"s{i}" for i in range(14)]
    for _ in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            model, sums = Model(*sent.value, weights), np.zeros((GATES, 14), np.int64)
            for part in slices(batches, 1):
                sums += model.slopes(_training_texts(part, True))
            yield pa.RecordBatch.from_arrays([pa.array(range(GATES), pa.int64()), *map(pa.array, sums.T)], ["gate", *names])

        schema = "gate bigint, " + ", ".join(f"{n} bigint" for n in names)
        rows = blocks.select("rows", "texts").mapInArrow(run, schema).groupBy("gate").agg(*(F.sum(n).alias(n) for n in names)).collect()
        moved = weights.copy()
        for row in rows:
            sums = np.array([row[n] for n in names]) / FINE
            bend = np.eye(4) * TOWARDS
            upper = np.triu_indices(4)
            bend[upper] += sums[4:]
            bend = np.triu(bend) + np.triu(bend, 1).T
            here = weights[row["gate"]]
            step = np.linalg.solve(bend, sums[:4] + TOWARDS * (here - NEUTRAL))
            moved[row["gate"]] = here - np.clip(step, -1, 1)
        weights = moved
    sent.destroy()
    return weights


def trained(blocks: DataFrame) -> Model:
    """The model of the training texts; what reaches the driver has a fixed size."""
    lengths, codes = prefix_codes(symbol_pairs(blocks))
    most, rest = slot_counts(blocks, lengths, codes, False), slot_counts(blocks, lengths, codes, True)
    weights = fitted_weights(blocks, lengths, codes, _tables(most))
    return Model(lengths, codes, _tables(most.unionByName(rest)), weights)


def score_documents(documents: DataFrame) -> DataFrame:
    """The contract's columns, and bits_per_byte of the scored sequence, its end included."""
    spark = documents.sparkSession
    blocks = corpus_blocks(documents)
    model = trained(blocks)
    parts = spark.sparkContext.broadcast((model.lengths, model.codes, model.tables, np.stack(model.weights, axis=1) * UNIT))
    tokens = stored(block_tokens(blocks), "tokens")
    counts = stored(tokens.where("n > 0").groupBy("token").agg(F.sum("n").alias("c")), "token-counts")
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    ends = counts.where(F.length("token") == 0).agg(F.sum("c")).first()[0] or 0
    kind = dict(documents.dtypes)["doc_id"]

    # A block's tokens come back as numbers and counts, not as text: the block has them in the same order.
    none = F.lit(b"")
    known = packed_counts(tokens.select("token", "block", "place").join(counts, "token"))
    known = known.select("block", F.lit(0).alias("kind"), "places", "counts", none.alias("rows"), none.alias("texts"))
    texts = blocks.select("block", F.lit(1).alias("kind"), none.alias("places"), none.alias("counts"), "rows", "texts")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    together = known.unionByName(texts).repartition(width, "block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
        least = math.log10(n + v + 1)
        model, of_words = Model(*parts.value), Words(n - ends, v - (ends > 0), ends)
        places: list[np.ndarray] = []
        known: list[np.ndarray] = []
        for part in slices(batches, 1):
            if part.column(1)[0].as_py() == 0:
                places.append(np.frombuffer(part.column(2)[0].as_py(), np.int32))
                known.append(np.frombuffer(part.column(3)[0].as_py(), np.int64))
                continue
            rows, blob = _rows(part.column(4)[0].as_py()), _plain(part.column(5)[0].as_py())
            found, tokens = tokens_of(blob)
            found = found.dictionary_encode()
            values = np.zeros(len(found.dictionary))
            if places:
                values[np.concatenate(places)] = np.concatenate(known)
            places, known = [], []
            cuts, of_tokens = np.cumsum(tokens)[:-1], found.indices.to_numpy()
            of_texts, logs = np.split(values[of_tokens], cuts), np.split(np.log10(values + 1)[of_tokens], cuts)
            some = blob.split(b"\n")
            del found, blob
            losses = model.losses(some, [x[:-1] for x in of_texts], of_words)
            sizes = np.array([len(t) + 1 for t in some])
            columns = [
                *rows.columns[:2],
                pa.array([len(x) for x in of_texts], pa.int64()),
                pa.array([int(np.count_nonzero(x)) for x in of_texts], pa.int64()),
                pa.array([n] * len(some), pa.int64()),
                pa.array([math.fsum(x.tolist()) - len(x) * least for x in logs]),
                pa.array(-losses / math.log(10)),
                pa.array(losses / math.log(2) / sizes),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = (
        f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double, bits_per_byte double"
    )
    return together.mapInArrow(run, schema)
