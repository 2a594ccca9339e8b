"""NULLs, empty and long texts, ties, repeated rows, empty tables and clashing names; and the parts of the operators."""

import base64
import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import bpe, chunk_fingerprints, licenses, lm_scoring, mixing, quality, sharding, simhash, suffix_dedup, url_filters
from newsloom.llm.components import components
from newsloom.llm.queries import vocabulary
from newsloom.llm.suffix_groups import suffix_array

LONG = " ".join(f"word{i % 977} x{i}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "a"), (None, None), (5, "é \U0001f600 x"), (6, LONG), (7, LONG), (7, "other text " * 40)]

OPERATORS = {
    "lm_scoring": lm_scoring.score_documents,
    "sharding": lambda d: sharding.shard_rows(d, ["doc_id", "text"], 3),
    "sharded": lambda d: sharding.sharded_documents(d, 3, 1),
    "bpe": lambda d: bpe.decode_ids(bpe.token_offsets(bpe.encode_texts(d, *vocabulary()), vocabulary()[0]), vocabulary()[0]),
    "suffix": suffix_dedup.without_repeats,
    "suffix_text": suffix_dedup.drop_repeats,
    "urls": lambda d: url_filters.judge_urls(d, url_filters.SITE_RULES, "text"),
    "simhash": simhash.linked_documents,
    "near": simhash.drop_near_duplicates,
    "quality": quality.keep_good,
    "licences": licenses.scan_licences,
    "mixing": lambda d: mixing.mix_sources(d, limit=2.0),
    "fingerprints": chunk_fingerprints.with_fingerprints,
    "fingerprint_pairs": chunk_fingerprints.document_fingerprints,
}
DROPPING = {"near", "quality", "suffix_text"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(clashing, name):
    rows = OPERATORS[name](clashing(ODD)).collect()
    if name not in DROPPING:
        assert len(rows) >= len(ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(clashing, name):
    assert OPERATORS[name](clashing(ODD).limit(0)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_only_missing_texts(documents, name):
    OPERATORS[name](documents([(None, None), (None, None), (1, None)])).collect()


def test_filters_keep_clashing_columns(clashing):
    docs = clashing([(i, f"some words {i} of a text that is long enough to be kept here number {i}") for i in range(30)])
    for filtered in (quality.keep_good(docs), simhash.drop_near_duplicates(docs), suffix_dedup.drop_repeats(docs)):
        assert filtered.columns == docs.columns
        assert {r.n_words for r in filtered.collect()} == {"own"}


# ---- 1


def test_bit_probabilities_sum_to_one():
    model = lm_scoring.Model(*lm_scoring.prefix_codes(np.zeros((257, 257), np.int64)), [np.zeros(1 << b, np.int16) for b in lm_scoring.SLOTS])
    rng = random.Random(1)
    for table in model.tables:
        table[:] = np.random.default_rng(2).integers(-2000, 2000, len(table)).astype(np.int16)
    # All texts of up to one byte, and all longer ones by their first two bytes: one byte's continuations share its mass.
    stem = bytes([rng.randrange(97, 120)])
    losses = model.losses([stem + bytes([b]) for b in range(256)])
    assert np.exp(-losses).sum() < 1
    # The end after the stem takes what the 256 bytes leave, so first symbols alone sum to one.
    bits = lm_scoring.Bits([b""], model.code)
    total = 0.0
    for symbol in range(257):
        some = lm_scoring.Bits([b"" if symbol == 256 else bytes([symbol])], model.code)
        odds, _ = model.odds(some)
        mine = some.symbol == 0
        right = np.where(some.value == 1, odds, -odds)[mine]
        total += np.exp(-np.log1p(np.exp(-right.astype(float))).sum())
    assert total == pytest.approx(1, abs=1e-5) and len(bits.symbols) == 1


def test_long_texts_are_read_in_parts(monkeypatch):
    monkeypatch.setattr(lm_scoring, "LONG_TEXT", 1000)
    texts = [b"ab", b"x" * 3500, b"", b"cd " * 299 + b"cd", b"efg " * 300 + b"h"]
    parts = [(i, list(map(len, some)), ended) for i, some, ended in lm_scoring.bundles(texts)]
    assert parts == [
        (0, [2], True), (1, [1000], False), (1, [1000], False), (1, [1000], False), (1, [500, 0, 899], True), (4, [1000], False), (4, [201], True),
    ]
    assert b"".join(some[0] for i, some, _ in lm_scoring.bundles(texts) if i == 4) == texts[4]
    model = lm_scoring.Model(*lm_scoring.prefix_codes(np.zeros((257, 257), np.int64)), [np.zeros(1 << b, np.int16) for b in lm_scoring.SLOTS])
    # Even bits: the code lengths.
    assert model.losses(texts)[[0, 2]] == pytest.approx([-np.log(p) for p in (2.0 ** -sum(model.lengths[a, b] for a, b in ((256, 97), (97, 98), (98, 256))), 2.0 ** -float(model.lengths[256, 256]))])
    # Counts go with their words over all parts; a word cut in two has none, nor has what follows it.
    counts, used = [np.arange(1.0, len(t.split()) + 1) for t in texts], {}
    found = [lm_scoring.word_counts(bundle, counts, used) for bundle in lm_scoring.bundles(texts)]
    assert [list(c) for c, _ in found[1:4]] == [[0]] * 3 and list(found[0][0]) == [1]
    assert list(found[4][0]) == [0, 0, *range(1, 301)] and list(np.flatnonzero(found[4][1])) == [0, 1, 301]
    assert list(found[5][0]) == [*range(1, 251)] and not found[5][1].any()
    assert list(found[6][0]) == [*range(251, 302)] and list(np.flatnonzero(found[6][1])) == [50]


def plain_loss(model, weights, text, counts, words):
    """The loss of one text, symbol by symbol and bit by bit in plain Python."""
    m32 = 2**32 - 1

    def scrambled(x, factor):
        x = x * factor & m32
        return x ^ x >> 15

    symbols = [*text, lm_scoring.END]
    ends = [i for i, s in enumerate(symbols) if s in (32, lm_scoring.END)]
    state = {g: [1.0, 20.0, 0.0, 0.0] for g in range(16)}  # scale, bend; slope and bend of the segment
    share, hits, seen, total, segment = lm_scoring.WORD_SHARE, 0.0, 0, 0.0, 0

    def refine():
        nonlocal share
        for g in state.values():
            g[1] += g[3]
            g[0] = min(max(g[0] - g[2] / g[1], 0.3), 3)
            g[2:] = 0.0, 0.0
        if seen:
            share = min(max((lm_scoring.WORD_SHARE * lm_scoring.WORD_TRUST + hits) / (lm_scoring.WORD_TRUST + seen), 1e-4), 1 - 1e-4)

    begin = 0
    for number, end in enumerate(ends):
        if begin // lm_scoring.SEGMENT != segment:
            refine()
            segment = begin // lm_scoring.SEGMENT
        loss = 0.0
        for at in range(begin, end + 1):
            back = [symbols[at - k] if at >= k else lm_scoring.END for k in range(1, 7)]
            two = scrambled(back[0] * 521 + back[1] + 1 & m32, 0x9E3779B1)
            four = scrambled((two ^ back[2] * 521 + back[3]) + 2 & m32, 0x85EBCA6B)
            six = scrambled((four ^ back[4] * 521 + back[5]) + 3 & m32, 0xC2B2AE35)
            so_far = sum((s + 7) * 0x01000193**i for i, s in enumerate(symbols[begin:at]))
            word = scrambled(so_far + 4 & m32, 0x27D4EB2F)
            length, code = int(model.lengths[back[0], symbols[at]]), int(model.codes[back[0], symbols[at]])
            for place in range(length):
                node = ((1 << place | code >> length - place) * 0x9E3779B1 + back[0]) & m32
                held = [int(model.tables[k][((c ^ node) * 0x2C1B3C6D & m32) >> 32 - lm_scoring.SLOTS[k]]) for k, c in enumerate((two, four, six, word))]
                gate = (held[2] & 3) << 2 | held[1] & 3
                odds = sum(w * (h >> 2) / lm_scoring.UNIT for w, h in zip(weights[gate], held))
                z = -odds if code >> length - place - 1 & 1 else odds
                ratio = np.exp(min(z * state[gate][0], 60))
                loss += np.log1p(ratio)
                wrong = ratio / (1 + ratio)
                state[gate][2] += z * wrong
                state[gate][3] += z * z * wrong * (1 - wrong)
        c = counts[number] if len(counts) == len(ends) else 0
        known = c / words.total * np.exp(words.is_last if end == len(symbols) - 1 else words.goes_on)
        both = share * known + (1 - share) * np.exp(-loss)
        hits, seen, total = hits + share * known / both, seen + 1, total - np.log(both)
        begin = end + 1
    return total


def test_losses_equal_plain_python(monkeypatch):
    """Tables and weights of some texts, scores of others: several segments, an empty text, unknown words, all in one bundle."""
    monkeypatch.setattr(lm_scoring, "SEGMENT", 40)
    rng = random.Random(5)
    vocabulary = [bytes(rng.choices(b"abcdefgh\xc3\xa9", k=rng.randrange(1, 9))) for _ in range(40)]
    learned = [b" ".join(rng.choices(vocabulary, k=60)) for _ in range(40)]
    scored = [b"", b"a", b"zz qq", *(b" ".join(rng.choices([*vocabulary, b"new", b"words"], k=rng.randrange(1, 60))) for _ in range(12))]
    pairs = np.zeros((257, 257), np.int64)
    for text in learned:
        np.add.at(pairs, ([256, *text], [*text, 256]), 1)
    lengths, codes = lm_scoring.prefix_codes(pairs)
    tables = []
    bits = lm_scoring.Bits(learned, lm_scoring.Code(lengths, codes))
    for k, size in enumerate(lm_scoring.SLOTS):
        seen = np.zeros((1 << size, 2), np.int64)
        np.add.at(seen, (bits.slots(k), bits.value), 1)
        tables.append(lm_scoring.slot_values(seen[:, 0], seen[:, 1]))
    weights = np.random.default_rng(3).uniform(0.1, 0.6, (16, 4))
    numbers = {w: sum(t.split().count(w) for t in learned) for w in vocabulary}
    words = lm_scoring.Words(sum(numbers.values()), len(numbers), len(learned))
    counts = [np.array([numbers.get(w, 0) for w in t.split()], float) for t in scored]
    model = lm_scoring.Model(lengths, codes, tables, weights)
    plain = [plain_loss(model, weights, t, c, words) for t, c in zip(scored, counts)]
    assert model.losses(scored, counts, words) == pytest.approx(plain, rel=1e-4)


def test_weights_follow_the_predictors(documents, monkeypatch):
    """Fitted weights lose less on the texts they were fitted on than neutral ones, and do not depend on partitioning."""
    monkeypatch.setattr(lm_scoring, "SLOTS", (12, 14, 14, 14))
    monkeypatch.setattr(lm_scoring, "CHUNK", 1 << 12)
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(200)]
    docs = documents([(i, " ".join(rng.choices(vocabulary, k=80))) for i in range(300)])
    found = []
    for df in (docs, docs.repartition(5)):
        blocks = lm_scoring.corpus_blocks(df)
        model = lm_scoring.trained(blocks)
        found.append(np.stack(model.weights))
        rows = [(lm_scoring._training_texts(pa.RecordBatch.from_pydict({"rows": [r.rows], "texts": [r.texts]}), True)) for r in blocks.collect()]
        texts = [t for some in rows for t in some]
        neutral = lm_scoring.Model(model.lengths, model.codes, model.tables)
        assert 5 < len(texts) < 40 and model.losses(texts).sum() < neutral.losses(texts).sum()
    assert (found[0] == found[1]).all()


def test_repeated_contexts_are_counted_once():
    """Every predictor's counters as from each bit by itself, from few distinct contexts; texts of any size, ended or not."""
    rng = random.Random(6)
    vocabulary = [bytes(rng.choices(b"abcdefgh\xc3\xa9", k=rng.randrange(1, 9))) for _ in range(30)]
    texts = [b"", b"a", b"", *(b" ".join(rng.choices(vocabulary, k=rng.randrange(1, 200))) for _ in range(30)), b"bc", b""]
    code = lm_scoring.Code(*lm_scoring.prefix_codes(np.zeros((257, 257), np.int64)))
    for some, ended in ((texts, True), ([b" ".join(texts)], False)):
        bits, met = lm_scoring.Bits(some, code, ended), set()
        for k, pairs, contexts, times in lm_scoring.repeated_contexts(some, ended):
            assert times.sum() == len(bits.symbols) and len(times) < len(bits.symbols) / 2
            few = lm_scoring.Bits.of_symbols(pairs, {k: contexts}, code)
            size = 2 << lm_scoring.SLOTS[k]
            found = np.bincount(few.counters(k), weights=times[few.symbol], minlength=size)
            assert (found == np.bincount(2 * bits.slots(k) + bits.value, minlength=size)).all()
            met.add(k)
        assert met == set(range(len(lm_scoring.SLOTS)))


def test_tokens_of_a_block():
    texts = [b"", b"a bc a", b"", b"", b"d", b"bc \xc3\xa9"]
    for some in (texts, texts[:1], texts[1:2], texts[::-1]):
        tokens, sizes = lm_scoring.tokens_of(b"\n".join(some))
        assert tokens.to_pylist() == [x for t in some for x in [*t.split(), b""]]
        assert sizes.tolist() == [len(t.split()) + 1 for t in some]


def test_chunks_of_counters_keep_their_numbers(monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK", 4)
    for most in (0, 255, 256, 1 << 16, 1 << 31, 1 << 40):
        data = lm_scoring._narrowed(np.array([0, 1, most, 2], np.int64)).tobytes()
        assert lm_scoring._widened(data).tolist() == [0, 1, most, 2] and len(data) <= 4 * max(1, 2 * (most.bit_length() / 8))


def test_known_words_score_better_with_their_counts():
    words = lm_scoring.Words(1000, 50, 20)
    model = lm_scoring.Model(*lm_scoring.prefix_codes(np.zeros((257, 257), np.int64)), [np.zeros(1 << b, np.int16) for b in lm_scoring.SLOTS])
    text = b" ".join([b"frequent"] * 30)
    plain = model.losses([text])[0]
    assert model.losses([text], [np.full(30, 400.0)], words)[0] < plain / 3
    # Unknown words lose no more than what the mix set aside.
    assert plain < model.losses([text], [np.zeros(30)], words)[0] < plain + 3


def test_scores_do_not_depend_on_partitioning(documents):
    docs = documents([(i, f"the {i % 7} quick brown foxes jump over {i % 3} lazy dogs " * 5) for i in range(60)])
    first = sorted(map(tuple, lm_scoring.score_documents(docs).collect()))
    assert sorted(map(tuple, lm_scoring.score_documents(docs.repartition(7)).collect())) == first


# ---- 2


@pytest.mark.parametrize("total", [1, 2, 3, 64, 1000, 4097])
def test_feistel_permutes(total):
    there = sharding.permute(np.arange(total), total, 7)
    assert sorted(there.tolist()) == list(range(total))
    assert (sharding.permute(there, total, 7, back=True) == np.arange(total)).all()
    shard, slot = sharding.place(total - 1, total, 5, 7)
    assert sharding.row_at(shard, slot, total, 5, 7) == total - 1


# ---- 3


def test_offsets_of_split_characters():
    tokens = ["a".encode(), "é".encode()[:1], "é".encode()[1:], "b\U0001f600".encode()[:3], "\U0001f600".encode()[2:]]
    assert bpe.character_starts(tokens) == ([0, 1, 1, 2, 3], 4)
    assert bpe.character_starts([]) == ([], 0)
    assert sorted(bpe.byte_characters().values()) == list(range(256))


# ---- 4


def test_suffix_array_by_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        symbols = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))] * rng.randint(1, 3) + [0]
        assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.mark.parametrize("part", [1, 2048])
def test_passages_runs_and_edges(documents, monkeypatch, part):
    monkeypatch.setattr(suffix_dedup, "PART", part)
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    passage = noise(420)
    rows = [(i, noise(rng.randint(0, 500)) + passage[rng.randint(0, 60) :] + noise(rng.randint(0, 300))) for i in range(40)]
    rows += [(100, "a" * 900), (101, "ab" * 300), (102, noise(199)), (103, noise(5000)), (104, passage[:199]), (105, "x" * 200), (106, "x" * 200)]
    from test_llm_queries import removed_bytes

    found = {r.doc_id: r for r in suffix_dedup.without_repeats(documents(rows)).collect()}
    for i, raw, gone in removed_bytes(dict(rows)):
        assert found[i].kept == np.frombuffer(raw, np.uint8)[~gone].tobytes(), i


def test_long_texts_are_cut_into_pieces(documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    rng = random.Random(7)
    long = "".join(rng.choices("abcdefghij ", k=9000))
    found = {r.doc_id: r for r in suffix_dedup.without_repeats(documents([(1, long), (2, "y" * 30 + long[2500:4700])])).collect()}
    assert [(r.start, r.end) for r in found[1].removed] == [(2500, 4700)]
    assert [(r.start, r.end) for r in found[2].removed] == [(30, 2230)]


# ---- 5


def test_url_rules_are_indexed_by_their_rarest_token():
    assert url_filters.literal_tokens("||example.org/en/1") == ["example", "org", "en"]
    assert url_filters.literal_tokens("/ads*/x^") == ["x"]
    index = url_filters.index_rules([url_filters.Rule("||a.b/", True), url_filters.Rule("*zip|", True)], {"a": 5, "b": 2})
    assert index == {"b": [0], None: [1]}


def test_url_verdicts(spark):
    cases = {
        "https://www.example.org/es/1": ("example.org/es/", "block"),
        "https://www.example.org/fr/1": ("org/", "allow"),
        "http://EXAMPLE.org/en/19": ("example.org/en/1", "block"),
        "http://notexample.org/es/": ("org/", "allow"),
        "http://x.com/de": (None, "allow"),
        "http://x.com/de/": ("com/de/", "block"),
        "http://x.org": (None, "allow"),
        "http://x.org:80/es/": (None, "allow"),
        "http://x.net/a.zip": (None, "block"),
        "http://x.net/a?f=/de/#.zip": (None, "block"),
        "no scheme.org/": (None, "allow"),
        None: (None, "allow"),
    }
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id bigint, url string")
    found = url_filters.page_verdicts(rows).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in found] == list(cases.values())
    assert (found[-1].host, found[-1].path, found[2].host) == ("", "", "example.org")


def test_thousands_of_url_rules_equal_their_expressions(spark):
    rng = random.Random(5)
    hosts = [f"{rng.choice('abcdef')}{rng.randrange(60)}.{rng.choice(['net', 'org', 'co.uk'])}" for _ in range(800)]
    parts = [f"p{i}" for i in range(200)]
    rules = [url_filters.Rule(f"||{h}^", rng.random() < 0.5) for h in hosts]
    rules += [url_filters.Rule(f"/{rng.choice(parts)}*{rng.choice(parts)}/", True) for _ in range(1500)]
    rules += [url_filters.Rule(f"{rng.choice(parts)}.html|", False) for _ in range(100)]
    rules += [url_filters.site_rule(f"{rng.choice(hosts)}/{rng.choice(parts)}", rng.random() < 0.5) for _ in range(700)]
    urls = [f"http://www.{rng.choice(hosts)}/{'/'.join(rng.choices(parts, k=rng.randrange(4)))}{rng.choice(['', '/', '.html'])}" for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    found = url_filters.judge_urls(rows, rules).orderBy("page_id").collect()
    compiled = [re.compile(url_filters.expression(r.pattern), re.DOTALL) for r in rules]
    for url, row in zip(urls, found, strict=True):
        fitting = [r for r, c in zip(rules, compiled) if c.search(url_filters.url_parts(url)[2])]
        site = max((r for r in fitting if r.site), key=lambda r: len(r.site), default=None)
        other = min((r for r in fitting if not r.site), key=lambda r: r.block, default=None)
        decides = site or other
        assert row.rule == (site.site if site else None) and row.verdict == ("block" if decides and decides.block else "allow")
    # Counted are tokens of rules only, whatever else the URLs hold.
    counts = url_filters.token_counts(rows, ["p1", "net", "absent"])
    assert counts == {t: n for t in ("p1", "net") if (n := sum(t in re.findall(url_filters.TOKEN, u.split("://")[1]) for u in urls))}


# ---- 6


@pytest.mark.parametrize("agree", [2, 3, 4])
def test_longer_keys_lose_no_link(spark, agree):
    rng = np.random.default_rng(agree)
    prints = rng.integers(0, 2**63, 300).astype(np.uint64)
    near = prints.copy()
    for k in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    rows = [(i, [int(v)]) for i, v in enumerate(np.concatenate([prints, near]).view(np.int64))]
    table = spark.createDataFrame(rows, "doc_id bigint, fingerprint array<bigint>")
    found = simhash.classified(table, simhash.block_keys(4, agree), 4, 1).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i % 300 for i in range(600)}


def test_keys_grow_with_the_table():
    sizes = [simhash.agreeing_blocks(n, 4) for n in (0, 10**6, 10**8, 10**9, 10**10, 10**11, 10**13)]
    assert sizes == [2, 2, 2, 3, 3, 4, 4]


@pytest.mark.parametrize("words, radius", [(1, 4), (2, 3), (4, 40)])
def test_bit_sliced_components(words, radius):
    rng = np.random.default_rng(words)
    sizes = rng.integers(2, 200, 12)
    starts = np.cumsum(sizes) - sizes
    prints = rng.integers(0, 2**63, (int(sizes.sum()), words)).astype(np.uint64)
    for i in range(1, len(prints)):
        if rng.random() < 0.6:
            prints[i] = prints[rng.integers(max(0, i - 20), i)]
            for bit in rng.integers(0, 64 * words, rng.integers(0, radius + 3)):
                prints[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    expected = np.arange(len(prints))
    for start, size in zip(starts, sizes):
        block = prints[start : start + size]
        near = np.bitwise_count(block[:, None] ^ block[None]).sum(axis=2) <= radius
        label = np.arange(start, start + size)
        for _ in range(size):
            label = np.where(near, label, len(prints)).min(axis=1)
        expected[start : start + size] = label
    assert (simhash.local_roots(prints, starts, sizes, radius) == expected).all()


def test_large_buckets_are_cut(spark, documents, monkeypatch):
    rows = [(i, " ".join(f"t{k}" for k in range(300)) + f" end {i}") for i in range(120)]
    usual = sorted(map(tuple, simhash.linked_documents(documents(rows)).collect()))
    monkeypatch.setattr(simhash, "CELL", 4)
    assert sorted(map(tuple, simhash.linked_documents(documents(rows)).collect())) == usual


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 199), (300, 300)]
    random.Random(1).shuffle(edges)
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert found == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)} | {200: 199}


def test_sides_that_end_in_nul():
    sides = [b"ab\0", b"ab", b"ab\0c", b"\0\0", b"", b"\0"]
    assert suffix_dedup._shared(np.zeros(6, np.int64), sides).tolist() == [3, 2, 3, 1, 0, 1]


# ---- 7


def test_base_counts():
    text = "a b c d e x\na b c d e x\n\n # * é\n # * é\n"
    assert quality.measure(text) == (18, 18, 4, 2, 12, 4, 0)
    assert quality.measure("") == (0, 0, 0, 0, 0, 0, 0)
    assert quality.measure("a a a a a a") == (6, 6, 0, 0, 6, 1, 5)


def test_sketch_buckets(spark):
    values = spark.createDataFrame([(0,), (1,), (63,), (64,), (65,), (1000,), (10**12,)], "v bigint")
    edges = [r[0] for r in values.select(quality.bucket(F.col("v"))).collect()]
    assert edges[:5] == [0, 1, 63, 64, 64] and edges[5] == 992 and 0 <= 10**12 - edges[6] < 10**12 / 32


def test_fences_join_by_keys_only(documents):
    counts = quality.measured(quality.texts_of(documents(ODD)))
    text = quality.judge(counts, quality.fences(counts))._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


# ---- 8


def test_licence_rules(documents):
    lines = {k: licenses.SENTENCES[k] for k in licenses.SENTENCES}
    bsd = [lines["bsd.grant"] + "\n\n", "1. " + lines["bsd.source"] + ".\n", "2. " + lines["bsd.binary"] + ".\n"]
    texts = {
        1: "Prose.\n" + lines["mit.notice"] + ".\nMore",
        2: (lines["mit.grant"] + "\n\n" + lines["mit.copies"] + ".").replace(" software ", " software\n   "),
        3: "".join(bsd),
        4: "".join([*bsd, "3. " + lines["bsd.endorse"] + "."]),
        5: "".join(reversed(bsd)),
        6: lines["gpl3.notice"].upper() + ". " + lines["apache2.notice"] + ".",
        7: "This has a permission and a licence, but no known sentence.",
    }
    found = {r.doc_id: r.licences for r in licenses.scan_licences(documents(texts.items())).collect()}
    assert found == {1: ["MIT"], 2: ["MIT"], 3: ["BSD-2-Clause"], 4: ["BSD-3-Clause"], 5: [], 6: ["Apache-2.0", "GPL-3.0"], 7: []}


def test_licences_by_tags_titles_and_parts(documents):
    lines = licenses.SENTENCES
    apache = lines["apache2.notice_the"] + ";\n" + lines["apache2.not_use"] + "."
    texts = {
        "#!/bin/sh\n# SPDX-License-Identifier: MIT\nexit": ["MIT"],
        "/* SPDX-License-Identifier: Apache-2.0 */": ["Apache-2.0"],
        "// SPDX-License-Identifier:GPL-2.0-only\n// SPDX-License-Identifier: EPL-2.0": ["EPL-2.0", "GPL-2.0-only"],
        "SPDX-License-Identifier: Made-Up-1.0": [],
        "MIT\nGPL-2.0-only": [],
        apache: ["Apache-2.0"],
        "Apache License\n   Version 2.0, January 2004\n": ["Apache-2.0"],
        "Version 2.0, January 2004\nApache License": [],
        "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007": ["AGPL-3.0"],
        "This program is free software: " + lines["agpl.3_later"].replace(" the GNU", "\n    the GNU") + ".": ["AGPL-3.0-or-later"],
        lines["lgpl.notice"] + "; " + lines["lgpl.terms"] + "; " + lines["lgpl.21_later"] + ".": ["LGPL-2.1-or-later"],
        lines["unlicense.title"] + ".\n": ["Unlicense"],
        "\n".join(lines[f"bsd.{part}"] + "." for part in ("grant", "source", "binary", "advert", "endorse")): ["BSD-4-Clause"],
        lines["zlib.as_is"] + ".": [],
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.": ["CC-BY-NC-SA-3.0"],
        lines["mit0.grant"] + "\n": ["MIT-0"],
    }
    found = licenses.scan_licences(documents(enumerate(texts))).orderBy("doc_id").collect()
    assert [r.licences for r in found] == list(texts.values())
    # A part of a licence is told from none by its sentences.
    known = dict(zip(texts, (r.sentence_ids for r in found)))
    assert known[lines["zlib.as_is"] + "."] == ["zlib.as_is"] and known["MIT\nGPL-2.0-only"] == []


def test_every_licence_is_found_by_its_rule(documents):
    texts = [".\n".join(licenses.SENTENCES[n] for n in names) + "." for _, names in licenses.RULES]
    found = licenses.scan_licences(documents(enumerate(texts))).orderBy("doc_id").collect()
    hidden = dict((shorter, longer) for longer, shorter in licenses.WITHIN)
    for r, (licence, _) in zip(found, licenses.RULES, strict=True):
        assert licence in r.licences or hidden[licence] in r.licences, (licence, r)
    assert len(licenses.KNOWN) == len(licenses.SENTENCES)


def test_texts_left_uncut_hold_no_known_sentence():
    assert all(re.search(licenses.NEEDED, sentence) for sentence in licenses.KNOWN)
    assert {name for _, names in licenses.RULES for name in names} == set(licenses.SENTENCES)


def test_licence_scan_is_native(documents):
    text = licenses.scan_licences(documents(ODD))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text


# ---- 9


@pytest.mark.parametrize("options", [{"entropy": 1.9}, {"limit": 3.0}, {"limit": 3.0, "budget": 2500}, {"limit": 1.0}])
def test_mix_weights(spark, options):
    shares = {"a": 8000, "b": 1000, "c": 600, "d": 400, "e": 0}
    totals = spark.createDataFrame(list(shares.items()), "source string, tokens bigint")
    rows = {r.source: r for r in mixing.source_weights(totals, **options).collect()}
    weights = {s: r.weight for s, r in rows.items()}
    assert sum(weights.values()) == pytest.approx(1) and weights["e"] == 0 and rows["e"].full == 1
    entropy = -sum(w * np.log2(w) for w in weights.values() if w)
    rates = [weights[s] / shares[s] for s in "abcd"]
    if "entropy" in options:
        assert entropy == pytest.approx(1.9, abs=1e-4)
    else:
        assert max(rates) / min(rates) == pytest.approx(options["limit"], rel=1e-4)
    quota = {s: r.full * shares[s] + r.part for s, r in rows.items() if s != "e"}
    if "budget" in options:
        assert sum(quota.values()) == pytest.approx(2500, abs=4)
    else:
        assert min(quota[s] / shares[s] for s in quota) == pytest.approx(1)


def test_mix_uses_rows_as_planned(spark):
    rows = [(i, "word " * (1 + i % 40), "big" if i % 10 else "small") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mixing.mix_sources(docs, limit=2.5, seed=3)
    used = {r.source: r for r in mixed.groupBy("source").agg(F.sum("tokens").alias("n"), F.countDistinct("doc_id").alias("d")).collect()}
    total = {r[0]: r[1] for r in docs.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("word")))).collect()}
    assert used["big"].n == total["big"] and used["big"].d + used["small"].d == 6000
    assert abs(used["small"].n - 2.5 * total["small"]) <= 40
    again = mixing.mix_sources(docs.repartition(9), limit=2.5, seed=3)
    key = lambda d: sorted(map(tuple, d.select("doc_id", "round", "block_rank", "row_rank").collect()))
    assert key(again) == key(mixed)
    assert "Python" not in mixed._jdf.queryExecution().toString()


@pytest.mark.parametrize("bits, blocks", [(0, 1), (2, 1), (10, 3), (10, 1024)])
def test_mix_cuts_at_the_first_row_that_meets_the_rest(spark, monkeypatch, bits, blocks):
    monkeypatch.setattr(mixing, "PIECE_BITS", bits or 1)
    monkeypatch.setattr(mixing, "BLOCKS", blocks)
    words = lambda i: 0 if i % 11 == 0 else 1 + i * 7 % 40
    rows = [(i, "word " * words(i), "big" if i % 10 else None if i % 20 else "small") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mixing.mix_sources(docs, limit=2.6, seed=3).collect()
    totals = docs.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("word"))).alias("tokens"))
    plans = mixing.source_weights(totals, limit=2.6).collect()
    for plan in plans:
        # Rows of the part round in the order of block and row hashes, up to the first that meets its tokens.
        hashed = F.xxhash64(F.lit(3), "doc_id", "text")
        mine = docs.where(F.col("source").eqNullSafe(F.lit(plan.source))).withColumn("block", F.pmod(hashed, F.lit(blocks)))
        rank = F.xxhash64(F.lit(3), F.lit(plan.full + 1).cast("bigint"), "source", "block")
        placed = mine.select(rank.alias("rank"), "block", F.xxhash64(hashed).alias("row"), F.regexp_count("text", F.lit("word")).alias("n"), "doc_id")
        used, expected = 0, set()
        for r in sorted(placed.collect()):
            if used < plan.part:
                expected.add(r.doc_id)
            used += r.n
        found = [r.doc_id for r in mixed if r.source == plan.source and r["round"] == plan.full + 1]
        assert len(found) == len(expected) and {*found} == expected
    assert any(plan.part for plan in plans)


# ---- 10


def test_chunks_resist_shifts():
    rng = random.Random(8)
    text = "".join(rng.choices("abcdefghijklmnop é\n", k=20_000))
    ends = chunk_fingerprints.boundaries(text.encode())
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text.encode()) and sizes.max() <= chunk_fingerprints.MOST and sizes[:-1].min() >= chunk_fingerprints.LEAST
    mine, shifted = chunk_fingerprints.fingerprint(text), chunk_fingerprints.fingerprint("xyz" + text)
    assert chunk_fingerprints.likeness(mine, shifted) > 0.95
    assert chunk_fingerprints.likeness(mine, chunk_fingerprints.fingerprint(text[:10_000])) > 0.95
    other = "".join(rng.choices("abcdefghijklmnop é\n", k=20_000))
    assert chunk_fingerprints.likeness(mine, chunk_fingerprints.fingerprint(other)) < 0.05
    assert chunk_fingerprints.likeness("", "") == 1 and chunk_fingerprints.likeness("", mine) == 0


def test_gear_hash_spans_blocks(monkeypatch):
    raw = "".join(random.Random(9).choices("abc ", k=9000)).encode()
    usual = chunk_fingerprints.boundaries(raw)
    monkeypatch.setattr(chunk_fingerprints, "BLOCK", 500)
    assert chunk_fingerprints.boundaries(raw) == usual


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_next_documents_over_ranges(spark, documents, parts):
    ids = [5] * 40 + [None] * 9 + list(range(60, 10, -1))
    rows = [(i, f"text {k}") for k, i in enumerate(ids)]
    pairs = chunk_fingerprints.followed(documents(rows), lambda: lambda a, b: (a, b), "mine string, other string", parts)
    found = [(r.mine, r.other) for r in pairs.collect()]
    assert len(found) == len(rows) and {m for m, _ in found} == {o for _, o in found} == {t for _, t in rows}
    following, ident = dict(found), {t: i for i, t in rows}
    # One circle through all, with ascending ids but for the step to its beginning.
    at, steps, falls = rows[0][1], 0, 0
    while steps < len(rows):
        key = lambda t: -1 if ident[t] is None else ident[t]
        falls += key(following[at]) < key(at)
        at, steps = following[at], steps + 1
    assert at == rows[0][1] and falls == 1


# ---- 3


def test_both_files_of_the_vocabulary_agree():
    """The query reads the ranks as JSON; the file of ranks by name holds the same tokens under the same numbers."""
    with open(vocabulary("byte_bpe_50k.tiktoken")[0], "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    with open(vocabulary()[0], encoding="utf-8") as file:
        listed = json.load(file)["model"]["vocab"]
    # Printable bytes stand for themselves, the others for the characters from 256 on, in their order.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    spelled = {bytes(byte_of[c] for c in token): n for token, n in listed.items() if all(c in byte_of for c in token)}
    assert spelled.items() >= ranks.items()
    assert len(ranks) >= 50_000
