"""Every query against its SQL or a brute-force version, on the given small tables."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from oracle import connect, differences

import corpus_pipeline
from newsloom.llm import simhash
from newsloom.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def result(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, SF_DIR).collect()}


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("name", ORACLE)
def test_query_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLE[name]) is None


def test_op1_base_scores(spark, texts):
    found = result(spark, "op1_lm_scoring")
    tokens = {i: [*WORDS.findall(lowered(t)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = collections.Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    n, v = counts.total(), len(counts)
    for i, ts in tokens.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ts), sum(t in counts for t in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts))
        assert r.score < 0


def test_op2_law_of_rows(spark, texts):
    found = result(spark, "op2_sharding")
    assert found.keys() == texts.keys()
    slots = collections.defaultdict(list)
    for i, r in found.items():
        raw = texts[i].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op3_equals_tiktoken(spark, texts):
    import public_tokenizers
    import tiktoken

    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = result(spark, "op3_byte_bpe")
    for i, text in texts.items():
        ids = encoding.encode_ordinary(text)
        packed = np.array(ids, "<u4").tobytes()
        assert (found[i].n_tokens, found[i].ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert found[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def removed_bytes(texts):
    """By brute force: for each text which bytes a repeated 200-byte string covers."""
    raws = {i: t.encode() for i, t in texts.items()}
    counts = collections.Counter(r[p : p + 200] for r in raws.values() for p in range(len(r) - 199))
    for i, raw in raws.items():
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 199):
            if counts[raw[p : p + 200]] > 1:
                gone[p : p + 200] = True
        yield i, raw, gone


def test_op4_removes_repeated_strings(spark, texts):
    found = result(spark, "op4_suffix_dedup")
    for i, raw, gone in removed_bytes(texts):
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), int(gone.sum()), spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_op6_links(spark, texts):
    import xxhash

    prints = {}
    for i, text in texts.items():
        words = WORDS.findall(lowered(text))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    roots = {i: i for i in prints}

    def root(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in prints:
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                roots[max(a, b)] = min(a, b)
    for i, r in result(spark, "op6_simhash").items():
        assert (r.fingerprint, r.component_id) == (f"{prints[i]:016x}", root(i))


def test_op9_meets_the_limit(spark, texts):
    rows = QUERIES["op9_source_mixing"](spark, SF_DIR).collect()
    used, sizes, tokens = collections.Counter(), collections.Counter(), {}
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in rows:
        used[r.source] += r.tokens
        tokens[r.doc_id] = r.tokens
    assert tokens == {i: len(WORDS.findall(t)) for i, t in texts.items()}
    for i, n in tokens.items():
        sizes[sources[i]] += n
    rounds = {s: used[s] / sizes[s] for s in sizes}
    assert min(rounds.values()) == pytest.approx(1)
    # Sources that differ by less than the limit are made alike, else the limit is reached; the last document of a source may go beyond.
    reached = min(4, max(sizes.values()) / min(sizes.values()))
    assert reached - 1e-3 <= max(rounds.values()) <= reached + max(tokens.values()) / min(sizes.values())
    weights = {r.source: r.weight for r in rows}
    assert sum(weights.values()) == pytest.approx(1)
    budget = max(sizes[s] / w for s, w in weights.items())
    for s, w in weights.items():
        # The document that meets a source's tokens is taken whole.
        assert -1 <= used[s] - w * budget <= max(n for i, n in tokens.items() if sources[i] == s)


def test_op10_edits_and_likeness(spark, texts):
    found, order = result(spark, "op10_document_fingerprints"), sorted(texts)
    for k, i in enumerate(order):
        text, following = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if text == following:
            assert r.near_next == 1
    likely = [found[i].near_edited for i in order if len(texts[i]) > 2000]
    assert sum(likely) / len(likely) > 0.35
    assert sorted(found[i].near_next for i in order)[len(order) // 2] < 0.2


def test_pipeline_stages(spark, texts):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
        seen[name] = docs.collect()
        if name != "byte-level BPE":
            assert docs.columns == columns
    good = {r.doc_id for r in QUERIES["op7_quality_rules"](spark, SF_DIR).where("kept").collect()}
    assert {r.doc_id for r in seen["quality rules"]} == good
    # Of equal texts one stays, that with the smallest id; it is among the kept ones.
    first = {}
    for i in sorted(good):
        first.setdefault(texts[i], i)
    stay = {r.doc_id for r in seen["SimHash near-dedup"]}
    assert stay <= set(first.values()) and len(stay) > 0.9 * len(first)
    before = {r.doc_id: r.text for r in seen["SimHash near-dedup"]}
    after = {r.doc_id: r.text for r in seen["suffix-array dedup"]}
    for i, raw, gone in removed_bytes(before):
        if not gone.any():
            assert after[i] == before[i]
        elif not gone.all():
            assert after[i] == np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        else:
            assert i not in after
    assert {r.doc_id for r in seen["mixing sources"]} == after.keys()
    assert all(r.exact and r.n_tokens * 4 == len(r.ids) for r in seen["byte-level BPE"])
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(seen["byte-level BPE"])


def jaccard(a, b, n=5):
    sets = [{tuple(t.split()[k : k + n]) for k in range(len(t.split()) - n + 1)} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_go_and_others_stay(spark, documents):
    rng = np.random.default_rng(3)
    make = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows, copies = [], {}
    for i in range(60):
        words = make(int(rng.integers(120, 800)))
        rows.append((i, " ".join(words)))
        edited = list(words)
        for at in rng.integers(0, len(words), max(1, len(words) // 90)):
            edited[at] = "edited"
        copies[1000 + i] = " ".join(edited)
        assert jaccard(rows[-1][1], copies[1000 + i]) > 0.85
    kept = {r.doc_id for r in simhash.drop_near_duplicates(documents(rows + list(copies.items()))).collect()}
    assert kept == set(range(60))


def edited_to(rng, words, low, high):
    """``words`` with single words replaced until the similarity of five-word shingles is between low and high."""
    copy = list(words)
    while jaccard(" ".join(words), " ".join(copy)) > high:
        copy[int(rng.integers(len(copy)))] = f"edit{rng.integers(10**6)}"
    return " ".join(copy) if jaccard(" ".join(words), " ".join(copy)) >= low else None


def test_the_similarity_of_shingles_decides(spark, documents):
    rng = np.random.default_rng(5)
    rows, stay = [], set()
    for i in range(150):
        words = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        far = i % 2 == 1
        copy = None
        while copy is None:
            copy = edited_to(rng, words, *((0.70, 0.79) if far else (0.80, 0.82)))
        # Repeated sentences do not change a set of shingles much, but would a fingerprint that counts them.
        rows += [(i, " ".join(words)), (1000 + i, copy + (" " + copy if i % 6 == 0 else ""))]
        if jaccard(rows[-2][1], rows[-1][1]) < 0.8:
            stay.add(1000 + i)
    assert 70 < len(stay) < 110
    kept = {r.doc_id for r in simhash.drop_near_duplicates(documents(rows)).collect()}
    assert kept == set(range(150)) | stay


def test_cut_cells_find_the_same_near_copies(spark, documents, monkeypatch):
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join([*words[: i % 40], f"new{i}", *words[i % 40 :]])) for i in range(90)]
    monkeypatch.setattr(simhash, "CELL", 8)
    monkeypatch.setattr(simhash, "CELL_BYTES", 1 << 14)
    assert [r.doc_id for r in simhash.drop_near_duplicates(documents(rows)).collect()] == [0]


def shares_no_minima(a, b, size=5):
    """Whether two texts share no pair of minimal shingle hashes."""
    least = []
    for text in (a, b):
        hashes = np.unique(simhash.shingle_hashes(text, size))
        some = [int(simhash._remixed(hashes, 100 + k).min()) for k in range(simhash.BANDS * simhash.PER_BAND)]
        least.append([some[k * simhash.PER_BAND : (k + 1) * simhash.PER_BAND] for k in range(simhash.BANDS)])
    return all(x != y for x, y in zip(*least))


def test_similar_sets_without_a_common_bucket_are_linked(spark, documents):
    """Pairs at 0.8 that no bucket holds, so that fingerprints cannot propose them."""
    rng, rows = np.random.default_rng(8), []
    while len(rows) < 6:
        words = [f"w{x}" for x in rng.integers(0, 10**6, 9)]
        if shares_no_minima(" ".join(words), " ".join(words[:8])):
            rows += [(len(rows), " ".join(words)), (len(rows) + 100, " ".join(words[:8]))]
            assert jaccard(rows[-1][1], rows[-2][1]) == 0.8
    kept = {r.doc_id for r in simhash.drop_near_duplicates(documents(rows)).collect()}
    assert kept == {0, 2, 4}


@pytest.mark.parametrize("cell", [simhash.LINK_CELL, 4])
def test_classes_without_any_proposal_match_brute_force(spark, documents, monkeypatch, cell):
    """Every pair is found where fingerprints propose none: clusters, chains, a common passage, odd and repeated rows."""
    monkeypatch.setattr(simhash, "radius_for", lambda similarity, words: 0)
    monkeypatch.setattr(simhash, "LINK_CELL", cell)
    monkeypatch.setattr(simhash, "HELD", 3)
    monkeypatch.setattr(simhash, "PAIRS", 50)
    rng = np.random.default_rng(9)
    passage, rows = [f"p{k}" for k in range(30)], [(None, None), (900, ""), (901, "one"), (902, "one"), (None, "two words")]
    for i in range(25):
        words = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(5, 60)))]
        words = passage + words[:7] if i % 5 == 0 else words
        for k in range(4):
            rows.append((10 * i + k, " ".join(words)))
            at = int(rng.integers(len(words)))
            words = words[:at] + [f"new{i}_{k}"] + words[at + int(rng.integers(2)) :]
    shingles = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").split() for _, t in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            either = shingles[i] | shingles[j]
            if not either or 5 * len(shingles[i] & shingles[j]) >= 4 * len(either):
                root = [root[j] if r == root[i] else r for r in root]
    # The smallest id of each class; of those without one, any.
    expected = sorted(min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=-1) for r in set(root))
    assert 30 < len(expected) < len(rows) - 20
    kept = simhash.drop_near_duplicates(documents(rows + rows[6:9])).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept) == expected
