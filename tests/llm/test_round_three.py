"""Merkle manifest, spelling variants and embedding join against plain Python."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from conftest import rows_of

import corpus_pipeline
from newsloom.llm import bpe, chunk_fingerprints, grid_join, merkle, spelling, suffix_dedup
from newsloom.llm.queries import vocabulary as byte_vocabulary
from pyspark.sql import functions as F


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- Merkle manifest ----


def tree(digests):
    """Root, and for each leaf the (left, right) digests level by level."""
    nodes, owners, proofs = list(digests), [[i] for i in range(len(digests))], [[] for _ in digests]
    while len(nodes) > 1:
        above, over = [], []
        for s in range(0, len(nodes), 8):
            run = nodes[s : s + 8]
            for k in range(len(run)):
                for leaf in owners[s + k]:
                    proofs[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha("".join(run)))
            over.append([leaf for k in range(len(run)) for leaf in owners[s + k]])
        nodes, owners = above, over
    return nodes[0], proofs


@pytest.mark.parametrize("count", [1, 2, 7, 8, 9, 63, 64, 65, 70, 130, 513, 600])
def test_butterfly_gives_every_node_the_whole_path(spark, count):
    digests = [sha(f"{count}/{i}") for i in range(count)]
    rows = [(3, i, count, d) for i, d in enumerate(digests)] + [(4, 0, 1, "alone")]
    found = merkle.exchanged(spark.createDataFrame(rows, "g bigint, p bigint, n bigint, digest string")).collect()
    root, proofs = tree(digests)
    assert len(found) == count + 1
    for r in found:
        if r.g == 4:
            assert (r.top, r.upper) == ("alone", [])
        else:
            assert (r.top, [tuple(x) for x in r.upper]) == (root, proofs[r.p])


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)"""

    def leaf(r, text):
        return sha("".join(value(x) for x in (r[0], r[3], r[2], r[4], text)))

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0], leaf(r, r[1]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subtrees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subtrees[g] = tree([x[1] for x in groups[g]])
    root, tops = tree([subtrees[g][0] for g in order])
    result = []
    for j, g in enumerate(order):
        subroot, proofs = subtrees[g]
        for (doc_id, digest, r), proof in zip(groups[g], proofs):
            path = proof + tops[j]
            node = digest
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                node = leaf(r, None if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for left, right in path:
                node = sha(left + node + right)
            result.append((doc_id, digest, subroot, root, sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(result, key=repr)


def test_manifest_against_plain_python(spark):
    """Several blocks in one group, one leaf in another; NULLs, ties and repeated rows, an empty and a long text."""
    rows = [(i, f"Text {i} É", "en", "a", 9) for i in range(1200)]
    rows += [(i, "A" * 200_000 if i == 5 else "", "de", None, None) for i in range(9)]
    rows += [(7, "Alone", "fr", "b", 5), (None, "No id", None, None, 5), (None, None, None, "c", None), (3, "X", None, "c", 1)]
    rows += [(4, "Twice", "es", "d", 5)] * 3 + [(4, "Ties", "es", "d", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df = df.withColumns({"leaf": F.lit("own"), "root": F.lit("own"), "proof": F.lit("own")}).repartition(5)
    found = merkle.document_manifest(df)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows_of(found) == brute_manifest(rows)
    assert not found.where("doc_id = 5 and not verified").isEmpty() or zlib.crc32(b"5") % 3


def test_manifest_of_nothing(documents):
    assert merkle.document_manifest(documents([])).collect() == []


def test_manifest_keeps_other_columns(spark):
    leaves = spark.createDataFrame([("g", 1, "l", "x"), ("g", 2, "m", "y")], "by string, at int, leaf string, root string")
    found = merkle.manifest(leaves.withColumnRenamed("root", "extra"), "by", "at")
    assert rows_of(found.select("by", "at", "extra", "proof.left", "proof.right")) == [
        ("g", 1, "x", [""], ["m"]),
        ("g", 2, "y", ["l"], [""]),
    ]


# ---- spelling variants ----


def one_error(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_near(words):
    return sorted((a, n, b, m) for (a, n), (b, m) in itertools.permutations(words, 2) if one_error(a, b))


def vocabulary(seed, count, letters="abcü"):
    """Words and misspellings of them, many with common beginnings and ends."""
    rng = random.Random(seed)
    words = set()
    while len(words) < count:
        word = "".join(rng.choice(letters) for _ in range(rng.randint(7, 10)))
        if rng.random() < 0.3:
            word = "aaa" + word[3:]
        words.add(word)
        for _ in range(2):
            k, kind = rng.randrange(len(word)), rng.randrange(3)
            other = word[:k] + rng.choice(letters) * (kind < 2) + word[k + (kind > 0) :]
            if len(other) >= 7:
                words.add(other)
    return [(w, 1 + rng.randrange(5) ** 4) for w in sorted(words)]


@pytest.mark.parametrize("cell", [4096, 5])
def test_near_words_against_plain_python(spark, cell):
    """Small cells cut every common beginning into parts; the result stays whole and has no pair twice."""
    words = vocabulary(1, 300)
    found = spelling.near_words(spark.createDataFrame(words, "word string, n bigint"), cell)
    assert sorted(tuple(r) for r in found.collect()) == brute_near(words)


def test_index_steps_agree_with_counting():
    words = ["banana", "bandana", "anna"]
    index = spelling.FMIndex(words)
    text = "|" + "|".join(words) + "|"
    for pattern in ("a", "an", "ana", "nan", "|ban", "a|", "zz", "dana|a"):
        points = np.array([spelling.EDGE if c == "|" else index.coded(np.array([ord(c)], np.uint32))[0] for c in pattern])
        middle = len(pattern) // 2
        state = index.everywhere(1)
        for k in range(middle, len(points)):
            state = index.extended(state, points[k : k + 1], True) if state[2, 0] else state
        for k in range(middle - 1, -1, -1):
            state = index.extended(state, points[k : k + 1], False) if state[2, 0] else state
        starts = [i for i in range(len(text)) if text.startswith(pattern, i)]
        assert state[2, 0] == len(starts)
        assert sorted(index.places[state[0, 0] : state[0, 0] + state[2, 0]].tolist()) == starts


def brute_variants(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                k = h % len(run)
                counts[run[:k] + run[k + 1 :] if h % 31 == 0 else run] += 1
            run = ""
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_error(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) if vs else None for w, vs in near.items()}
    form = {w: v if v and words[v] >= 10 * words[w] else None for w, v in best.items()}
    result = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        result.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(result, key=repr)


def test_variants_against_plain_python(documents):
    """Chains of forms, ties, letters outside ASCII, repeated rows, NULLs, an empty and a very long text and word."""
    rng = random.Random(3)
    words = [w for w, _ in vocabulary(2, 60, "abñÈ")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)) + " Straßen×ball") for i in range(60)]
    rows += [(100 + i, "spelling " * 10**k + "spelling"[: 7 + (k > 0)] + "x" * (k == 0) + " sspelling" * (k == 1)) for i, k in enumerate([0, 1, 2, 0, 1, 2])]
    rows += [(None, None), (None, "spelling spelling"), (5, ""), (6, "one twentyone,twentyone"), (6, "one twentyone,twentyone")]
    rows += [(7, "w" * 3000 + " " + "w" * 3000 + " " + "w" * 2999 + " " + "w" * 2999), (8, "abcdefg " * 20_000)]
    found = spelling.document_variants(documents(rows).selectExpr("*", "'own' as word", "'own' as n"))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = brute_variants(rows)
    assert rows_of(found) == expected
    assert any(form for _, form, *_ in expected)


def test_words_of_nothing(documents):
    assert spelling.document_variants(documents([])).collect() == []
    assert spelling.document_variants(documents([(1, None), (2, "short a b"), (3, "")])).collect() == []


# ---- embedding join ----


def brute_links(rows, cosine=0.95):
    good = []
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = np.array(v, float) / max(abs(x) for x in v)
            good.append((k, v / np.linalg.norm(v)))
    links = {k: [m for m, w in good if m != k and len(v) == len(w) and v @ w >= cosine] for k, v in good}
    result = []
    for k, (vec_id, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in links.get(todo.pop(), []):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        least = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
        result.append((vec_id, len(links.get(k, [])), least, vec_id == least))
    return sorted(result, key=repr)


def planted(seed, count, width, groups, hot):
    """Random directions, groups of near copies (one large), exact copies and scaled ones."""
    rng = np.random.default_rng(seed)
    rows = list(rng.normal(size=(count, width)))
    for g in range(groups):
        centre = rng.normal(size=width)
        rows += [centre + rng.normal(size=width) * rng.choice([0.1, 0.2, 0.25]) for _ in range(hot if g == 0 else 4)]
    rows += [rows[0], rows[0], rows[1] * 3]
    rng.shuffle(rows)
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize(("block", "width"), [(1024, 16), (7, 16), (16, 3)])
def test_join_against_brute_force(spark, block, width):
    """Small blocks make several rounds of splitting."""
    rows = planted(block, 500 if width > 3 else 200, width, 8, 60)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    assert rows_of(grid_join.near_vectors(df, block=block)) == brute_links(rows)


def test_join_skips_distant_blocks(spark):
    """Two far clusters: of the interval pairs between them none is left."""
    rng = np.random.default_rng(5)
    near = rng.normal(size=(320, 8)) * 0.05 + np.eye(8)[0]
    far = rng.normal(size=(320, 8)) * 0.05 - np.eye(8)[0]
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([near, far]))]
    vectors = spark.createDataFrame(rows, "k1 bigint, vector array<double>").selectExpr("k1", "k1 as k2", "vector", "1L as copies", "k1 as least")
    eps = math.sqrt(0.1)
    axes = grid_join.principal_axes(vectors)
    numbered, count = grid_join.number_rows(grid_join._placed(vectors, axes, eps), [*grid_join.CELLS, *grid_join.PLACES], "number")
    blocks = grid_join._blocks(numbered, 5).cache()
    pairs = {(r.a, r.b) for r in grid_join.interval_pairs(blocks, count // 5, eps).collect()}
    assert {(a, a) for a in range(16)} <= pairs and not any(a < 8 <= b for a, b in pairs)
    blocks.unpersist()


def test_join_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0])]
    rows += [(8, [1.0, 0.01]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]), (11, [1e300, 1e300]), (12, [1e-300, 1e-300]), (13, [-0.0, -1.0]), (14, [0.0, -5.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as n_links", "2 as component_id", "3 as number")
    assert rows_of(grid_join.linked_embeddings(df)) == brute_links(rows)
    assert grid_join.linked_embeddings(df.limit(0)).collect() == []


# ---- hot grams of the suffix operator ----


def brute_removed(rows):
    seen = collections.Counter(t.encode()[i : i + 200] for _, t in rows for i in range(len(t.encode()) - 199))
    result = {}
    for doc_id, t in rows:
        raw, gone = t.encode(), set()
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                gone.update(range(i, i + 200))
        result[doc_id] = bytes(c for i, c in enumerate(raw) if i not in gone)
    return result


def test_hot_grams_against_brute_force(spark, documents):
    """Copies of passages with an edit, and of shorter ones with the same or other surroundings, all dealt to parts of a few contexts."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcd ") for _ in range(420))
    rows = []
    for i in range(60):
        k = rng.randrange(len(passage))
        rows.append((i, passage[:k] + rng.choice("XYZ") + passage[k + 1 :]))
    for i in range(60, 140):
        sides = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 90))) for _ in range(2)]
        rows.append((i, sides[0] + passage[100 : 100 + rng.choice([150, 190, 199, 205])] + sides[1]))
    expected = brute_removed(rows)
    for part in (1, 7):
        found = suffix_dedup.without_repeats(documents(rows), part)
        assert {r.doc_id: bytes(r.kept) for r in found.collect()} == expected


def test_shared_sides_across_partitions(spark):
    rng = random.Random(2)
    sides = [(rng.randrange(2), i, bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12)))) for i in range(300)]
    df = spark.createDataFrame(sides, "g bigint, c bigint, side binary")
    found = {(r.g, r.c): r.shared for r in suffix_dedup._shared_by_any(df).collect()}
    for g, c, side in sides:
        others = [o for h, d, o in sides if h == g and d != c]
        assert found[g, c] == max(next((k for k, (x, y) in enumerate(zip(side, o)) if x != y), min(len(side), len(o))) for o in others)


def test_a_hot_gram_sends_few_rows(spark):
    """10,000 contexts of one gram that differ on both sides: no digest, nor more than a few rows for each."""
    rng = random.Random(4)
    gram = bytes(rng.randrange(97, 123) for _ in range(suffix_dedup.GRAM))
    rows = [(1, 0, 5, i, 1, 136, rng.randbytes(136) + gram + rng.randbytes(136), None, None) for i in range(10_000)]
    schema = "g bigint, part bigint, parts bigint, c bigint, times bigint, before bigint, context binary, low bigint, high bigint"
    cut = suffix_dedup._cut_down(spark.createDataFrame(rows, schema), 2048)
    assert suffix_dedup._decided(cut).count() == 0
    # With a common passage around the gram, windows that reach little beyond it are all that is left to tell apart.
    common = rng.randbytes(60), rng.randbytes(60)
    rows = [(*r[:6], rng.randbytes(76) + common[0] + gram + common[1] + rng.randbytes(76), None, None) for r in rows]
    cut = suffix_dedup._cut_down(spark.createDataFrame(rows, schema), 2048)
    assert suffix_dedup._decided(cut).count() < 10_000


# ---- brute force and odd rows


def plain_fingerprint(text):
    """Byte by byte: a chunk ends at the first byte, from the least size on, whose hash has enough zero bits."""
    gear = [int(x) for x in chunk_fingerprints.GEAR]
    raw, hashes, value = text.encode(), [], 0
    for byte in raw:
        value = ((value << 1) + gear[byte]) & 0xFFFFFFFF
        hashes.append(value)
    chunks, begin = set(), 0
    while begin < len(raw):
        end = min(begin + chunk_fingerprints.MOST, len(raw))
        for at in range(begin + chunk_fingerprints.LEAST, end):
            zeros = chunk_fingerprints.STRICT if at < begin + chunk_fingerprints.NORMAL else chunk_fingerprints.EASY
            if hashes[at - 1] >> (32 - zeros) == 0:
                end = at
                break
        chunk = raw[begin:end]
        chunks.add(f"{hashlib.blake2b(chunk, digest_size=8).hexdigest()}:{len(chunk)}")
        begin = end
    return " ".join(sorted(chunks))


def test_op10_equals_brute_force(documents):
    rng = random.Random(11)
    texts = [None, "", "x", "\u00e9" * 900, *("".join(rng.choices("abcdefg \n\u017e\U0001f600", k=rng.randrange(1, 3000))) for _ in range(30))]
    texts[9] = texts[10]
    found = {r.doc_id: r for r in chunk_fingerprints.document_fingerprints(documents(list(enumerate(texts)))).collect()}
    assert len(found) == len(texts)

    def likeness(one, other):
        one, other = ({(c, int(c.split(":")[1])) for c in x.split()} for x in (one, other))
        if not one or not other:
            return float(not one and not other)
        return sum(n for _, n in one & other) / min(sum(n for _, n in x) for x in (one, other))

    for i, text in enumerate(texts):
        text, following = text or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        mine, edited, after = map(plain_fingerprint, (text, changed, following))
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (mine, edited)
        assert (r.near_edited, r.near_next) == pytest.approx((likeness(mine, edited), likeness(mine, after)))


def test_bpe_of_odd_rows(clashing):
    """Every row comes back with its own text, the repeated ones too; columns named like results are replaced."""
    long = "word \u017elut\u00fd " * 30_000
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "a"), (None, None), (4, "\U0001f600 x\x00y"), (5, long)]
    ids = bpe.encode_texts(clashing(rows), *byte_vocabulary())
    decoded = bpe.decode_ids(ids, byte_vocabulary()[0])
    found = decoded.select("doc_id", "text", "decoded_text", "n_tokens", "score", "ids").collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=repr) == sorted(rows, key=repr)
    for r in found:
        assert r.decoded_text == (r.text or "") and r.score == "own" and len(r.ids) == 4 * r.n_tokens
        assert (r.n_tokens == 0) == (not r.text)
    assert bpe.document_tokens(clashing(rows).limit(0), *byte_vocabulary()).count() == 0


def test_pipeline_of_odd_rows(spark, clashing, tmp_path):
    """NULL, empty, repeated and equal rows, rows without ids, a column with a clashing name; clean documents stay whole."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(3000)]
    clean = [(i, " ".join(rng.choices(vocabulary, k=80))) for i in range(100, 160)]
    rows = [(1, None), (2, ""), (3, " \n"), (None, None), (None, " ".join(rng.choices(vocabulary, k=80))), *clean, clean[0], (99, clean[1][1])]
    clashing(rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.exact and r.score == "own" for r in found)
    kept = {(r.doc_id, r.text) for r in found}
    assert kept == {*clean[:1], *clean[2:], (99, clean[1][1]), rows[4]}
    empty = str(tmp_path / "empty")
    clashing(rows).limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
