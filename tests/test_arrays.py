"""Records of JSON arrays found in byte ranges of any size."""

import json
import random

import pytest
from hypothesis import given, settings, strategies as st

from newsloom.sources.arrays import NOTHING, Transition, read_records, records, transition
from newsloom.sources.readers import read_article_arrays, read_articles

ODD = ["}", "{", "[]", '"', "\\", '\\"}', "a]}{[", "\\\\", "é}ü", "\n}", ""]


def machine(raw, inside=False, depth=0):
    """A JSON reader's state after some bytes, one by one."""
    escaped = False
    for c in raw:
        if inside:
            if escaped:
                escaped = False
            elif c == ord("\\"):
                escaped = True
            elif c == ord('"'):
                inside = False
        elif c == ord('"'):
            inside = True
        elif c in b"[{":
            depth += 1
        elif c in b"]}":
            depth -= 1
    return inside, depth


def corpus(seed, count):
    rng = random.Random(seed)
    odd = lambda: "".join(rng.choice(ODD) for _ in range(rng.randint(0, 4)))
    return [{"title": odd(), "id": i, "extra": {"deep": [{"x": odd()}, [odd()]]}, "content": odd() * 3} for i in range(count)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=6), st.integers(1, 9))
def test_transitions_compose(values, size):
    raw = json.dumps([{"a": v, "b": [{"c": v}]} for v in values]).encode()
    cuts = [i + 1 for i, c in enumerate(raw) if c == ord("}")][:: max(1, size - 3)]
    pieces = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]
    found = NOTHING
    for piece in pieces:
        found = found.then(transition(piece))
    assert found == transition(raw)
    assert machine(raw) == (found.flips, found.outside) == (False, 0)
    first = Transition(True, 2, -1)
    assert first.then(transition(raw)).then(first) == first.then(transition(raw).then(first))


@pytest.mark.parametrize("inside", [False, True])
def test_states_entered_inside_and_outside(inside):
    cases = [b'a"{}', b'\\\\"[', b'\\"{"', b"", b'"]}'] if inside else [b'"\\\\\\""]}', b'{"a', b"}]", b'"\\\\"{']
    for raw in cases:
        entered = machine(b'["' if inside else b"[")
        found = transition(raw)
        state = machine(raw, *entered)
        assert (entered[0] != found.flips, entered[1] + (found.inside if inside else found.outside)) == state
        assert records(raw, *entered)[1:] == state


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("size", "indent"), [(97, None), (150, 2), (1 << 20, None)])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits, size, indent):
    """Records cross splits, some over several; escapes, braces in strings and nested objects lie at their edges."""
    rows = corpus(size, 60)
    rows[7]["content"] = "}" * 700
    rows[8]["content"] = 'x"\\' * 300
    (tmp_path / "a.json").write_text(json.dumps(rows, ensure_ascii=False, indent=indent))
    (tmp_path / "b.json").write_text(json.dumps(rows[:3], indent=indent) + "\n")
    (tmp_path / "c.json").write_text(" [ ] ")
    (tmp_path / "d.json").write_text('[1, "}", [{"id": 5}, "]"], {"id": 99}, null]')
    small_splits(size)
    found = read_records(spark, str(tmp_path))
    if size < 1000:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = sorted((r.position.file[-6:], r.position.block, r.position.row, json.dumps(json.loads(r.value))) for r in found.collect())
    expected = [*map(json.dumps, rows), *map(json.dumps, rows[:3]), '{"id": 99}']
    assert [r[3] for r in got] == expected


def test_articles_equal_those_read_whole(spark, tmp_path, small_splits):
    rows = [{"title": t, "content": t * 2, "link": None, "id": i, "date": "d", "keywords": "k", "category": t} for i, t in enumerate(ODD * 4)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    small_splits(120)
    path = str(tmp_path)
    expected = sorted(map(tuple, read_articles(spark, path, "json").collect()), key=repr)
    assert sorted(map(tuple, read_article_arrays(spark, path).collect()), key=repr) == expected
    ordered = read_article_arrays(spark, path, "position").orderBy("position").collect()
    assert [r.id for r in ordered] == list(range(len(rows)))


@pytest.mark.parametrize("text", ['[{"id": 1}', '[{"id": 1}, {"id": 2', '[{"id": 1}, {"id": "}', '[{"id": 1', '[{"id": 1}]]'])
def test_broken_files(spark, tmp_path, small_splits, text):
    (tmp_path / "good.json").write_text('[{"id": 7}]')
    (tmp_path / "bad.json").write_text(text)
    small_splits(1 << 20)
    with pytest.raises(ValueError, match="bad.json"):
        read_article_arrays(spark, str(tmp_path))
    assert [r.id for r in read_article_arrays(spark, str(tmp_path), broken="skip").collect()] == [7]


def test_stretches_are_bounded_whatever_the_batches():
    """A batch of many pieces is looked at a stretch at a time, and a split's end is one."""
    import pyarrow as pa

    from newsloom.sources.arrays import STRETCH, _splits

    pieces = ['{"a": "' + "x" * 1000 + '"'] * 4000
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * 4000), pa.array([0] * 2500 + [9] * 1500), pa.array(pieces)], ["file", "block", "value"])
    found = list(_splits(iter([batch, batch.slice(2500)])))
    assert max(len(raw) for _, raw in found) < STRETCH + 2000
    assert b"".join(raw for key, raw in found if key == ("f", 9)) == b"".join(p.encode() + b"}" for p in pieces[2500:] * 2)
    assert [key for key, _ in found] == sorted(key for key, _ in found)


def test_marks_take_memory_by_what_they_find():
    """Positions of quotes, backslashes and brackets only: a long text costs a few bytes a byte."""
    import tracemalloc

    raw = b'[{"a": "' + b"x" * (8 << 20) + b'"}'
    tracemalloc.start()
    found = transition(raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found.flips, found.outside) == (False, 1) and peak < 4 * len(raw)
