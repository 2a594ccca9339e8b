"""Cleaning expressions against fixed examples and the standard library."""

import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from newsloom.functions import text


def cleaned(spark, values, min_chars=0):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").repartition(4)
    return [row.x for row in text.clean_text(rows, {"x": min_chars}).orderBy("i").collect()]


def applied(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [row.x for row in rows.select("i", expression(F.col("x")).alias("x")).orderBy("i").collect()]


def test_clean_text_examples(spark):
    examples = {
        "x<![CDATA[ab]]>y": "xaby",
        "x<![CDATA[a\nb]]>y": "xy",
        "<![CDATA[a<b>c]]>": "ac",
        "x<![CDATA[a\rb]]>y": "xa by",
        "a <b>b</b>c": "a bc",
        "  a\t\n b\n": "a b",
        "1 < 2 and 3 > 2": "1 2",
        "a<>b": "a<>b",
        "a<b>c<d": "ac<d",
        "<<<a<b": "<<<a<b",
        "<![CDATA[a<![CDATA[b": "<![CDATA[a<![CDATA[b",
        "": "",
    }
    assert cleaned(spark, list(examples)) == list(examples.values())


def test_clean_text_length_is_in_code_points(spark):
    assert cleaned(spark, ["x" * 49, "x" * 50, "😀" * 49, "😀" * 50, None], 50) == [
        "", "x" * 50, "", "😀" * 50, "",
    ]


def test_unterminated_markup_is_linear(spark):
    many = ["<" * 300_000, "a>" + "<x" * 200_000, "<![CDATA[" * 60_000, " " * 400_000 + "x"]
    result = cleaned(spark, many)
    assert result[0] == many[0] and result[2] == many[2] and result[3] == "x"
    assert result[1] == many[1]


def expected_clean(value):
    """A reader that walks along the characters, twice."""
    opened, shut, unwrapped, at = "<![CDATA[", "]]>", [], 0
    while at < len(value):
        inner = at + len(opened)
        close = value.find(shut, inner) if value.startswith(opened, at) else -1
        if close >= 0 and "\n" not in value[inner:close]:
            unwrapped.append(value[inner:close])
            at = close + len(shut)
        else:
            unwrapped.append(value[at])
            at += 1
    plain, rest = [], "".join(unwrapped)
    while rest:
        if rest[0] == "<" and rest[1:2] != ">" and ">" in rest:
            rest = rest[rest.index(">") + 1 :]
        else:
            plain.append(rest[0])
            rest = rest[1:]
    return " ".join("".join(plain).split())


PIECES = ["<", ">", "<b>", "</b>", "<![CDATA[", "]]>", "]", "\n", "\r", " ", " ", "\x85", "\x1c", "a", "é", "-", "–"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=15).map("".join), min_size=200, max_size=200))
def test_clean_text_equals_python(spark, values):
    assert cleaned(spark, values) == [expected_clean(value) for value in values]


def test_white_space_equals_python(spark):
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    values = [f"{c}a{c}{c}b{c}" for c in chars]
    assert applied(spark, values, text.collapse) == [re.sub(r"\s+", " ", v.strip()) for v in values]
    assert applied(spark, values, text.strip) == [v.strip() for v in values]


def test_keywords(spark):
    examples = {
        ": a-b": ": a-b",
        "– a-b —": "a-b",
        "  -- ab": None,
        "a - b -": "a - b",
        "a\n\n b": "a b",
        "": None,
        "-" * 200_000 + "abc": "abc",
        "x" + "-" * 100_000 + "y": "x" + "-" * 100_000 + "y",
    }
    assert applied(spark, list(examples), text.normalize_keywords) == list(examples.values())


def test_article_id(spark):
    examples = {
        "https://h.cz/z.php?id=53986": 53986,
        "https://h.cz/z.php?pid=7": 7,
        "https://other/z.php?id=1": None,
        "https://h.cz/z.php?id=": None,
        "https://h.cz/z.php?id=99999999999999999999": None,
        "": None,
        None: None,
    }
    assert applied(spark, list(examples), lambda c: text.article_id(c, "h.cz")) == list(examples.values())


def test_previews_and_shares(spark):
    assert applied(spark, ["t" * 60, "short"], text.title_preview) == ["t" * 50 + "...", "short..."]
    assert applied(spark, ["k" * 40, "", None], text.keywords_preview) == ["k" * 30 + "...", None, None]
    values = [0.05, 0.25, 12.5, 33.35, 100.0, 66.66666]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    shown = rows.orderBy("i").select(text.display_share(F.col("v")).alias("s")).collect()
    assert [row.s for row in shown] == [f"{v:.1f}" for v in values]
