"""The per-page helper on hand-made markup."""

import random
import time

import pyarrow.parquet as pq
import pytest

from newsloom.functions import html
from newsloom.functions.html import Page, article_fields, keywords, main_text, selectors

LABEL = "Klíčová slova"


def fields(markup):
    return dict(zip(["title", "content", "date", "keywords", "category"], article_fields(markup)))


def test_title_cascade_stops_at_existence():
    assert fields('<title>t</title><h1>a</h1><h1 itemprop="name headline"> b<i>c</i></h1>')["title"] == " bc"
    assert fields("<title>t</title><h1></h1>")["title"] == ""
    assert fields("<title>t</title>")["title"] == "t"
    assert fields("<p>x</p>")["title"] is None
    assert fields('<h1>a</h1><h1 itemprop="name">b</h1>')["title"] == "a"


def test_content_takes_longest_of_first_selector_with_a_match():
    markup = '<article>a very long text</article><div class="content">ab</div><div class="x content">abc</div>'
    assert fields(markup)["content"] == "abc"
    assert fields('<div class="content">one</div><div class="content">two</div>')["content"] == "one"
    assert fields('<div class="seven omega columns">x</div><article>longer</article>')["content"] == "x"
    assert fields('<article role="main">r</article><article>longer</article>')["content"] == "r"


def test_empty_match_falls_back_to_the_page():
    markup = '<title>T</title><nav>n</nav><div id="articlebody"> </div><p>rest</p><div class="note">kept</div>'
    assert fields(markup)["content"] == "T rest kept"


def test_boilerplate_inside_the_match_is_dropped_and_stays_dropped():
    markup = (
        '<div id="articlebody">a<script>s</script><aside>b <time>lost</time></aside>'
        '<p class="x note">c</p><header>h</header></div><time>kept</time>'
    )
    found = fields(markup)
    assert found["content"] == "a" and found["date"] == "kept"


def test_dates_outside_the_match_survive():
    markup = '<aside><p itemprop="datePublished"> d </p></aside><div id="articlebody">a</div><time>t</time>'
    assert fields(markup)["date"] == " d "
    assert fields('<article>a</article><i class="b date">x</i>')["date"] == "x"


def test_fallback_removes_boilerplate_before_date_and_category():
    markup = '<header><time>t</time><span itemprop="about">c</span></header><p>text</p>'
    assert fields(markup)["date"] is None and fields(markup)["category"] is None


def test_text_skips_comments_and_hidden_elements():
    markup = "<article>a<!-- c --><template>t</template><b>b</b><ruby>x<rt>y</rt></ruby><![CDATA[d]]></article>"
    assert fields(markup)["content"] == "a b x d"


def test_tag_soup():
    assert fields("<article><p>a<b>b<p>c</p>d</article>e")["content"] == "a b c d"
    assert fields("<article>a</div>b<br></br><br/>c</article>d")["content"] == "a b c"
    assert fields("<article><div/>a</article>b")["content"] == "a"
    assert fields("<article>a")["content"] == "a"
    assert fields("<article>a &amp; b&nbsp;&copy &#8211;&#x2014;&#150;&nosuch; &#xD800;</article>")["content"] == (
        "a & b\xa0© –—–&nosuch �"
    )


def test_unreadable_pages_have_no_fields():
    assert article_fields("<![foo[x]]>") == (None,) * 5
    assert article_fields(None) == (None, "", None, "", None)
    assert main_text("<![foo[x]]>") == (None,)


@pytest.mark.parametrize(
    "markup, expected",
    [
        (f"<p>{LABEL}: a, b </p>", ": a, b"),
        (f"<p><b><i>{LABEL} a</i></b></p>", "a"),
        (f"<p>{LABEL}</p><p>{LABEL} b</p>", ""),
        (f"<p>{LABEL} a<!-- c --></p>", "a"),
        (f"<p>{LABEL} <b>a</b> c</p>", "a c"),
        (f"<p><strong>{LABEL}</strong> a</p>", ""),
        (f'<p><strong>{LABEL}</strong> a</p><meta name="keywords" content=" m ">', "m"),
        (f"<div>x {LABEL} y</div><p>{LABEL} p</p>", "p"),
        (f"<div>x {LABEL} y</div>", "x  y"),
        ("<div>Tags t</div><div>Tagy y</div>", "y"),
        ("<div>Tags t</div><div>Keywords k</div>", "k"),
        ("<div>Keywords</div><div>Tags t</div>", ""),
        ("<div>keywords k</div>", ""),
        ("<script>Keywords</script><!-- Tags --><p>x</p>", ""),
        ('<meta name="keywords"><p>x</p>', ""),
        (f"<p><script>x</script>{LABEL} a</p>", "a"),
    ],
)
def test_keywords_cascade(markup, expected):
    assert keywords(Page(markup)) == expected


def test_removed_script_leaves_a_single_string():
    assert fields(f"<article><p><script>x</script>{LABEL} a</p></article>")["keywords"] == "a"


def test_nested_markup_takes_linear_time():
    deep = 40_000
    nested = '<div class="content">x' * deep
    assert len(fields(nested)["content"]) == 2 * deep - 1
    assert keywords(Page("<p>" * deep + f"{LABEL} a")) == "a"
    assert keywords(Page("<p>" * deep + "<b>x</b>y" + f"<p>{LABEL} a</p>")) == "a"
    many = '<div class="content"><script>s</script><i class="note">n</i>y</div>' * deep
    assert fields(many)["content"] == "y"


def test_category_is_the_first_marked_span():
    markup = '<article>a</article><div itemprop="about">x</div><span itemprop="about"> c<b>d</b></span>'
    assert fields(markup)["category"] == " cd"


def test_white_space_only_strings_shrink():
    assert fields("<time><b>1</b> \n  <b>2</b>   <b>3</b></time>")["date"] == "1\n2 3"
    assert fields("<time><pre><b>1</b>   <b>2</b></pre></time>")["date"] == "1   2"


def test_main_text_ignores_boilerplate_everywhere():
    assert main_text('<aside><div class="content">x</div></aside><main>m</main>') == ("m",)
    assert main_text("<title>t</title><nav>n</nav><p>p</p>") == ("t p",)
    assert main_text('<article>a</article><article><p class="note">bcd</p></article>') == ("bcd",)


def test_selectors():
    page = Page('<a class="x y" id="i">1</a><b class="x">2</b>')
    assert [len(page.select(s)) for s in selectors([".x", ".x.y", "b.x", "#i", '[id="i"]', "a#i.y"])] == [
        2, 1, 1, 1, 1, 1,
    ]


class General(Page):
    """Always read by the general parser."""

    def _read_plain(self, markup):
        return False


def tree(kind, markup):
    try:
        page = kind(markup)
    except AssertionError:
        return None
    return page.tags, page.data, page.ends, page.parents, page.with_attributes


PIECES = (
    "<p> </p> <B> </b> <br> <br/> </br> <script> </script> <style> </style> <title> </title> <pre> </pre> "
    "<textarea> <iframe> <template> </template> <!--c--> <!----> <!--a--b--> <!--> <!---> <!DOCTYPE-x> "
    "<![CDATA[x]]> &amp; &amp &nosuch; &#150; &#x41; &#xZ; & AT&T < <b > text é ' \" &#1 &a.b; <?php-x?>"
).split(" ") + [
    '<div class="a b" id="x">', "</div>", '<a href="?a=1&amp;b=2">', "</Script >", "< b", "<a b='c'>", "<a b>",
    '<a  b="c" />', '<h1 ITEMPROP="name headline">', " ", "\n", "& ",
]


def test_plain_reading_equals_the_general_parser():
    chosen = random.Random(5)
    for _ in range(20_000):
        markup = "".join(chosen.choices(PIECES, k=chosen.randrange(1, 9)))
        assert tree(Page, markup) == tree(General, markup), markup


def test_plain_reading_covers_the_given_pages():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    assert all(tree(Page, markup) == tree(General, markup) for markup in pages)
    assert sum(Page("")._read_plain(markup) for markup in pages) > 0.9 * len(pages)


OPENINGS = ["<a ", '<a b="', "<a b='x' c", "<a =", "<!--", "<!", "<?", "</", "</p ", "<![CDATA[", "<![if ", "&", "&#", "<script>", "<p>"]


@pytest.mark.parametrize("opening", OPENINGS)
def test_unterminated_constructs_take_linear_time(opening):
    def seconds(size):
        start = time.perf_counter()
        html.article_fields("<h1>t</h1>" + opening * (size // len(opening)))
        return time.perf_counter() - start

    # Eight times the page in far less than 64 times the time; and not slow at all.
    assert min(seconds(200_000) for _ in range(2)) < max(1.5, 24 * min(seconds(25_000) for _ in range(3)))


def test_a_page_that_cannot_be_read_has_no_fields():
    assert html.article_fields('<h1>x</h1><a href="&#' + "9" * 5000 + ';">') == (None,) * 5
    assert html.main_text('<a href="&#' + "9" * 5000 + ';">') == (None,)
