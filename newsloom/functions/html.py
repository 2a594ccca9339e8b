"""Per-page helper of the extraction stage: tag soup in, raw fields out.

A page becomes flat lists in document order, each node knowing where its
subtree ends. Selecting is then a scan, reading text a slice, and removing a
subtree marks an interval. Cleaning is left to Column expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from html import entities, unescape
from html.parser import HTMLParser

# ---------------------------------------------------------------------------
# The markup that decides which text becomes which field.
# ---------------------------------------------------------------------------
TITLE_SELECTORS = ['h1[itemprop="name headline"]', "h1", "title"]
CONTENT_SELECTORS = [
    "#articlebody",
    '[itemprop="articleBody"]',
    ".omega.seven.columns",
    'article[role="main"]',
    ".article-content",
    ".content",
    "article",
    "#content",
]
MAIN_TEXT_SELECTORS = [
    "article",
    ".content",
    ".article-content",
    ".post-content",
    ".entry-content",
    ".press-release",
    ".news-content",
    "main",
    ".main-content",
    "#content",
    ".body",
]
PAGE_BOILERPLATE = ["script", "style", "nav", "header", "footer", "aside"]
CONTENT_BOILERPLATE = [*PAGE_BOILERPLATE, ".note"]
DATE_SELECTORS = ['p[itemprop="datePublished"]', "time", ".date"]
CATEGORY_SELECTORS = ['span[itemprop="about"]']
KEYWORDS_LABEL = "Klíčová slova"
KEYWORDS_LABELS = ["Keywords", "Klíčová slova", "Tagy", "Tags"]
KEYWORDS_META = ['meta[name="keywords"]']

# HTML elements without content, attributes that selectors without a tag look
# at, and elements whose strings are not page text.
VOID_TAGS = frozenset(
    [
        "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param",
        "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer",
    ]
)
SELECTABLE = frozenset(["id", "class", "itemprop"])
HIDDEN_TAGS = frozenset(["script", "style", "template", "rt", "rp"])
# Elements whose content the general parser has to read.
NEVER_PLAIN = frozenset(["textarea", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"])

TEXT, HIDDEN = "#text", "#hidden"


def _selector(source: str):
    """(tag, [(attribute, value)], [class]) of one compound selector."""
    tag, attributes, classes = None, [], []
    for kind, name, attribute, value in re.findall(r'([#.]?)([\w-]+)|\[(\w+)="([^"]*)"\]', source):
        if attribute:
            attributes.append((attribute, value))
        elif kind == "#":
            attributes.append(("id", name))
        elif kind == ".":
            classes.append(name)
        else:
            tag = name
    return tag, attributes, classes


def selectors(sources: list[str]):
    return [_selector(source) for source in sources]


# Constructs that need no error recovery. A page made of nothing else is read
# by this pattern, several times faster than by the general parser and with the
# same result; at the first other construct the general parser takes over.
PLAIN = re.compile(
    r"""(?P<text>[^<&]+)
    |<(?P<start>[a-z][a-z0-9]*)(?P<attributes>(?:[ \t\n\r\f]+[a-z][-a-z0-9]*="[^"]*")*)[ \t\n\r\f]*(?P<closed>/?)>
    |</(?P<end>[a-z][a-z0-9]*)>
    |&(?P<entity>[a-z][a-z0-9]*);
    |&\#(?P<char>[0-9]+|x[0-9a-f]+);
    |<!--(?!-?>)(?P<comment>[^-]*(?:-[^-]+)*)-->
    |<!(?P<doctype>doctype[^>]*)>
    |(?P<ampersand>&)(?=[^a-z#])""",
    re.IGNORECASE | re.VERBOSE,
).match
ATTRIBUTE = re.compile(r'([a-zA-Z][-a-zA-Z0-9]*)="([^"]*)"').findall
# What follows these start tags must be plain text up to their own end tag.
TEXT_ONLY = {"script": re.compile(r"</\s*script", re.I), "style": re.compile(r"</\s*style", re.I), "title": re.compile("<")}

# Ends of constructs. Where none is left in a page, what opens is text, and that is known without searching.
TAG_END, COMMENT_END, SECTION_END = re.compile(">"), re.compile(r"--\s*>"), re.compile(r"\]\s*>")
SECTIONS = frozenset(["temp", "cdata", "ignore", "include", "rcdata", "if", "else", "endif"])


class Page(HTMLParser):
    """One parsed page. Node 0 is the document itself."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=False)
        self._ends_of = None
        self._start()
        if not self._read_plain(markup):
            self._start()
            self.feed(markup)
            self.close()
        self._flush()
        for node in self._open:
            self.ends[node] = len(self.tags)
        self.gone = bytearray(len(self.tags))

    # -- building ------------------------------------------------------------

    def _start(self) -> None:
        self.tags, self.data, self.ends, self.parents = ["#document"], [{}], [0], [0]
        self.by_tag: dict[str, list[int]] = {}
        self.with_attributes: list[int] = []
        self._open, self._open_tags = [0], Counter()
        self._hidden_depth, self._pending = 0, []

    def _read_plain(self, markup: str) -> bool:
        position, size = 0, len(markup)
        while position < size:
            token = PLAIN(markup, position)
            if token is None:
                return False
            kind, position = token.lastgroup, token.end()
            if kind == "text" or kind == "ampersand":
                self._pending.append(token[0])
            elif kind == "end":
                self.handle_endtag(token["end"].lower())
            elif kind == "closed":
                tag = token["start"].lower()
                pairs = ATTRIBUTE(token["attributes"]) if token["attributes"] else ()
                attributes = [(name.lower(), unescape(value) if "&" in value else value) for name, value in pairs]
                self.handle_starttag(tag, attributes)
                if token["closed"]:
                    self.handle_endtag(tag)
                if tag in TEXT_ONLY:
                    end = TEXT_ONLY[tag].search(markup, position)
                    if end is None or token["closed"] or markup[end.start() : end.start() + len(tag) + 3].lower() != f"</{tag}>":
                        return False
                    if tag != "title" and position < end.start():
                        self._pending.append(markup[position : end.start()])
                        position = end.start()
                elif tag in NEVER_PLAIN:
                    return False
            elif kind == "entity":
                self.handle_entityref(token["entity"])
            elif kind == "char":
                self.handle_charref(token["char"])
            else:
                self.handle_comment(token[kind])
        return True

    def _endless(self, i: int, end: re.Pattern) -> bool:
        """Whether no such end comes after ``i``; the last one is looked up once."""
        if self._ends_of is not self.rawdata:
            self._ends_of, self._last_ends = self.rawdata, {}
        if end not in self._last_ends:
            last = -1
            for found in end.finditer(self.rawdata):
                last = found.start()
            self._last_ends[end] = last
        return i > self._last_ends[end]

    def parse_starttag(self, i):
        return -1 if self._endless(i, TAG_END) else super().parse_starttag(i)

    def parse_endtag(self, i):
        return -1 if self._endless(i, TAG_END) else super().parse_endtag(i)

    def parse_pi(self, i):
        return -1 if self._endless(i, TAG_END) else super().parse_pi(i)

    def parse_comment(self, i, report=1):
        return -1 if self._endless(i, COMMENT_END) else super().parse_comment(i, report)

    def parse_marked_section(self, i, report=1):
        if self._endless(i, SECTION_END):
            name, at = self._scan_name(i + 3, i)
            if at < 0 or name in SECTIONS:
                return -1
        return super().parse_marked_section(i, report)

    def updatepos(self, i, j):
        return j  # line numbers are of no use here

    def _add(self, tag: str, data) -> int:
        node = len(self.tags)
        self.tags.append(tag)
        self.data.append(data)
        self.ends.append(node + 1)
        self.parents.append(self._open[-1])
        return node

    def _flush(self, kind: str = TEXT) -> None:
        if not self._pending:
            return
        text = "".join(self._pending)
        self._pending.clear()
        if not text.strip(" \t\n\f\r") and not (self._open_tags["pre"] or self._open_tags["textarea"]):
            text = "\n" if "\n" in text else " "
        self._add(HIDDEN if self._hidden_depth else kind, text)

    def _special(self, text: str, kind: str = HIDDEN) -> None:
        self._flush()
        self._pending.append(text)
        self._flush(kind)

    def handle_starttag(self, tag, attrs):
        self._flush()
        attributes = {name: value or "" for name, value in attrs}
        node = self._add(tag, attributes)
        self.by_tag.setdefault(tag, []).append(node)
        if not SELECTABLE.isdisjoint(attributes):
            self.with_attributes.append(node)
        if tag not in VOID_TAGS:
            self._open.append(node)
            self._open_tags[tag] += 1
            self._hidden_depth += tag in HIDDEN_TAGS

    def handle_endtag(self, tag):
        self._flush()
        while self._open_tags[tag]:
            node = self._open.pop()
            closed = self.tags[node]
            self.ends[node] = len(self.tags)
            self._open_tags[closed] -= 1
            self._hidden_depth -= closed in HIDDEN_TAGS
            if closed == tag:
                break

    def handle_data(self, data):
        self._pending.append(data)

    def handle_entityref(self, name):
        self._pending.append(entities.html5.get(f"{name};", f"&{name}"))

    def handle_charref(self, name):
        try:
            code = int(name[1:], 16) if name[0] in "xX" else int(name)
            char = bytes([code]).decode("cp1252", "ignore") if code < 256 else ""
            char = char or chr(code)
        except (ValueError, OverflowError):
            char = "�"
        self._pending.append("�" if "\ud800" <= char <= "\udfff" else char)

    def handle_comment(self, data):
        self._special(data)

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        is_cdata = data.upper().startswith("CDATA[")
        self._special(data[6:] if is_cdata else data, TEXT if is_cdata else HIDDEN)

    # -- reading -------------------------------------------------------------

    def select(self, selector, within: int = 0) -> list[int]:
        """Remaining nodes below ``within`` that match, in document order."""
        tag, attributes, classes = selector
        nodes = self.by_tag.get(tag, []) if tag else self.with_attributes
        found = []
        for i in range(bisect_right(nodes, within), bisect_left(nodes, self.ends[within])):
            node = nodes[i]
            have = self.data[node]
            if (
                not self.gone[node]
                and all(have.get(name) == value for name, value in attributes)
                and (not classes or set(classes) <= set(have.get("class", "").split()))
            ):
                found.append(node)
        return found

    def first(self, options) -> int | None:
        """First node of the first selector that matches anything."""
        for selector in options:
            found = self.select(selector)
            if found:
                return found[0]
        return None

    def remove(self, options, within: int = 0) -> None:
        for selector in options:
            for node in self.select(selector, within):
                if not self.gone[node]:
                    self.gone[node : self.ends[node]] = b"\1" * (self.ends[node] - node)

    def strings(self, node: int):
        """Visible strings left below a node."""
        if not self.gone[node]:
            for i in range(node + 1, self.ends[node]):
                if self.tags[i] == TEXT and not self.gone[i]:
                    yield self.data[i]

    def raw_text(self, node: int) -> str:
        return "".join(self.strings(node))

    def spaced_text(self, node: int) -> str:
        return " ".join(filter(None, (text.strip() for text in self.strings(node))))

    def only_string(self, node: int) -> tuple[str, int]:
        """The string of a node that holds nothing but one (nested) string, and
        the last node looked at: all nodes down to it share the answer."""
        while not self.tags[node].startswith("#"):
            child, children = node + 1, []
            while child < self.ends[node] and len(children) < 2:
                if not self.gone[child]:
                    children.append(child)
                child = self.ends[child]
            if len(children) != 1:
                return "", node
            node = children[0]
        return (self.data[node] if self.tags[node] == TEXT else ""), node


_TITLE, _DATE, _CATEGORY = map(selectors, (TITLE_SELECTORS, DATE_SELECTORS, CATEGORY_SELECTORS))
_CONTENT, _MAIN_TEXT = selectors(CONTENT_SELECTORS), selectors(MAIN_TEXT_SELECTORS)
_CONTENT_NOISE, _PAGE_NOISE = selectors(CONTENT_BOILERPLATE), selectors(PAGE_BOILERPLATE)
_META, _PARAGRAPH = selectors(KEYWORDS_META), _selector("p")


def _longest(page: Page, options, noise) -> str:
    """Longest text among the matches of the first selector that has any."""
    matches = next(filter(None, map(page.select, options)), [])
    best, reach = "", 0
    for node in matches:
        if node >= reach:  # a match inside an earlier one has no longer text
            reach = page.ends[node]
            page.remove(noise, within=node)
            best = max(best, page.spaced_text(node), key=len)
    return best


def _labelled(page: Page, label: str) -> str | None:
    """Text of the element around the first string with the label, without it."""
    for node, tag in enumerate(page.tags):
        if tag == TEXT and not page.gone[node] and label in page.data[node]:
            return page.raw_text(page.parents[node]).replace(label, "").strip()
    return None


def keywords(page: Page) -> str:
    """Keywords by the first method with a non-empty result."""
    last = 0
    for node in page.select(_PARAGRAPH):
        text, last = page.only_string(node) if node > last else ("", last)
        if KEYWORDS_LABEL in text:
            found = text.replace(KEYWORDS_LABEL, "").strip()
            if found:
                return found
            break
    found = _labelled(page, KEYWORDS_LABEL)
    if found:
        return found
    labelled = (_labelled(page, label) for label in KEYWORDS_LABELS)
    found = next((text for text in labelled if text is not None), "")
    if found:
        return found
    meta = page.first(_META)
    return "" if meta is None else page.data[meta].get("content", "").strip()


def _page(markup: str | None) -> Page | None:
    """The parsed page; None if it cannot be read, whatever the reason: a bad page must not end the job."""
    try:
        return Page(markup or "")
    except Exception:  # noqa: BLE001
        return None


def article_fields(markup: str | None) -> tuple:
    """(title, content, date, keywords, category), raw; None where absent.

    Boilerplate is removed for the content before the later fields are read,
    which therefore do not see it.
    """
    page = _page(markup)
    if page is None:
        return (None,) * 5

    def text_of(options):
        node = page.first(options)
        return None if node is None else page.raw_text(node)

    title = text_of(_TITLE)
    content = _longest(page, _CONTENT, _CONTENT_NOISE)
    if not content:
        page.remove(_PAGE_NOISE)
        content = page.spaced_text(0)
    return title, content, text_of(_DATE), keywords(page), text_of(_CATEGORY)


def main_text(markup: str | None) -> tuple:
    """(body text,) by the site-neutral selectors."""
    page = _page(markup)
    if page is None:
        return (None,)
    page.remove(_PAGE_NOISE)
    return (_longest(page, _MAIN_TEXT, ()) or page.spaced_text(0),)
