"""URL rules, indexed by their rarest literal token.

A rule is a pattern: `*` stands for anything, `^` for a separator or the end, a leading `||` for the start of
the host or of one of its labels, a leading or trailing `|` for an end of the target. The target of a
URL is its host in lower case and all that follows. Tokens are runs of `[0-9A-Za-z%]`. A
token of a pattern that has a literal separator or an anchor on both sides stands whole in every target that matches,
so each rule is filed under the one of these that the fewest URLs hold. The tokens of a URL fetch
its candidates, and only those run as regular expressions. Rules without such a token are
candidates of every URL.

Of the matching site rules (host and path) the longest decides; without one, a matching
pattern that allows wins over one that blocks; without any the default holds. A NULL URL, or one
without `://`, has an empty host, path and target and gets the default. Rows are judged each by itself, so ties,
repeated rows and an empty table need no care; columns named like the added ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import quoted, with_columns

TOKEN = "[0-9A-Za-z%]+"


@dataclass(frozen=True)
class Rule:
    pattern: str
    block: bool
    site: str | None = None  # of site rules: their name, host and path


def site_rule(site: str, block: bool) -> Rule:
    """A rule for a host, its subdomains and the paths that start with the given one."""
    return Rule("||" + site, block, site)


# Rules of the contract.
SITE_RULES = [
    site_rule("org/", False),
    site_rule("example.org/es/", True),
    site_rule("example.org/en/1", True),
    site_rule("com/fr/", False),
    site_rule("com/de/", True),
]

# Where no site rule fits: pages that hold no prose of their own, and files.
PATTERN_RULES = [
    *(
        Rule(p, True)
        for p in """/login^ /signup^ /register^ /logout^ /cart^ /checkout^ /wp-admin/ /wp-login.php /search?
        /print/ /tag/ /tags/ /ads/ /adserver/ ||ads. ||ad. ||tracker. ||doubleclick.net^ ^sessionid= ^phpsessid= ^replytocom=
        .zip| .exe| .iso| .dmg| .jpg| .jpeg| .png| .gif| .mp3| .mp4| .avi| .css| .js| ||casino. ||porn. ||xxx. /casino/ /porn/ /xxx/""".split()
    ),
    *(Rule(p, False) for p in "||docs. ||arxiv.org^ ||wikipedia.org/wiki/".split()),
]


def expression(pattern: str) -> str:
    """The regular expression of a pattern, to be searched in the target."""
    start, end, body = "", "", pattern
    if body.startswith("||"):
        start, body = r"^(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        start, body = "^", body[1:]
    if body.endswith("|"):
        end, body = "$", body[:-1]
    special = {"*": ".*", "^": r"(?:[^0-9A-Za-z_.%-]|$)"}
    return start + "".join(special.get(c) or re.escape(c) for c in body) + end


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that stand whole in every target that matches."""
    anchored_start, anchored_end = pattern.startswith("|"), pattern.endswith("|")
    body = pattern.strip("|")
    found = []
    for m in re.finditer(TOKEN, body):
        left, right = body[: m.start()][-1:], body[m.end() :][:1]
        if (left != "*" if left else anchored_start) and (right != "*" if right else anchored_end):
            found.append(m.group())
    return list(dict.fromkeys(found))


def url_parts(url: str) -> tuple[str, str, str]:
    """Host, path and target."""
    _, found, rest = url.partition("://")
    if not found:
        return "", "", ""
    host = re.match(r"[^/?#]*", rest).group()
    after = rest[len(host) :]
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lowered, re.match(r"[^?#]*", after).group(), lowered + after


def token_counts(df: DataFrame, tokens: Iterable[str], url: str = "url") -> dict[str, int]:
    """In how many URLs each of the given tokens occurs; no more numbers than the rules have tokens."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted({*tokens})] or [("",)], "token string")
    after = F.regexp_extract(F.col(quoted(url)), r"(?s)://(.*)", 1)
    held = df.select(F.explode(F.array_distinct(F.regexp_extract_all(after, F.lit(f"({TOKEN})")))).alias("token"))
    # The host counts in lower case, as the index sees it; so does the rest here, for the order only. The wanted tokens come from a list on the
    # driver and go to all tasks, as the rules do; other tokens leave before they are counted and shuffled.
    held = held.withColumn("token", F.lower("token")).join(F.broadcast(wanted), "token", "left_semi")
    return dict(held.groupBy("token").count().collect())


def index_rules(rules: list[Rule], counts: dict[str, int]) -> dict[str | None, list[int]]:
    """Rule numbers by rarest literal token; under None those without one."""
    index: dict[str | None, list[int]] = {}
    for i, rule in enumerate(rules):
        tokens = literal_tokens(rule.pattern)
        best = min(tokens, key=lambda t: (counts.get(t.lower(), 0), t), default=None)
        index.setdefault(best, []).append(i)
    return index


def matcher(rules: list[Rule], index: dict[str | None, list[int]]) -> Callable[[str], list[int]]:
    """A function from a target to the numbers of its rules, in the rules' order."""
    compiled = [re.compile(expression(r.pattern), re.DOTALL) for r in rules]
    tokens, everywhere = re.compile(TOKEN), index.get(None, [])

    def matches(target: str) -> list[int]:
        candidates = {*everywhere}
        for token in {*tokens.findall(target)}:
            candidates.update(index.get(token, ()))
        return [i for i in sorted(candidates) if compiled[i].search(target)]

    return matches


def judge_urls(df: DataFrame, rules: list[Rule], url: str = "url", block_by_default: bool = False) -> DataFrame:
    """``df`` with host, path, rule (the site rule that decides), pattern (else the pattern that does) and verdict."""
    index = index_rules(rules, token_counts(df, (t.lower() for r in rules for t in literal_tokens(r.pattern)), url))

    def compute() -> Callable[[list[str]], list]:
        matches = matcher(rules, index)

        def judge(text: str) -> tuple:
            host, path, target = url_parts(text)
            found = [rules[i] for i in matches(target)] if target else []
            site = max((r for r in found if r.site), key=lambda r: len(r.site), default=None)
            other = min((r for r in found if not r.site), key=lambda r: r.block, default=None)
            decides = site or other
            block = decides.block if decides else block_by_default
            return (
                host,
                path,
                site.site if site else None,
                other.pattern if other and not site else None,
                "block" if block else "allow",
            )

        return lambda urls: [pa.array(list(c), pa.string()) for c in zip(*map(judge, urls))]

    return with_columns(df, url, "host string, path string, rule string, pattern string, verdict string", compute)


def page_verdicts(pages: DataFrame) -> DataFrame:
    """The contract's columns over all pages."""
    judged = judge_urls(pages.select("page_id", "url"), SITE_RULES + PATTERN_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "pattern")
