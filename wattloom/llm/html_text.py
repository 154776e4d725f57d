"""Main text of web pages: two-pass rules over blocks."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, ship

# Frequent function words of four languages
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are with as be at by this from or an have not but his her they which "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "le la les de des et en un une du que qui dans pour par sur est il elle ne pas plus se au avec ce son sa "
    "el los las y del que en un una por con no su para es se lo al más como o pero sus este".split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th "
    "thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OTHER_PARTS = frozenset("nav footer aside form head menu select button dialog fieldset title option".split())
OTHER_NAMES = frozenset(
    "ad ads advert advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup "
    "modal overlay newsletter subscribe signup sidebar widget related recommended share sharing social breadcrumb breadcrumbs pagination "
    "menu nav navbar navigation footer masthead toolbar comment comments disqus reply replies respond login search skip".split()
)
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN_PARTS = frozenset(("article", "main"))
SHORT, LONG, LINKS = 70, 200, 0.33
FEW_STOPS, MANY_STOPS = 0.2, 0.3

_QUOTED = r"""(?:"[^"]*"|'[^']*'|[^'">])*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(script|style|noscript|template|svg|iframe|object|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-z][^\s/>]*)({_QUOTED}|[^>]*)>|<[!?][^>]*>|<(?:/?[a-z])[^<]*\Z",
    re.I | re.S,
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    in_links: int  # characters inside links
    other: bool  # inside a part of the page that is never the article
    home: int  # number of the article element around it, 0: none
    heading: bool
    label: str = ""


def _is_other(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in OTHER_PARTS or (tag == "header" and not in_main):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id") and not OTHER_NAMES.isdisjoint(re.split(r"[^a-z]+", value)):
            return True
        if (name == "role" and value in OTHER_ROLES) or (name == "aria-hidden" and value == "true"):
            return True
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order; scripts, styles, comments and markup are gone."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # tag, other, article number
    parts: list[str] = []
    linked, links, homes = 0, 0, 0
    heading = False

    def close() -> None:
        nonlocal linked, parts
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, other, home = stack[-1] if stack else ("", False, 0)
                out.append(Block(text, min(linked, len(text)), other, home, heading))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(" ".join(text.split()))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag, end = m[3].lower(), bool(m[2])
        if tag == "a":
            links = max(0, links - 1) if end else 1
        if tag == "br":
            parts.append(" ")
        if tag in VOID_TAGS and tag != "hr":
            continue
        block = tag in BLOCK_TAGS
        _, other, home = stack[-1] if stack else ("", False, 0)
        if end:
            if any(t == tag for t, _, _ in stack):
                if block:
                    close()
                while stack.pop()[0] != tag:
                    pass
        elif not m[4].rstrip().endswith("/") and tag != "hr":
            named = block or tag == "span" or tag == "button"
            new_other = other or (named and _is_other(tag, m[4], home > 0))
            if block or new_other != other:
                close()
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            if tag in ("li", "dd", "dt", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                stack.pop()
            if tag in MAIN_PARTS and not home:
                homes += 1
                home = homes
            if block or new_other != other:
                stack.append((tag, new_other, home))
        elif block:
            close()
        if block:
            links = 0 if tag != "li" else links
            heading = not end and tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    if at < len(page):
        add(page[at:])
    close()
    return out


def first_pass(b: Block) -> str:
    """good, bad, or for blocks that their own text doesn't decide: near (probably good), short."""
    if b.other or b.in_links > LINKS * len(b.text) or b.text.startswith(("©", "(c) ", "Copyright")):
        return "bad"
    if len(b.text) < SHORT:
        return "short"
    if b.home:
        return "good"
    words = _WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= MANY_STOPS:
        return "good" if len(b.text) > LONG else "near"
    return "near" if stops >= FEW_STOPS else "bad"


def second_pass(found: list[Block]) -> None:
    """Undecided blocks take the label of the nearest decided block of the same part of the page.

    Equally near and different: `near` and headings become good, `short` bad. With no decided
    block in its part, a block is good inside an article and, outside, if it is `near`."""
    for home in {b.home for b in found}:
        part = [b for b in found if b.home == home and not (home and b.label == "bad")]
        before: list[tuple[int, str]] = []
        last = (-1, "")
        for i, b in enumerate(part):
            if b.label in ("good", "bad"):
                last = (i, b.label)
            before.append(last)
        following = (-1, "")
        for i in range(len(part) - 1, -1, -1):
            b = part[i]
            if b.label in ("good", "bad"):
                following = (i, b.label)
                continue
            sides = [(i - before[i][0], before[i][1])] * (before[i][0] >= 0) + [(following[0] - i, following[1])] * (following[0] >= 0)
            if not sides:
                b.label = "good"
                continue
            least = min(d for d, _ in sides)
            labels = {x for d, x in sides if d == least}
            if len(labels) == 1:
                b.label = "good" if b.label == "near" and "good" in {x for _, x in sides} else labels.pop()
            else:
                b.label = "good" if b.label == "near" or b.heading else "bad"


def main_text(page: str | None) -> str:
    """The article's blocks joined by one space; NULL and empty pages give ''."""
    if not page:
        return ""
    found = blocks(page)
    for b in found:
        b.label = first_pass(b)
    second_pass(found)
    return " ".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """`pages` without the html and with its main text in `out` and its code points in n_chars.

    Works on whole pages, cut or unclosed ones too; every row gives one row. Input columns named
    like the outputs are replaced. No shuffle.
    """
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(s: pd.Series) -> pd.Series:
        return pd.Series([main_text(t if isinstance(t, str) else None) for t in s], dtype=object)

    kept = [F.col(f"`{c}`") for c in pages.columns if c not in (page, out, "n_chars")]
    done = pages.select(*kept, text_of(F.col(page)).alias(out))
    return done.withColumn("n_chars", F.length(out).cast("long"))


def op5_html(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
