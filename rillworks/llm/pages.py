"""Main text of web pages by tag-path ratios.

Every block of text belongs to the path of block tags from the root to it. Text length and punctuation are
summed per path and divided by the path's blocks; each block gets its path's ratios, smoothed over its
neighbours on the page. Both ratios are fused by multiplication, and paths whose fused value reaches a share
of the page's best are content. The element around most content is the article; what stands in it is kept,
but for blocks that are mostly links and for parts that are marked as something else: by their tag, as hidden, or
by words in class, id or role. Such words are hints: they don't count around an article element, and are
dropped one by one while they leave next to nothing of the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillworks.llm import shared

THRESHOLD = 0.1
LINKS = 0.5
_WEIGHTS = np.array([0.25, 0.5, 0.25])

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>|<[a-zA-Z/!?][^>]*\Z|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMED = ("class", "id", "role", "aria-label")
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，،।]")
#: HTML elements by kind.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in "script style noscript template textarea title iframe".split()}  # end at their own closing tag only
_MUTE = frozenset("svg math object canvas select button option audio video".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_OTHER = frozenset("nav header footer aside form menu dialog fieldset".split())
_CLOSED_BY_BLOCK = frozenset("p".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id or role names that mark what isn't the article.
_MARKS = frozenset("""ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar side aside footer foot masthead
 topbar breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register share sharing social
 related recommended recommendations comment comments disqus respond reply replies widget widgets toolbar pagination pager copyright complementary contentinfo search""".split())
_HEADS = frozenset(("header", "head", "page-header", "site-header"))


#: A name's mark is dropped if it leaves less than LEFT of the page's text and covers at least COVERED characters.
LEFT, COVERED = 0.1, 140


@dataclass
class _Element:
    tag: str
    path: str
    number: int
    mute: bool = False


@dataclass
class Block:
    """A run of text between block tags."""

    path: str
    text: str
    linked: int
    within: tuple[int, ...] = field(default=())


@dataclass
class _Marks:
    """Numbers of elements that tags or hidden properties exclude, and of those that only names do."""

    fixed: set[int] = field(default_factory=set)
    named: set[int] = field(default_factory=set)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed(list(_ATTRIBUTE.finditer(text)))}


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_INVISIBLE.search(attributes.get("style", "")))


def _named(attributes: dict[str, str], inside_article: bool) -> bool:
    for key in _NAMED:
        name = attributes.get(key, "").lower()
        if any(w in _HEADS for w in name.split()) and not inside_article or _MARKS.intersection(re.split(r"[^a-z]+", name)):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with decoded text and single spaces; markup, scripts and the like leave none."""
    return _parsed(page)[0]


def _parsed(page: str) -> tuple[list[Block], _Marks]:
    stack = [_Element("", "", 0)]
    found: list[Block] = []
    marks = _Marks()
    text: list[str] = []
    linked, number, links, at = 0, 0, 0, 0

    def close_block() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            found.append(Block(stack[-1].path, joined, linked, tuple(e.number for e in stack)))
        linked = 0

    def muted() -> bool:
        return stack[-1].mute

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        whole, tag = m[0], m[2]
        if tag is None:
            if (whole[0] != "<" or whole == "<") and not muted():
                plain = html.unescape(whole)
                text.append(plain)
                if links:
                    linked += len(plain.strip())
            continue
        tag = tag.lower()
        if not m[1]:
            closed = m[3].endswith("/")
            if tag in _RAW:
                end = None if closed else _RAW[tag].search(page, at)
                at = at if closed else end.start() if end else len(page)
                continue
            if tag in ("br", "hr", "wbr"):
                if tag == "hr" and not muted():
                    close_block()
                elif tag == "br":
                    text.append(" ")
                continue
            if tag in _VOID:
                continue
            if tag in _INLINE:
                links += tag == "a"
                continue
            mute = muted() or tag in _MUTE
            if mute and closed:
                continue
            if not mute:
                close_block()
                links = 0
            ends = _SAME.get(tag, frozenset()) | (frozenset() if mute else _CLOSED_BY_BLOCK)
            while len(stack) > 1 and stack[-1].tag in ends:
                stack.pop()
            number += 1
            top = stack[-1]
            attributes = _attributes(m[3]) if m[3] else {}
            inside = any(e.tag in ("article", "main") for e in stack)
            if _hidden(attributes) or tag in _OTHER and tag != "form" and not (tag == "header" and inside):
                marks.fixed.add(number)
            elif tag == "form" or tag not in ("html", "body", "article", "main") and _named(attributes, inside):
                marks.named.add(number)
            if tag in ("article", "main") and not mute:  # a name says nothing of what is around the article
                marks.named.difference_update(e.number for e in stack)
            stack.append(_Element(tag, f"{top.path}/{tag}", number, mute))
        elif tag in _INLINE:
            links = max(0, links - (tag == "a"))
        elif tag not in _VOID and tag not in _RAW:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if not stack[i].mute:
                        close_block()
                        links = 0
                    del stack[i:]
                    break
            else:
                if not muted():
                    close_block()
                    links = 0
    close_block()
    return found, marks


def _unmarked(found: list[Block], marks: _Marks) -> list[Block]:
    """Blocks outside marked elements. Names are hints: while they leave next to nothing, the one over most text is dropped."""
    visible = [b for b in found if not marks.fixed.intersection(b.within)]
    named, total = set(marks.named), sum(len(b.text) for b in visible)
    while True:
        kept = [b for b in visible if not named.intersection(b.within)]
        if sum(len(b.text) for b in kept) >= LEFT * total or not named:
            return kept
        covered: dict[int, int] = dict.fromkeys(sorted(named), 0)
        for b in visible:
            for n in named.intersection(b.within):
                covered[n] += len(b.text)
        most = max(covered, key=covered.get)
        if covered[most] < COVERED:
            return kept
        named.remove(most)


def _smooth(values: np.ndarray) -> np.ndarray:
    """Mean over a block and its neighbours; the page's ends stand for what is beyond them."""
    return np.convolve(np.pad(values, 1, mode="edge"), _WEIGHTS, mode="valid")


def ratios(found: list[Block]) -> np.ndarray:
    """Fused ratio of each block: its path's text per block times its path's punctuation per block, both smoothed."""
    number = {p: i for i, p in enumerate(dict.fromkeys(b.path for b in found))}
    of = np.array([number[b.path] for b in found])
    count = np.bincount(of)
    length = np.bincount(of, [len(b.text) for b in found]) / count
    marks = np.bincount(of, [len(_PUNCTUATION.findall(b.text)) for b in found]) / count
    return _smooth(length[of]) * (1 + _smooth(marks[of]))


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    """The article's blocks, joined by an empty line; empty if there is none."""
    found = [b for b in _unmarked(*_parsed(page or "")) if b.linked <= LINKS * len(b.text)]
    if not found:
        return ""
    fused = ratios(found)
    by_path: dict[str, float] = {}
    for b, f in zip(found, fused):
        by_path[b.path] = max(f, by_path.get(b.path, 0.0))
    best = max(by_path.values())
    content = [b for b in found if by_path[b.path] >= threshold * best]
    total = sum(len(b.text) for b in content)
    share: dict[int, int] = {}
    named: dict[int, bool] = {}
    for b in content:
        for e, tag in zip(b.within[:max(1, len(b.within) - 1)], b.path.split("/")):  # a block's own element is no container
            share[e] = share.get(e, 0) + len(b.text)
            named[e] = tag in ("article", "main")
    most = [e for e, n in share.items() if n >= 0.8 * total]
    article = max([e for e in most if named[e]] or most)  # the innermost one opened last
    return "\n\n".join(b.text for b in found if article in b.within)


def extract(pages: DataFrame, html_column: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of `pages` but the html, with text (its main text) and n_chars; columns of these names are replaced.

    NULL, empty and markup-only pages have an empty text. Whole pages are read; nothing is capped.
    """
    rest = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    rows = pages.select(*rest, F.col(html_column).alias(shared.fresh("_html", rest)))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([main_text(p, threshold) for p in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text], schema.names)

    return rows.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
