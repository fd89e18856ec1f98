"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides a block by itself: boilerplate if it lies in a
menu, header, footer, sidebar, notice, advert, form or comment element, or is mostly links; main text if it is long
and rich in stop words (or lies in the page's article element and is no list of links); else it stays open. In the
second pass open blocks, short ones above all, take the label of the nearest decided neighbour (main text if two are
equally near and differ, or if there is none). An element that names itself boilerplate lends its label to nothing.
Names of the page itself, of its article and of elements around an article or main element say nothing of the text;
inside the article only a whole class name does, and headings are never boilerplate by name. A form that has most of a
page's paragraphs, in a page without an article, is taken for the page.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.shared import blocks as arrow_blocks

#: Characters: a shorter block is never decided by its words alone; a longer one with few stop words is boilerplate.
SHORT, LONG = 70, 200
LINKS = 0.5
STOPS = 0.25
#: Below this share of stop words in the whole page its language is taken as unknown, and words do not decide.
UNKNOWN_LANGUAGE = 0.05

# Frequent words of a few languages.
STOP_WORDS = frozenset("""
the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you
le la les de des du et un une est en que qui dans pour pas sur au aux ce il ne se par plus son avec sont
der die das und ist in den von zu mit sich auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach
el los las y en que del se por con no una su para es al lo como más pero sus le ya o este sí
di che e il per non sono con del della gli una si dei da alla nel
""".split())
_SKIPPED = {"script", "style", "noscript", "template", "iframe", "svg", "object", "canvas", "audio", "video", "title", "head"}
_RAW = {"script", "style", "title", "textarea", "iframe", "noscript"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
          "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
          "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table",
          "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "button", "textarea", "label"}
_BOILERPLATE = {"nav", "footer", "aside", "form", "button", "select", "textarea", "dialog", "menu", "label", "fieldset"}
#: Closed by a sibling, up to the nearest of the second set.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
             "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
             "option": ({"option"}, {"select"})}
_NAMES = frozenset("""
ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion cookie cookies
consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription nav navbar navigation menu menus
breadcrumb breadcrumbs footer sidebar widget widgets related recommended recommendations share sharing social
comment comments commentlist disqus respond reply replies login signup signin search toolbar pagination pager skip
copyright outbrain taboola paywall disclaimer
""".split())
#: Elements that are never boilerplate by name.
_PAGE = {"html", "body", "main"}
#: A class that begins so tells what is beside the element.
_BESIDE = {"has", "with", "without", "no"}
#: What can stand in a head; any other element ends it.
_IN_HEAD = {"head", "title", "meta", "link", "base", "style", "script", "noscript", "template"}
#: Elements that can stand around the article of a page.
_HOLDING = {"div", "section", "form", "center", "td", "fieldset"}
_OUTER_NAMES = frozenset({"header", "masthead", "topbar", "hero"})
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMING = ("class", "id", "role", "aria-label", "itemprop")
#: Words beside a name of the list that leave its meaning as it is (share-buttons, comments-area).
_GENERIC = frozenset("""
area bar block body bottom box button buttons container content form group icons inner items left link links list main
outer post posts article articles primary right row secondary section slot text thread title top unit wrap wrapper
""".split())
_COMMENTS = frozenset({"comment", "comments", "commentlist", "disqus", "respond"})
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_FORM = re.compile(r"<(/?)form(?=[\s/>])", re.I)
_PARAGRAPH = re.compile(r"<p(?=[\s>])", re.I)
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in _RAW}
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    boilerplate: bool
    main: bool


@dataclass
class _Page:
    """The open elements and the block being read."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[tuple[str, bool, bool, bool]] = field(default_factory=list)  # tag, boilerplate, main, skipped (with those around it)
    open: Counter = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, boilerplate, main, _ = self.stack[-1] if self.stack else ("", False, False, False)
            self.blocks.append(Block(text, self.linked, boilerplate, main))
        self.parts, self.linked = [], 0

    def pop_to(self, tag: str) -> None:
        while self.stack:
            name = self.stack.pop()[0]
            self.open[name] -= 1
            if name == tag:
                return


def _page_forms(page: str) -> set[int]:
    """Where a form begins that has most of the page's paragraphs, and three at least."""
    out, begin, every = set(), None, None
    for match in _FORM.finditer(page):
        if match[1] and begin is not None:
            every = every or [m.start() for m in _PARAGRAPH.finditer(page)]
            inside = bisect.bisect(every, match.start()) - bisect.bisect(every, begin)
            if inside >= 3 and 2 * inside > len(every):
                out.add(begin)
            begin = None
        elif not match[1] and begin is None:
            begin = match.start()
    return out


def _holders(page: str) -> set[int]:
    """Where the start tags stand of the first main element, its first article (of the page's, without a main element)
    and the elements around them."""
    seen: dict[str, set[int]] = {}
    inside = False  # the article held is in a main element
    stack: list[tuple[str, int]] = []
    open_: Counter = Counter()
    if not re.search(r"<(?:article|main)[\s/>]", page, re.I):
        return _page_forms(page)
    at = 0
    while match := _TOKEN.search(page, at):
        at = match.end()
        tag = (match[2] or match[5] or "").lower()
        if match[1] or match[4]:
            if open_[tag] > 0:
                while True:
                    name, _ = stack.pop()
                    open_[name] -= 1
                    if name == tag:
                        break
        elif tag in _RAW:
            end = _ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag in ("article", "main"):
            if tag not in seen or (tag == "article" and open_["main"] > 0 and not inside):
                inside = open_["main"] > 0
                seen[tag] = {start for _, start in stack} | {match.start()}
            stack.append((tag, match.start()))
            open_[tag] += 1
        elif tag in _HOLDING:
            stack.append((tag, match.start()))
            open_[tag] += 1
    if "main" in seen and not inside:
        seen.pop("article", None)
    return set().union(*seen.values())


def _whole_name(token: str) -> bool:
    """Does a class name as a whole say boilerplate: a name of the list, alone or with words that add nothing."""
    parts = [p.lower() for p in _PARTS.findall(token)]
    return bool(parts) and parts[0] in _NAMES and all(p in _NAMES or p in _GENERIC for p in parts[1:])


def _marks(tag: str, raw: str, main: bool, holder: bool = False) -> tuple[bool, bool]:
    """Is the element boilerplate; does it hold the main text. Of a ``holder`` (an element around the article or main
    element) the name says nothing. ``main``: the element is or lies in an article or main element. There only whole
    names count, and an id only if it tells of comments; headings are never boilerplate by their name."""
    attributes: dict[str, str] = {}
    for match in _ATTRIBUTE.finditer(raw):
        attributes.setdefault(match[1].lower(), match[2] or match[3] or match[4] or "")
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(_NONE.search(attributes.get("style", "")))
    tokens = {name: attributes[name].split() for name in _NAMING if name in attributes}
    names = set()
    for word in itertools.chain.from_iterable(tokens.values()):
        parts = [p.lower() for p in _PARTS.findall(word)]
        if not (len(parts) > 1 and parts[0] in _BESIDE):
            names.update(parts)
    is_main = tag in ("article", "main") or ("article" in names and "body" in names)
    if tag in _PAGE or holder:
        return hidden, is_main
    if tag in _HEADINGS:
        named = False
    elif main:
        named = (any(_whole_name(t) for name in ("class", "role", "itemprop") for t in tokens.get(name, ()))
                 or _whole_name(attributes.get("aria-label", ""))
                 or any(_whole_name(t) and not _COMMENTS.isdisjoint(p.lower() for p in _PARTS.findall(t)) for t in tokens.get("id", ())))
    else:
        named = bool(names & _NAMES) or tag == "header" or bool(names & _OUTER_NAMES)
    return tag in _BOILERPLATE or named or hidden, is_main


def page_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without scripts, styles and markup."""
    state, at, size = _Page(), 0, len(page)
    holders = _holders(page)
    while at < size:
        match = _TOKEN.search(page, at)
        stop = match.start() if match else size
        if stop > at and not (state.stack and state.stack[-1][3]):
            text = html.unescape(page[at:stop])
            state.parts.append(text)
            if state.open["a"] > 0:
                state.linked += len("".join(text.split()))
        if not match:
            break
        at = match.end()
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            continue
        closing, attributes = match[1] or match[4], match[3] or match[6] or ""
        if closing:
            if tag in _BLOCK:
                state.flush()
            if state.open[tag] > 0:
                state.pop_to(tag)
            continue
        if tag == "br":
            state.parts.append(" ")
        if tag in _BLOCK:
            state.flush()
            if state.open["p"] > 0:
                state.pop_to("p")
        if tag not in _IN_HEAD and state.open["head"] > 0:
            state.pop_to("head")
        if tag in _VOID or tag == "html":
            continue
        if tag in _SIBLINGS and state.open[tag] + sum(state.open[x] for x in _SIBLINGS[tag][0]) > 0:
            same, around = _SIBLINGS[tag]
            nearest = next((x[0] for x in reversed(state.stack) if x[0] in same or x[0] in around), None)
            if nearest in same:
                state.pop_to(nearest)
        if tag == "a" and state.open["a"] > 0:
            state.pop_to("a")
        _, boilerplate, main, skipped = state.stack[-1] if state.stack else ("", False, False, False)
        bad, is_main = _marks(tag, attributes, main or tag in ("article", "main"), match.start() in holders)
        if attributes.endswith("/") and tag in ("svg", "math"):
            continue
        if tag in _RAW:
            end = _ENDS[tag].search(page, at)
            at = end.end() if end else size
            continue
        state.stack.append((tag, boilerplate or bad, main or is_main, skipped or tag in _SKIPPED))
        state.open[tag] += 1
    state.flush()
    return state.blocks


def classify(found: list[Block]) -> list[bool]:
    """For each block of a page whether it is main text."""
    words = [_WORD.findall(b.text.lower()) for b in found]
    stops = [sum(w in STOP_WORDS for w in ws) for ws in words]
    known = sum(stops) >= UNKNOWN_LANGUAGE * max(1, sum(map(len, words)))
    stated = any(b.main and not b.boilerplate for b in found)
    labels: list[bool | None] = []
    for block, ws, n in zip(found, words, stops):
        size = len(block.text)
        rich = not known or n >= STOPS * max(1, len(ws))
        if block.boilerplate or (stated and not block.main) or block.linked > LINKS * len(block.text.replace(" ", "")):
            labels.append(False)
        elif block.main and size >= SHORT:
            labels.append(True)
        elif size < SHORT or not ws:
            labels.append(None)
        elif rich and size >= LONG:
            labels.append(True)
        elif size >= LONG:
            labels.append(False)
        else:
            labels.append(True if rich else None)
    # an element that says what it is says nothing of the blocks around it, and the article nothing of those outside
    lends = [x is not None and not y.boilerplate and (y.main or not stated) for x, y in zip(labels, found)]
    left = list(itertools.accumulate((k if ok else -1 for k, ok in enumerate(lends)), max))
    right = list(itertools.accumulate((k if ok else len(found) for k, ok in reversed(list(enumerate(lends)))), min))[::-1]
    out = []
    for k, label in enumerate(labels):
        if label is None:
            near = [at for at in (right[k], left[k]) if 0 <= at < len(found)]
            label = labels[min(near, key=lambda at: (abs(at - k), not labels[at]))] if near else True
        out.append(bool(label))
    return out


def main_text(page: str | None) -> str:
    found = page_blocks(page or "")
    return "\n\n".join(b.text for b, good in zip(found, classify(found)) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of ``pages`` (page_id, url, html).

    Null and empty html, and pages without main text, give an empty text; repeated rows each give a row; other
    columns are not read. Nothing is shuffled.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in arrow_blocks(batches, "html"):
            texts = [main_text(x) for x in block.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [block.column("page_id"), block.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(each, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
