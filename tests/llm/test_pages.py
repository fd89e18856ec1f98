"""HTML extraction and the pipeline."""

import html
import re

import pytest

import corpus_pipeline
from siftline.llm import decontam, html_blocks, simhash

from .conftest import SF
from .test_copies import brute_components, brute_removal

PROSE = "The cat of the house and a dog is in it with all of the others that came. "


def test_pages_against_their_article(spark):
    """The main text of the given pages is their article, block by block."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = html_blocks.op10_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]]["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1|h2|ul|li|div|table|tr|td)\b[^>]*>", inner.replace("<br>", " "))
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<b>b</b> c<br>d<script>x<p></script>e<!-- <p> -->f", "ab c def"),
    ("<article><p>a &amp;lt; b&nbsp;&#233;</p><p>  x \n y </p></article>", "a &lt; b é\n\nx y"),
    (f"<nav><p>{PROSE * 4}</p></nav><main><p>{PROSE}</p></main><footer>{PROSE * 4}</footer>", PROSE.strip()),
    (f"<div class='cookie-notice'>{PROSE * 4}</div><div><h2>Title</h2><p>{PROSE * 4}</p></div><div id=comments><p>{PROSE * 4}</p></div>", "Title\n\n" + (PROSE * 4).strip()),
    (f"<p>{PROSE * 4}</p><ul><li><a href=x>One of the links</a></li><li><a href=y>And of the others</a></li></ul>", (PROSE * 4).strip()),
    (f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{PROSE}</p><aside>{PROSE}</aside><form>Name <input></form></article>", f"Title\n\n{PROSE.strip()}"),
    (f"<article><p>{PROSE}<p class=ad>{PROSE}<p>Last one.</article>", f"{PROSE.strip()}\n\nLast one."),
    (f"<article><p title='a > b'>{PROSE}</p><style>p > a {{}}</style><p hidden>{PROSE}</p></article>", PROSE.strip()),
    (f"<article><p>{PROSE}</p><script>never ended <p>text", PROSE.strip()),
    ("<p>short one</p><div class=share>Share</div>", "short one"),
])
def test_cases(page, text):
    assert html_blocks.main_text(page) == text


@pytest.mark.parametrize("before,after", [
    ("<body class='has-sidebar'><article>", "</article>"), ("<div id='page' class='with-sidebar'><article>", "</article></div>"),
    ("<article class='post comments-open'>", "</article>"), ("<div class=with-sidebar>", "</div>"), ("<main class='no-nav'>", "</main>"), ("<body class='cookie-banner-open'>", "</body>"),
    ("<form><div><main>", "</main></div></form>"), ("<html><head><meta charset=x><article>", "</article>"), ("<head><title>t</title><div>", "</div>"),
])
def test_names_of_the_page_hide_nothing(before, after):
    """Names of the page, its article or what is around it, and a head that is not closed."""
    outside = f"<div class=sidebar>{PROSE * 4}</div>"
    assert html_blocks.main_text(f"{before}<p>{PROSE * 4}</p>{outside}<p>{PROSE * 3}</p>{after}") == f"{(PROSE * 4).strip()}\n\n{(PROSE * 3).strip()}"


@pytest.mark.parametrize("inner", [
    "<h2 id='related-work'>Related work</h2>", "<h2 id=search class='nav'>Search</h2>", f"<section id='share-prices'><p>{PROSE}</p></section>",
    f"<div data-id='ad-17' itemid='nav' data-role=menu><p>{PROSE}</p></div>", f"<div class='share-prices alert-level'><p>{PROSE}</p></div>",
    f"<p title='class=\"ad\" id=menu'>{PROSE}</p>", f"<div class=grid id=menu><p>{PROSE}</p></div>", f"<p data-style='display:none'>{PROSE}</p>",
    f"<div data-x='{'y' * 4001} > z'><p>{PROSE}</p></div>", f"<div data-x=\"{'<p>' * 20_000}\"><p>{PROSE}</p></div>"])
def test_names_that_only_look_like_boilerplate(inner):
    """Ids and tails of other attributes inside an article, also in a later article, and attributes of any length."""
    kept = html.unescape(re.sub("<[^>]*>", "", inner[inner.rindex("<p") if "<p" in inner else 0:])).strip()
    kept = kept[kept.index("The cat"):] if "The cat" in kept else kept
    first, last = (PROSE * 4).strip(), (PROSE * 3).strip()
    assert html_blocks.main_text(f"<article><p>{first}</p>{inner}<p>{last}</p></article>") == f"{first}\n\n{kept}\n\n{last}"
    assert html_blocks.main_text(f"<article><p>{first}</p></article><article class='post comments-open'>{inner}<p>{last}</p></article>") == f"{first}\n\n{kept}\n\n{last}"


@pytest.mark.parametrize("inner", [
    "class=ad", "class='share-buttons x'", "class='related-posts'", "id=comments", "id='comment-list'", "class='newsletter-form'", "role=navigation", "aria-label='Share buttons'", "CLASS=Sidebar"])
def test_boilerplate_inside_articles(inner):
    assert html_blocks.main_text(f"<article><p>{PROSE * 4}</p><div {inner}><p>{PROSE * 2}</p></div></article>") == (PROSE * 4).strip()


def test_form_around_the_page():
    text = "".join(f"<p>{PROSE * 4}</p>" for _ in range(3))
    assert html_blocks.main_text(f"<body><form action=x>{text}</form></body>") == "\n\n".join([(PROSE * 4).strip()] * 3)
    assert html_blocks.main_text(f"<body>{text}<p>{PROSE * 4}</p><form><p>{PROSE * 4}</p><p>Name</p><p>Mail</p></form></body>") == "\n\n".join([(PROSE * 4).strip()] * 4)


def test_comments_in_articles_stay_out():
    page = f"<main><article><p>{PROSE}</p></article><div class=comments><article class=comment><p>{PROSE * 4}</p></article></div></main>"
    assert html_blocks.main_text(page) == PROSE.strip()


def test_mathematics_is_text():
    assert html_blocks.main_text(f"<article><p>{PROSE}<math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>") == f"{PROSE}x=2"


def test_neighbours_decide_short_blocks():
    poor = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod " * 5
    page = f"<p>{PROSE * 4}</p><h2>Between</h2><p>{PROSE * 4}</p><p>{poor}</p><p>tail</p><p>{poor}</p>"
    assert html_blocks.main_text(page).split("\n\n") == [(PROSE * 4).strip(), "Between", (PROSE * 4).strip()]


def test_long_and_broken_pages():
    for page in ("<div>" * 50_000 + "x", "<a href='" * 20_000, "<" * 100_000, "</p>" * 50_000, "<p>" * 50_000, "&" * 50_000, "<!--" * 20_000, '<a b="' * 20_000, "<a b='" + '<i c="x>' * 20_000, "<b c=' >" * 20_001, '<b "' + "x " * 50_000 + "<p>" * 20_000):
        html_blocks.main_text(page)


def test_page_edges(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a b</p>", "y"), (None, "u", "<p>a b</p>", "y"), (2, "u", "", None)], "page_id long, url string, html string, text string")
    rows = sorted(map(repr, map(tuple, html_blocks.extract(pages).collect())))
    assert rows == sorted(map(repr, [(1, None, "", 0), (None, "u", "a b", 3), (None, "u", "a b", 3), (2, "u", "", 0)]))
    assert html_blocks.extract(pages.where("false")).count() == 0


def test_stages(spark, docs):
    """Every stage against what it should do with its own input."""
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    known = stages["language_id"](spark, docs, SF)
    assert known.columns == docs.columns and known.count() > 0.99 * docs.count()
    first = stages["near_duplicates"](spark, known, SF)
    groups = brute_components(sorted(rows(known).items()), 4)
    assert {repr(d) for d in rows(first)} == {c for _, _, c in groups} and first.columns == docs.columns
    second = stages["repeated_strings"](spark, first, SF)
    source = rows(first)
    want = {d: k.decode("utf-8", "ignore") for d, *_, k in brute_removal(sorted(source.items()))}
    assert rows(second) == {d: t for d, t in want.items() if t or not source[d]} and second.columns == docs.columns
    third = stages["decontamination"](spark, second, SF)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaked = {r["doc_id"] for r in decontam.find_leaks(second, items).collect()}
    assert leaked and set(rows(third)) == set(rows(second)) - leaked and third.columns == docs.columns
    last = stages["packing"](spark, third, SF).collect()
    assert {r["doc_id"] for r in last} == set(rows(third)) and sum(r["length"] for r in last) == sum({r["doc_id"]: r["doc_tokens"] for r in last}.values())
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in last)


def test_stage_edges(spark, edge_docs, no_docs):
    current = edge_docs
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0
        after = stage(spark, edge_docs, SF)
        assert name == "packing" or after.columns == edge_docs.columns
        after.collect()
        current = stage(spark, current, SF)
    assert current.count() > 0
    kept = corpus_pipeline.language_id(spark, edge_docs, SF).collect()
    assert all(r["text"] and any(c.isalpha() for c in r["text"]) for r in kept)
    assert simhash.THRESHOLD == 4
