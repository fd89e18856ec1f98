"""Divergence of sources, against counters of whole terms."""

import random
import re
from collections import Counter, defaultdict

import pytest

from siftline.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=3, top=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        terms = TERM.findall(lowered(text))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(own):
            total = sum(own[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (own[t] + 1) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(whole)

        def told(source, part, found, limit=None):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit], 1):
                out.append((lang, source, part, item, value, rank))

        for s in sources:
            told(s, "pair", [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources - {s}])
            told(s, "term", [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]], top)
    return sorted(out)


def found(df, **options):
    return sorted(map(tuple, divergence.divergence(df, **options).collect()))


def corpus(n, sources, seed=3):
    """Terms that share prefixes of every length, some longer than several levels, in groups of unequal size."""
    rng = random.Random(seed)
    stems = ["a", "ab", "abc", "abcd", "abcde", "abcdefgh" * 3, "abcdefgh" * 3 + "x", "é" * 9, "日本語", "z" * 300, "z" * 301, "Zebra", "zebra"]
    rare = ["".join(rng.choices("abcdé", k=rng.randint(1, 30))) for _ in range(60)]
    rows = []
    for _ in range(n):
        words = rng.choices(stems + rare, k=rng.choice([0, 1, 5, 30]))
        rows.append((rng.choice(["en", "en", "fr", None]), rng.choice(sources), rng.choice([" ", ", ", "1", "\n"]).join(words)))
    return [*rows, ("de", "alone", "ein Wort"), ("it", "a", None), ("it", "b", ""), (None, None, None), ("en", "quiet", "1234 --")]


@pytest.mark.parametrize("tile, terms, options", [
    (64, 1 << 16, {}), (2, 5, {"first": 1, "factor": 2}), (3, 1 << 16, {"bits": (3, 3)}), (1, 7, {"least": 1, "top": 4}), (64, 1, {"least": 12, "first": 2})])
def test_against_brute_force(spark, monkeypatch, tile, terms, options):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "TERMS", terms)
    rows = corpus(80, ["a", "b", "é", "", None, "src", "SRC", "c c"])
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    assert found(df, **options) == brute(rows, options.get("least", 3), options.get("top", 200))


def test_edge_rows(spark, edge_docs, no_docs):
    rows = [(r["lang"], r["source"], r["text"]) for r in edge_docs.collect()]
    assert found(edge_docs) == brute(rows)
    assert found(edge_docs, least=1) == brute(rows, 1)
    assert found(no_docs) == []


def test_levels_end_with_complete_terms(spark):
    rows = [("en", "a", "z" * 300 + " " + x) for x in ("one", "two", "three")] + [("en", "b", "y" * 3000)]
    df = divergence._stated(spark.createDataFrame(rows, "lang string, source string, text string"))
    assert divergence.refined(df)[0] == 1024
    assert divergence.refined(df, least=1)[0] == 4096


def test_counts_beyond_long_products(spark):
    """A count whose product with a billion needs more than 64 bits."""
    n = 10**13
    rows = [(n, 2 * n, 7), (9 * 10**9 - 1, 10**10, 3), (9 * 10**9, 10**10, 3), (0, 0, 5)]
    df = spark.createDataFrame(rows, "n long, total long, terms long")
    assert [r[0] for r in df.select(divergence._share(df["n"])).collect()] == [1 + 10**9 * (n + 1) // (total + terms) for n, total, terms in rows]


def test_batches_cut_anywhere(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 2)
    rows = corpus(40, ["a", "b", "c", "d", "e"], seed=8)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert found(spark.createDataFrame(rows, "lang string, source string, text string")) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
