"""Exact duplicates by block naming, against a dictionary of texts."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftline.llm import exact


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    ids = {}
    for doc, text in rows:
        ids.setdefault(lowered(text), []).append(doc)
    best = {x: max((d for d in own if d is not None), default=None) for x, own in ids.items()}
    out, seen = [], set()
    for doc, text in rows:
        x = lowered(text)
        kept = doc == best[x] and x not in seen
        if kept:
            seen.add(x)
        out.append(repr((doc, best[x], len(ids[x]), kept, hashlib.sha256(x.encode()).hexdigest())))
    return sorted(out)


def found(df, **options):
    return sorted(repr(tuple(r)) for r in exact.exact_duplicates(df, **options).collect())


def pieces():
    """Texts over few different blocks, of 0 to 9 blocks of four bytes, with differences at every place."""
    words = ["aaaa", "bbbb", "éé", "ab"]
    texts = [""] + [a + b * k + c for a in words for b in words for k in (1, 3, 6) for c in ("", "aaaa", "Aaaa", "b")]
    return [(k, t) for k, t in enumerate(texts)] + [(500 + k, t.upper()) for k, t in enumerate(texts) if k % 3 == 0]


@pytest.mark.parametrize("size", [1, 4, 7, 1024])
def test_against_brute_force(spark, size):
    rows = pieces()
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size=size) == brute(rows)


def test_edge_rows(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert found(edge_docs, size=64) == brute(rows)
    assert found(edge_docs) == brute(rows)
    assert found(no_docs) == [] and exact.without_copies(no_docs).count() == 0
    left = exact.without_copies(edge_docs)
    assert left.columns == edge_docs.columns
    assert Counter(lowered(r["text"]) for r in left.collect()) == Counter(set(lowered(t) for _, t in rows))


def test_upper_case_beyond_ascii_differs(spark):
    rows = [(1, "Ärger"), (2, "ärger"), (3, "äRGER"), (4, "İI"), (5, "İi")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_hashes_that_collide_are_changed(spark):
    rows = pieces()
    tried = []

    def poor(content, attempt):
        tried.append(attempt)
        return F.struct(F.pmod(F.xxhash64(content, F.lit(attempt)), F.lit(5 if attempt < 2 else 1 << 40)).alias("h"))

    assert found(spark.createDataFrame(rows, "doc_id long, text string"), size=4, hashes=poor) == brute(rows)
    assert max(tried) == 2
    with pytest.raises(RuntimeError):
        exact.identities(spark.createDataFrame(rows, "doc_id long, text string"), 4, lambda c, _: F.struct(F.lit(1).alias("h")), 2)


def test_no_python_in_the_plan(spark, docs):
    plan = exact.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
