"""Fill-in-the-middle texts: string slices, exact round trips."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import fill_middle


def brute(doc, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k: 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc, n, "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return (doc, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (doc, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


TEXTS = ["", None, "x", "<", "<P", "<P>", "a<S>b", "<<M>>", "<p>", "é日本\U0001F600 mixed é̀", "<S" * 5, ">S>" * 3, "P><", "word and " * 300, "\x00\n\t", "ﷺ" * 40]


def test_against_slices(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 12)] + [(None, "no id"), (7, "twice"), (7, "twice"), (-5, "negative id")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, form string, n int").repartition(3)
    found = fill_middle.fill_in_middle(df)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr(brute(d, t)) for d, t in rows)
    assert {r["form"] for r in found.collect()} == {"plain", "psm", "spm"}
    back = fill_middle.restore(found).select("doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((d, t or "")) for d, t in rows)


def test_edge_rows(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    found = fill_middle.fill_in_middle(edge_docs)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr(brute(d, t)) for d, t in rows)
    assert sorted(r["text"] for r in fill_middle.restore(found).collect()) == sorted(t or "" for _, t in rows)
    assert fill_middle.restore(fill_middle.fill_in_middle(no_docs)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="<>PSMaé日", max_size=20), *[st.integers(0, 2**32 - 1)] * 4), min_size=1, max_size=12), st.sampled_from([1, 2, 5, 1 << 20]))
def test_round_trip_in_slices(rows, size):
    """Also when the scatter takes slices shorter than the texts."""
    old, fill_middle.SLICE = fill_middle.SLICE, size
    try:
        texts = pa.array([r[0] for r in rows], pa.string())
        found = fill_middle.transform(texts, np.array([r[1:] for r in rows], np.int64))
        for (text, *h), form, output in zip(rows, found["form"], found["output"].to_pylist()):
            a, b = sorted(x % (len(text) + 1) for x in h[:2])
            p, m, s = text[:a], text[a:b], text[b:]
            assert output == {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[fill_middle.FORMS[form]]
        assert fill_middle.restored(found["output"], found["form"]).to_pylist() == texts.to_pylist()
    finally:
        fill_middle.SLICE = old


def test_no_texts():
    found = fill_middle.transform(pa.array([], pa.string()), np.zeros((0, 4), np.int64))
    assert len(found["output"]) == 0 and len(fill_middle.restored(found["output"], found["form"])) == 0


def test_broken_output_is_refused():
    with pytest.raises(ValueError):
        fill_middle.restored(pa.array(["<P>a<S>b"]), np.array([fill_middle.PSM]))
