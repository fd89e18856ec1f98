"""Text and score functions on texts that the tables do not contain."""

import pytest
from pyspark.sql import functions as F

from siftline.functions import scores as sc, text as tx, vocab
from siftline.operators import chunks


def one(spark, make, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(make.alias("v")).first()["v"]


def text(spark, fn, value):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(fn(F.col("x")).alias("v")).first()["v"]


def test_tokenize_mixes_languages(spark):
    assert text(spark, tx.tokenize, "Сплав Ni-Cr-Mo ещё в H2SO4 и the Ёлка") == ["сплав", "ni-cr-mo", "h2so4", "елка"]
    assert text(spark, tx.tokenize, None) == []


@pytest.mark.parametrize("value, lang", [("сплав nickel abc", "en"), ("сплавы ab", "ru"), ("123 -", "other"), ("ab аб", "ru"), (None, "other")])
def test_detect_lang(spark, value, lang):
    assert text(spark, tx.detect_lang, value) == lang


def test_detect_language_needs_letters(spark):
    assert text(spark, tx.detect_language, "short") is None
    assert text(spark, tx.detect_language, "а" * 50) == "ru"
    assert text(spark, tx.detect_language, "а" * 30 + "b" * 30) == "mixed"


def test_collapse_takes_unicode_spaces(spark):
    assert text(spark, tx.collapse, " a  b\n\tc ") == "a b c"


def test_clean_text(spark):
    assert text(spark, tx.clean_text, "\r\n a  \r\nb\t\r\n\r\n") == "a\nb"


def test_references(spark):
    value = "doi 10.1234/AbC.5, https://doi.org/10.1234/abc.5; HTTPS://X.org/a). 10.1234/ABC.5"
    assert text(spark, tx.references, value) == ["10.1234/AbC.5", "https://doi.org/10.1234/abc.5", "HTTPS://X.org/a"]


def test_split_tokens(spark):
    assert text(spark, tx.split_tokens, " a, b;\n c ;") == ["a", "b", "c"]
    assert text(spark, tx.split_names, "Ann and Bob; Sandy, ") == ["Ann", "Bob", "Sandy"]


def test_year_prefers_first_value_that_has_one(spark):
    assert one(spark, tx.extract_year(F.lit("none"), F.lit("in 1899 and 2024"), F.lit("1999"))) == 2024


def test_inverted_index(spark):
    df = spark.sql("SELECT map('b', array(1, 3), 'a', array(0, 2)) AS m")
    assert df.select(tx.inverted_index_text(F.col("m")).alias("v")).first()["v"] == "a b a b"


@pytest.mark.parametrize("value, good", [
    ('```json\n{"a": 1}\n```', True), ('{"a": 1}', True), ('Well {"a": 1} done', True), ("nothing", False), ("{broken", False), (None, False)])
def test_salvage(spark, value, good):
    assert (text(spark, tx.salvage_json, value) is not None) == good


def test_citation_and_evidence_keys(spark):
    assert text(spark, tx.citation_id, " [s3] ") == "S3"
    assert one(spark, tx.evidence_key(F.lit(" Lib:A "), F.lit("x"), F.lit(1))) == "lib:a"
    assert one(spark, tx.evidence_key(F.lit(""), F.lit(None).cast("string"), F.lit(7))) == "source:7"
    assert one(spark, tx.evidence_key(F.lit(""), F.lit("source"), F.lit(0))) is None


def test_file_types(spark):
    got = [text(spark, tx.file_type, n) for n in ("A.PDF", "a.b.JPG", "x.doc", "noext", "a.zip", ".csv", "")]
    assert got == ["pdf", "image", "doc", "unknown", "zip", "unknown", "unknown"]


def test_summary_skips_titles(spark):
    body = "A nickel alloy report.\n\nThe corrosion rate fell by half in the second trial. It then stayed level for a month."
    got = one(spark, tx.heuristic_summary(F.lit(body), F.array(F.lit("A nickel alloy report"))))
    assert got == "The corrosion rate fell by half in the second trial It then stayed level for a month"


def test_dedupe_key(spark):
    assert one(spark, tx.dedupe_key(F.lit("https://dx.doi.org/10.1/A"), F.lit("t"), F.lit(1))) == "doi:10.1/a"
    assert one(spark, tx.dedupe_key(F.lit(" "), F.lit(" T "), F.lit(None).cast("int"))) == "tt:t|None"


@pytest.mark.parametrize("value, want", [("150", 100.0), ("-3", 0.0), ("x", 0.0), (None, 0.0), ("42.5", 42.5)])
def test_clamp(spark, value, want):
    assert text(spark, sc.clamp, value) == want


def test_composite_by_hand(spark):
    scores = {"novelty": F.lit(80), "value": F.lit(60), "feasibility": F.lit(40), "risk": F.lit(30)}
    assert one(spark, sc.composite(scores)) == 62.0
    zero = {a: F.lit(0.0) for a in vocab.AXES}
    assert one(spark, sc.composite(scores, zero)) == 0.0


def test_weights_without_sum_fall_back(spark):
    weights = sc.normalize_weights({a: F.lit(-1) for a in vocab.AXES})
    assert one(spark, F.struct(*[w.alias(a) for a, w in weights.items()])).asDict() == vocab.DEFAULT_WEIGHTS


def test_formula_text(spark):
    text_ = one(spark, sc.formula_text({"novelty": F.lit(80), "value": F.lit(95), "feasibility": F.lit(40), "risk": F.lit(100)}))
    assert text_ == "0,8 × новизна + 0,95 × ценность + 0,4 × реализуемость + 1 × (100 - риск)"


def test_freshness(spark):
    got = [one(spark, sc.freshness(F.lit(y).cast("int"), 2026)) for y in (2027, 2026, 2025, 2021, 2018, 2014, 2000, None, 0)]
    assert got == [10, 10, 9, 5, 4, 3, 2, 4.5, 4.5]


def test_passages_cover_the_text(spark):
    body = " ".join(f"word{i}." if i % 9 == 0 else f"word{i}" for i in range(900))
    pieces = text(spark, chunks.split_passages, body)
    assert all(len(p) <= 900 for p in pieces) and len(pieces) > 5
    assert {w for p in pieces for w in p.split()} >= set(body.split())
    assert text(spark, chunks.split_passages, "  ") == []


def test_paragraphs_and_packing(spark):
    parts = text(spark, chunks.paragraphs, "One two.\n\n  Three\nfour. \n \nFive")
    assert parts == ["One two.", "Three four.", "Five"]
    assert text(spark, chunks.paragraphs, "One two. Three! 4 five? no six") == ["One two.", "Three!", "4 five? no six"]
    long = ["a" * 1000, "b" * 590, "c" * 20, "x " * 1700]
    df = spark.createDataFrame([(long,)], "p array<string>")
    got = df.select(chunks.pack_paragraphs(F.col("p")).alias("v")).first()["v"]
    assert [len(g) for g in got[:2]] == [1591, 20]
    assert all(len(g) <= 1600 for g in got)


def test_inverted_index_is_made_without_rows_for_tokens(spark):
    df = spark.createDataFrame([(1, [["b", "a", "b"]]), (2, [[], ["x"], ["y", "x"]]), (3, []), (4, [[""]])], "id int, t array<array<string>>").coalesce(1)
    made = df.select("id", tx.inverted_index(F.col("t")).alias("m"))
    found = {r["id"]: r["m"] for r in made.collect()}
    assert found == {1: {"a": [1], "b": [0, 2]}, 2: {"x": [0, 1], "y": [0]}, 3: {}, 4: {"": [0]}}
    kept = made.where(F.size("m") > 0)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("made(") == 1 and kept.count() == 3


@pytest.mark.parametrize("name", ["inverted_index_roundtrip", "feed_works"])
def test_token_indexes_shuffle_no_tokens(spark, name):
    """One row for each document goes through the only shuffle."""
    from __spark_entry__ import queries

    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("Aggregate") == 1 and "Join" not in plan
