import pytest

SF = "/root/testdata/sf0.001"
#: Names that the operators use themselves.
CLASHING = ["score", "fingerprint", "lang_pred", "bucket", "spans", "start", "length", "ids", "n", "anchor", "component_id", "kept", "found",
            "__found", "__n", "__key", "__id", "__doc", "__spans", "doc", "text_key", "doc_of", "key_of", "id", "key", "times", "row", "text_of", "name", "level", "place",
            "row_no", "size", "identity", "least", "slice", "root", "smallest", "form", "output", "tile", "total", "term", "p", "q", "rank", "item"]
LONG = "word and another one, " * 30_000


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [(1, "The cat and the dog of the house.\nThe cat and the dog of the house.", "en", "a"), (None, "der Hund und die Katze", "de", None),
            (None, None, None, None), (2, None, "en", "a"), (3, "", None, "a"), (3, "", None, "a"), (4, "  \n\t \n", "fr", "b"), (5, "1234 ++ 99", "fr", "b"),
            (6, LONG, "en", "b"), (6, LONG, "en", "b"), (7, LONG[:100], "en", "b"), (8, "日本語 テキスト é̀ \x00 ﷺ", "ja", "c"), (9, "x", "en", "c")]
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r[:4], len(r[1] or ""), *["x"] * len(CLASHING)) for r in rows],
                                 f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
