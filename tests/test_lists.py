"""List forms, the JSON report and column types."""

import json

import pytest
from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.operators import catalog, grids, hypotheses as hy, library
from siftline.sources import sinks

HYPOTHESES = "hypothesis_id long, project_id string, statement string, status string, novelty double, value double, feasibility double, risk double, expert_scores map<string,double>, evidence array<struct<title:string>>, tags array<string>"


@pytest.fixture(scope="module")
def ranked(spark):
    rows = [(k, "p" if k < 4 else "q", f'say "{k}", ok', None if k == 1 else "accepted", 10.0 * k, 80.0, 50.0, 20.0, {"value": 5.0} if k == 2 else None, [("E",), (None,)], ["a"] if k else None) for k in range(6)]
    df = spark.createDataFrame(rows, HYPOTHESES)
    for c in ("goal_link", "mechanism", "rationale", "validation", "expert_notes"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    return hy.rank(df, ["project_id"])


def test_report_is_one_json_document(spark, ranked, tmp_path):
    projects = spark.createDataFrame([("p", 'The "P"}', None), ("q", "Q", "d"), ("none", None, None)], "project_id string, title string, domain string")
    sinks.write_report(ranked, projects, str(tmp_path / "r"), exported_at="2024-01-01T00:00:00Z")
    found = {}
    for folder in (tmp_path / "r").glob("project_id=*"):
        found[folder.name.split("=")[1]] = json.loads("".join(f.read_text() for f in sorted(folder.glob("part-*"))))
    assert set(found) == {"p", "q", "none"}
    p = found["p"]
    assert list(p) == ["exported_at", "project", "ranking_weights", "summary", "hypotheses"] and p["project"]["title"] == 'The "P"}'
    assert p["ranking_weights"] == {"novelty": 0.25, "value": 0.3, "feasibility": 0.25, "risk": 0.2}
    assert p["summary"]["total"] == 4 and p["summary"]["confirmed"] == 3 and p["summary"]["proposed"] == 1
    assert [h["rank"] for h in p["hypotheses"]] == [1, 2, 3, 4] and p["hypotheses"][0]["statement"] == p["summary"]["top_statement"] == 'say "3", ok'
    low = p["hypotheses"][-1]
    assert (low["scores"]["value"], low["model_scores"]["value"], low["sources"]) == (5.0, 80.0, ["E"])
    assert found["none"]["hypotheses"] == [] and found["none"]["summary"]["total"] == 0 and found["none"]["summary"]["avg_composite"] == 0


def test_listing(ranked):
    rows = hy.listing(ranked).orderBy("id").collect()
    assert len(rows) == 6 and rows[2]["effective_scores"]["value"] == 5 and rows[2]["scores"]["value"] == 80 and rows[2]["rationales"]["risk"] is None and rows[0]["tags"] == []
    assert [r["id"] for r in hy.listing(ranked, "proposed").collect()] == [1]
    assert hy.listing(ranked.drop("expert_notes", "evidence")).where("expert_notes is null and size(evidence) = 0").count() == 6


def test_document_card(spark):
    docs = spark.createDataFrame([(1, "x " * 400, ("", "about"), "a.txt"), (2, None, (None, None), "b.txt")], "document_id long, raw_text string, metadata struct<summary:string,description:string>, filename string")
    child = spark.createDataFrame([(1,), (1,)], "document_id long")
    one, two = catalog.document_card(docs, child, child.limit(0)).orderBy("document_id").collect()
    assert (one["summary"], one["chunk_count"], one["table_count"], len(one["raw_text_preview"])) == ("about", 2, 0, 500) and one["raw_text_preview"].endswith("...")
    assert (two["summary"], two["raw_text_preview"], two["chunk_count"]) == (None, "", 0) and "raw_text" not in one.asDict()


def test_column_types(spark):
    columns = {
        "integer": (["1", "-20", "+3", None, "0"], ["1", "-20", "3", "null", "0"]), "decimal": (["1,5", "2", "-0.25", "1e3"], ["1.5", "2.0", "-0.25", "1000.0"]),
        "date": (["01.03.2024", "2024-02-29", "2024-01-05 10:30"], ['"2024-03-01"', '"2024-02-29"', '"2024-01-05T10:30"']),
        "string": (["1", "2024-02-30", 'q"\nr'], ['"1"', '"2024-02-30"', '"q\\"\\nr"']), None: ([None, None], [])}
    cells = [("d", "", r + 1, c + 1, v, "string") for c, (values, _) in enumerate(columns.values()) for r, v in enumerate(["name", *values]) if v is not None]
    cells += [("long", "", r, 1, "007" if r == 5 else "12345678901234567890", "string") for r in range(9)]
    grid = grids.trim_grid(spark.createDataFrame(cells, "doc string, sheet string, row long, col int, value string, type string"))
    types = grids.column_types(grid, grids.header_flags(grid, "always"))
    assert {(r["doc"], r["col"]): r["type"] for r in types.collect()} == {**{("d", c + 1): k for c, k in enumerate(columns)}, ("long", 1): "string"}
    found = grids.coerced(grid, types).where("row > 1 and doc = 'd'").orderBy("col", "row").groupBy("col").agg(F.collect_list("json").alias("j")).collect()
    assert {r["col"]: r["j"] for r in found} == {c + 1: [x for x in want if x != "null"] for c, (_, want) in enumerate(columns.values()) if want}
    assert spark.range(1).select(tx.cell_json(F.lit(None).cast("string"), F.lit("date"))).first()[0] == "null"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_grid_rows_over_many_parts(spark):
    """Rows are numbered through all parts of a sheet; a cell without a row widens it and takes its first number."""
    cells = [("a", "", 7 * i - 20, c, f"{i}{c}", "string") for i in range(9) for c in (1, 2)] + [("a", "", 8, 1, "x", "string"), ("a", "", 8, 1, "x", "string"),
             ("a", "", None, 5, "y", "string"), ("a", "", 9, 9, "  ", "string"), ("b", "", 3, 1, "z", "string"), (None, "", 1, 1, "z", "string")]
    df = spark.createDataFrame(cells, "doc string, sheet string, row long, col int, value string, type string")
    grid = grids.trim_grid(df, span=10)
    assert grid.columns == ["doc", "sheet", "row", "col", "value", "type", "width", "height"]
    found = sorted(tuple(r) for r in grid.collect())
    places = {p: n for n, p in enumerate(sorted({c[2] for c in cells if c[0] == "a" and c[2] is not None and c[4].strip()}), 2)}
    want = [("a", "", places[c[2]], c[3], c[4], "string", 5, len(places)) for c in cells if c[0] == "a" and c[2] in places and c[4].strip()]
    assert found == sorted([*want, ("b", "", 1, 1, "z", "string", 1, 1)])


def test_cells_meet_their_sheets_unshuffled(spark):
    df = spark.createDataFrame([("a", "", i, 1, str(i), "string") for i in range(5)], "doc string, sheet string, row long, col int, value string, type string")
    grid = grids.trim_grid(df)
    flags = grids.header_flags(grid, "always")
    assert "Exchange hashpartitioning" not in plan_of(grids.coerced(grid, grids.column_types(grid, flags)))


def test_words_meet_their_terms_unshuffled(spark):
    rows = [("p", "i1", ["alloys", "alloy", "steel"]), ("p", "i1", ["alloys"]), ("p", "i2", []), ("q", "i3", ["alloy"]), ("p", None, ["steel"]), (None, "i4", ["steel"]), ("r", "i5", ["x1y"])]
    tokenized = spark.createDataFrame(rows, "project_id string, item_key string, tokens array<string>")
    projects = spark.createDataFrame([("p", "alloyed steel", "steels", None, None), ("q", "copper", None, None, None)],
                                     "project_id string, kpi_target string, kpi_metric string, domain string, constraints string")
    found = library.relevance(tokenized, projects)
    assert "token" not in "".join(line.split("hashpartitioning", 1)[1].split(")")[0] for line in plan_of(found).splitlines() if "hashpartitioning" in line)
    # p: alloyed 3.2, steel 3.2, steels 2.4; both rows of i1 get what the item matches, all of it; a null key matches nothing
    assert sorted((r.item_key or "", r.relevance) for r in found.collect()) == [
        ("", 1.5), ("i1", 9.6), ("i1", 9.6), ("i2", 0.0), ("i3", 1.5), ("i4", 5.0), ("i5", 5.0)]


def test_strip_takes_all_white_space(spark):
    blanks = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    values = [blanks + "a" + blanks + "b" + blanks, blanks, "", "\u200ba ", "\n\ta\nb \n"]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v string")
    assert sorted(r[0] or "null" for r in df.select(tx.strip(F.col("v"))).collect()) == sorted([*((v.strip() or "null") for v in values), "null"])
