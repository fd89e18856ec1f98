"""Operators against brute force and hand-computed values."""

import math
import random

import pytest
from pyspark.sql import Window as W, functions as F

from siftline.functions import vocab
from siftline.operators import bm25, catalog, chunks, corpus, dense, fusion, graphs, grids, hypotheses as hy, library as lib, sections, summaries, tfidf
from siftline.operators.ranking import ordinal, running_total, score_rank
from siftline.plans import context, retrieve


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_bucketed_ranks_equal_windows(spark):
    rng = random.Random(1)
    # Two thirds of the rows of group 0 share one score: the tie is divided by index range.
    data = [(g, i, 0.0 if rng.random() < 0.66 else round(rng.random(), 2)) for g in (0, 1) for i in range(400)]
    df = spark.createDataFrame(data, "g int, i long, s double")
    plain = df.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy(F.col("s").desc(), "i")))
    assert rows(score_rank(df, ["g"], "s", "i", "r", width=16), "g", "i", "r") == rows(plain, "g", "i", "r")
    total = df.withColumn("r", F.sum("i").over(W.partitionBy("g").orderBy("i")))
    assert rows(running_total(df, ["g"], "i", F.col("i"), "r", width=16), "g", "i", "r") == rows(total, "g", "i", "r")
    assert rows(ordinal(df, ["g"], "i", "r", width=7), "i", "r")[:3] == [(0, 1), (0, 1), (1, 2)]


TINY = [("c", 0, "nickel alloy corrosion"), ("c", 1, "nickel nickel plating"), ("c", 2, ""), ("d", 3, "nickel")]


def test_bm25_by_hand(spark, tmp_path):
    passages = spark.createDataFrame(TINY, "corpus string, pid long, text string")
    queries = spark.createDataFrame([(1, "c", "nickel nickel corrosion the")], "query_id long, corpus string, text string")
    avg = (3 + 3 + 0) / 3

    def part(n, f, dl):
        return math.log(1 + (3 - n + .5) / (n + .5)) * f * 2.5 / (f + 1.5 * (.25 + .75 * dl / avg))

    want = {0: round(part(2, 1, 3) + part(1, 1, 3), 4), 1: round(part(2, 2, 3), 4)}
    got = bm25.best(bm25.match_passages(passages, queries)).collect()
    assert {r["pid"]: r["bm25"] for r in got} == want
    assert {r["pid"]: r["terms"] for r in got}[0] == ["corrosion", "nickel"]
    corpus.write_index(passages, str(tmp_path / "index"))
    stored = bm25.score(bm25.match_index(corpus.read_index(spark, str(tmp_path / "index")), queries)).collect()
    assert {r["pid"]: r["bm25"] for r in stored} == want


def test_bm25_empty_corpus_scores_nothing(spark):
    passages = spark.createDataFrame([("c", 0, "the of")], "corpus string, pid long, text string")
    queries = spark.createDataFrame([(1, "c", "nickel")], "query_id long, corpus string, text string")
    assert bm25.score(bm25.match_passages(passages, queries)).count() == 0


def test_nearest_takes_several_query_blocks(spark):
    rng = random.Random(3)
    vectors = [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(60)]
    passages = spark.createDataFrame(list(enumerate(vectors)), "pid long, vector array<float>").repartition(5)
    queries = spark.createDataFrame(list(enumerate(vectors[:9])), "query_id long, vector array<float>")
    whole = dense.nearest(passages, queries, 4)
    blocks = dense.nearest(passages, queries, 4, block_bytes=120)
    names = ("query_id", "pid", "dense", "dense_rank")
    assert rows(whole, *names) == rows(blocks, *names)
    assert all(r[3] != 1 or r[0] == r[1] for r in rows(whole, *names))


def test_pool_keeps_its_promises(spark):
    """Within the budget; best first; every language has its quota as far as the budget
    allows; what was left out for no quota is no better than what was taken for none."""
    rng = random.Random(5)
    budget, quota, groups = 6, 2, {}
    for q in range(60):
        groups[q] = [(i, rng.choice([0.0, .1, .2, .3, .5]), rng.choice(["en", "en", "ru", "other"])) for i in range(rng.randint(1, 14))]
    df = spark.createDataFrame([(q, *x) for q, items in groups.items() for x in items], "query_id long, pid long, hybrid double, lang string")
    got = {}
    for r in fusion.select_pool(df, budget, quota).orderBy("query_id", "cand_idx").collect():
        got.setdefault(r["query_id"], []).append((r["pid"], r["hybrid"], r["lang"]))
    assert set(got) == set(groups)
    for q, items in groups.items():
        taken, left = got[q], [x for x in items if x not in got[q]]
        assert len(taken) == min(budget, len(items)) and set(taken) <= set(items)
        assert [x[1] for x in taken] == sorted((x[1] for x in taken), reverse=True)
        if not left:
            continue
        best = {lang: sorted((x for x in items if x[2] == lang), key=lambda x: (-x[1], x[0]))[:quota] for lang in {x[2] for x in items}}
        if sum(map(len, best.values())) <= budget:
            reserved = {x for own in best.values() for x in own}
            assert reserved <= set(taken)
            free = [(-x[1], x[0]) for x in taken if x not in reserved]
            assert not free or max(free) < min((-x[1], x[0]) for x in left)


def test_fusion_counts_zero_scores_and_missing_vectors(spark):
    df = spark.createDataFrame([(1, 0, 0.0, .5), (1, 1, 2.0, None), (1, 2, 0.0, .9), (2, 0, 1.5, None)],
                               "query_id long, pid long, bm25 double, dense double")
    got = {(r["query_id"], r["pid"]): r["hybrid"] for r in fusion.fuse(df).collect()}
    assert got == {(1, 0): 1 / 62 + 1 / 62, (1, 1): 1 / 61, (1, 2): 1 / 63 + 1 / 61, (2, 0): 1.5}


def test_rerank_merge_edge_cases(spark):
    pool = spark.createDataFrame([(q, c, q * 10 + c, .5 - c / 10) for q in (1, 2) for c in range(3)], "query_id long, cand_idx long, pid long, hybrid double")
    answers = spark.createDataFrame([(1, 2, 0, .9), (1, 7, 1, .8), (1, 0, 2, .1), (2, 9, 0, .7)], "query_id long, cand_idx long, pos long, score double")
    got = fusion.merge_rerank(pool, answers).orderBy("query_id", "pos").collect()
    assert [(r["query_id"], r["pid"], r["score"], r["reranked"]) for r in got] == [
        (1, 12, .9, True), (1, 10, .1, True), (2, 20, .5, False), (2, 21, .4, False), (2, 22, .3, False)]


def test_retrieve_without_vectors_and_provider(spark):
    passages = spark.createDataFrame([("c", 0, "nickel corrosion", "s0"), ("c", 1, "никель коррозия", "s1"), ("c", 2, "nickel", "s0")],
                                     "corpus string, pid long, text string, source_key string")
    queries = spark.createDataFrame([(1, "c", "nickel corrosion")], "query_id long, corpus string, text string")
    items, stages = retrieve.retrieve(passages, queries)
    got = items.orderBy("final_rank").collect()
    assert [r["pid"] for r in got] == [0, 1] and got[0]["terms"] == ["corrosion", "nickel"]
    stage = stages.first()
    assert (stage["passages"], stage["candidates"], stage["fusion"], stage["reranked"]) == (3, 3, "bm25", False)
    assert [tuple(x) for x in stage["languages"]] == [("en", 2), ("ru", 1)]


def test_tfidf_fills_with_zero_scores(spark):
    passages = spark.createDataFrame([("c", i, t) for i, t in enumerate(["alpha beta", "gamma", "delta"])] + [("e", 9, "и"), ("e", 8, "в")],
                                     "corpus string, pid long, text string")
    queries = spark.createDataFrame([(1, "c", "alpha beta"), (2, "e", "и")], "query_id long, corpus string, text string")
    got = [(r["query_id"], r["pid"], r["score"]) for r in tfidf.search(passages, queries, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 0, 1.0), (1, 2, 0.0), (1, 1, 0.0), (2, 8, 0.0), (2, 9, 0.0)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_max_similarity_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)]
    sets = [frozenset(rng.choices(words, [1 / (i + 1) for i in range(25)], k=rng.randint(0, 9))) for _ in range(40)]
    # A third of the items are exact copies of one item.
    sets += [sets[0]] * 20 + [frozenset(["only"])]
    items = [(i % 2, str(i), sorted(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(items, "project_id int, item_key string, tokens array<string>")
    want = []
    for p, k, t in items:
        best = max([len(set(t) & set(o)) / len(set(t) | set(o)) for q, j, o in items if q == p and j != k and o and t] or [0.0])
        want.append((k, round(best, 9)))
    got = [(r["item_key"], round(r["max_similarity"], 9)) for r in lib.max_similarity(df).collect()]
    assert sorted(got) == sorted(want)


def test_relevance_matches_roots(spark):
    tokens = spark.createDataFrame([(1, "a", ["corrosions", "abc"]), (1, "b", ["zzz"]), (1, "c", []), (2, "d", ["x12"])], "project_id int, item_key string, tokens array<string>")
    projects = spark.createDataFrame([(1, "corrosion", "abcdef", None, None), (2, None, None, None, None)], "project_id int, kpi_target string, kpi_metric string, domain string, constraints string")
    # 'abcdef' starts with the token 'abc'; everything matches: 2.5 + 6 + 0.7
    assert rows(lib.relevance(tokens, projects), "item_key", "relevance") == [("a", 9.2), ("b", 1.5), ("c", 0.0), ("d", 5.0)]


def test_sections_from_styles_and_lines(spark):
    paras = spark.createDataFrame([(1, 0, None, "intro"), (1, 1, "Heading 1", "Empty"), (1, 2, "heading 2", "Body"), (1, 3, "Normal", "one "), (1, 4, "Normal", " "), (1, 5, "Normal", "two")],
                                  "document_id long, pos long, style string, text string")
    got = sections.paragraph_sections(paras)
    assert rows(got, "section_order", "title", "text") == [(1, "Document", "intro"), (2, "Body", "one\ntwo")]
    docs = spark.createDataFrame([(1, "lead text that goes on.\n# Title\nbody of it is here.\n\n1.2 Numbered thing\nlast line ends.")], "document_id long, text string")
    assert rows(sections.text_sections(docs), "section_order", "title", "text") == [
        (1, "Text", "lead text that goes on."), (2, "Title", "body of it is here."), (3, "1.2 Numbered thing", "last line ends.")]


def test_pages_without_text_warn(spark):
    pages = spark.createDataFrame([(1, 1, " "), (2, 1, "x "), (2, 2, "")], "document_id long, page int, text string")
    got = sections.page_sections(pages)
    assert rows(got, "document_id", "title", "text", "page_from") == [(2, "Page 1", "x", 1)]
    docs = pages.select("document_id").distinct()
    assert rows(sections.pages_without_text(docs, got), "document_id") == [(1,)]


def test_grid_headers_and_rows(spark):
    lines = [(0, "A;a;A 2;;x"), (1, ";;;;"), (2, "1;2;3;4"), (3, "")]
    df = spark.createDataFrame([("f", p, t) for p, t in lines], "doc string, pos long, text string")
    grid = grids.trim_grid(grids.split_lines(df, grids.delimiter_votes(df)))
    flags = grids.header_flags(grid, "always")
    heads = grids.headers(grid, flags)
    assert rows(heads, "col", "header") == [(1, "A"), (2, "a 2"), (3, "A 2"), (4, "Column 4"), (5, "x")]
    maps = grids.row_maps(grid, flags, heads).collect()
    assert [r["values"] for r in maps] == [{"A": "1", "a 2": "2", "A 2": "3", "Column 4": "4", "x": None}]


def test_grid_keeps_the_last_of_equal_headers(spark):
    df = spark.createDataFrame([("f", 0, "A,A,A 2"), ("f", 1, "1,2,3")], "doc string, pos long, text string")
    grid = grids.trim_grid(grids.split_lines(df, grids.delimiter_votes(df)))
    flags = grids.header_flags(grid, "always")
    maps = grids.row_maps(grid, flags, grids.headers(grid, flags)).collect()
    assert [r["values"] for r in maps] == [{"A": "1", "A 2": "3"}]


def test_quoted_fields(spark):
    df = spark.createDataFrame([("f", 0, 'x,"a, ""b""",y'), ("f", 1, "1,2,3")], "doc string, pos long, text string")
    cells = grids.split_lines(df, grids.delimiter_votes(df))
    assert rows(cells.filter("row = 0"), "col", "value") == [(1, "x"), (2, 'a, "b"'), (3, "y")]


def test_table_chunk_text(spark):
    row = F.create_map(F.lit("a"), F.lit('q"'), F.lit("b"), F.lit(None).cast("string"))
    df = spark.range(1).select(F.lit(1).alias("document_id"), F.lit(1).alias("table_order"), F.lit("T").alias("name"), F.lit(None).cast("string").alias("sheet_name"),
                               F.array(F.lit("a"), F.lit("b")).alias("columns"), F.lit(1).alias("row_count"), F.array(grids.json_row(row)).alias("sample"))
    assert chunks.table_chunks(df).first()["text"] == 'Table T has 1 rows and columns: a, b. Sample rows: [{"a": "q\\"", "b": null}]'


def test_summary_fallbacks(spark):
    none = F.array().cast("array<string>")

    def call(**kw):
        base = dict(text=F.lit("x"), titles=F.array(F.lit("t")), is_dataset=F.lit(False), sheets=none, table_count=F.lit(0), chunk_count=F.lit(0), first_section=F.lit(""), table_blocks=none)
        return spark.range(1).select(summaries.summary_with_fallbacks(**{**base, **kw}).alias("v")).first()["v"]

    assert call(is_dataset=F.lit(True), table_count=F.lit(2), sheets=F.array(F.lit("s1"))) == "Табличный файл с извлечёнными данными; листы: s1, таблиц: 2."
    assert call(first_section=F.lit("a section that says quite enough")) == "a section that says quite enough"
    assert call(table_blocks=F.array(F.lit("no"), F.lit("Table data. Rows: 3. Columns: alpha, beta"))) == "Table data. Rows: 3. Columns: alpha, beta"
    assert call() is None


def test_patch_sets_deletes_and_ignores(spark):
    base = spark.createDataFrame([(i, "proposed", "s", {"value": 10.0}) for i in range(4)], "hypothesis_id long, status string, statement string, expert_scores map<string,double>")
    patches = spark.createDataFrame(
        [(0, {"status": "accepted", "statement": None}, None), (1, {"status": "bad"}, {"value": None}), (2, None, {"risk": 500.0, "x": 1.0})],
        "hypothesis_id long, patch map<string,string>, expert_scores map<string,double>")
    got = {r["hypothesis_id"]: (r["status"], r["statement"], r["expert_scores"]) for r in catalog.patch_hypotheses(base, patches).collect()}
    assert got == {0: ("accepted", None, {"value": 10.0}), 1: ("proposed", "s", None), 2: ("proposed", "s", {"value": 10.0, "risk": 100.0}), 3: ("proposed", "s", {"value": 10.0})}


def test_match_prefers_reference_then_year(spark):
    catalogue = spark.createDataFrame([(1, 10, "T", 2000, "R1"), (1, 11, "t ", 2001, None), (1, 9, "u", None, "r1"), (2, 1, "t", 2001, "zz")],
                                      "project_id long, source_id long, title string, year int, reference string")
    cands = spark.createDataFrame([(1, 0, "x", 1, " R1 "), (1, 1, "T", 2001, None), (1, 2, "T", 1990, "no"), (1, 3, None, None, None), (1, 4, "new", 1, "zz")],
                                  "project_id long, pos long, title string, year int, reference string")
    got = rows(catalog.mark_candidates(cands, catalogue).fillna(-1), "pos", "existing_source_id")
    assert got == [(0, 9), (1, 11), (2, 10), (3, -1), (4, -1)]


def test_members_and_short_search(spark):
    mem = spark.createDataFrame([(1, 1, "member"), (2, 1, "owner"), (3, 1, "member")], "user_id long, project_id long, role string")
    users = spark.createDataFrame([(1, "bob"), (2, "zed"), (3, "amy")], "user_id long, username string")
    assert [r["username"] for r in catalog.members(mem, users).collect()] == ["zed", "amy", "bob"]
    src = spark.createDataFrame([(1, "Никель 100%", "c", None, None, 5)], "source_id long, title string, content string, authors string, reference string, created_at long")
    assert catalog.search_sources(src, "x").count() == 0
    assert catalog.search_sources(src, "НИКЕЛЬ _00").count() == 1
    more = catalog.upsert_members(mem, spark.createDataFrame([(1, 1, "owner"), (9, 1, "member")], "user_id long, project_id long, role string"))
    assert rows(more, "user_id", "role") == [(1, "member"), (2, "owner"), (3, "member"), (9, "member")]


def test_context_for_an_empty_base(spark):
    projects = spark.createDataFrame([(1, "P", "K", None, None, None, None, None)], "project_id long, title string, kpi_target string, kpi_metric string, kpi_direction string, domain string, constraints string, topic string")
    ctx = spark.createDataFrame([], "query_id long, context string")
    notes = spark.createDataFrame([], "project_id long, feedback string")
    text = context.generation_requests(projects, ctx, notes, 3).first()["request"]
    assert context.EMPTY_BASE in text and "Метрика: не задана (направление: увеличить)" in text and "Сгенерируй 3 " in text
    assert "WEIGHT" not in context.weight_requests(projects).first()["request"]


def test_audit_runs_keep_failures(spark):
    projects = spark.createDataFrame([(1,), (2,)], "project_id long")
    weights = spark.createDataFrame([(1, "default")], "project_id long, weight_mode string")
    log = spark.createDataFrame([(1, ["a"])], "query_id long, retrieved array<string>")
    stages = spark.createDataFrame([(1, 3)], "query_id long, passages long")
    requests = spark.createDataFrame([(1, "p")], "project_id long, preview string")
    errors = spark.createDataFrame([(2, "timeout")], "project_id long, error string")
    got = {r["project_id"]: r["error"] for r in context.audit_runs(projects, weights, log, stages, requests, errors).collect()}
    assert got == {1: None, 2: "timeout"}


def test_graph_without_evidence_uses_the_last_run(spark):
    df = spark.sql("""SELECT 1 AS hypothesis_id, ' S ' AS statement, CAST(NULL AS STRING) AS rationale, '' AS mechanism, '' AS goal_link, CAST(NULL AS STRING) AS value_rationale,
      '' AS validation, '' AS risk_rationale, 1.0D AS value, 2.0D AS feasibility, CAST(NULL AS DOUBLE) AS risk, 50.4D AS composite, array('a', '') AS tags,
      CAST(array() AS array<struct<title:string,snippet:string,relevance:string,source_id:string>>) AS evidence,
      array(named_struct('title', '', 'score', 0.5D, 'terms', array('t', 'u'), 'source_id', 'x')) AS retrieved, '' AS kpi_target, 'lim' AS constraints""")
    prepared = graphs.prepare(df)
    assert rows(graphs.nodes(prepared), "node_id", "label", "description") == [
        ("constraint-1", "Ограничения", "lim"), ("evidence-1-0", "Источник 1", "score 0.500 • t, u"), ("hypothesis-1", "S", graphs.NO_RATIONALE), ("tag-1-0", "a", graphs.TAG_TEXT)]
    assert rows(graphs.edges(prepared), "source", "target", "type") == [
        ("constraint-1", "hypothesis-1", "limits"), ("evidence-1-0", "hypothesis-1", "supports"), ("tag-1-0", "hypothesis-1", "describes")]


def test_composite_grows_with_each_good_axis(spark):
    data = [(i, "p", float(n), 50.0, 50.0, 50.0) for i, n in enumerate(range(0, 101, 10))]
    df = spark.createDataFrame(data, "hypothesis_id long, project_id string, novelty double, value double, feasibility double, risk double")
    got = [r["composite"] for r in hy.rank(df, ["project_id"]).orderBy("hypothesis_id").collect()]
    assert got == sorted(got) and got[0] < got[-1]
    assert set(vocab.AXES) <= set(df.columns)


def test_nothing_is_cut_by_default(spark):
    """More of everything than the limits that callers may pass."""
    from siftline.functions import text as tx

    lines = spark.createDataFrame([("d", k, f"n{k},{k}" if k else "name,value") for k in range(6002)], "doc string, pos long, text string")
    grid = grids.trim_grid(grids.split_lines(lines, grids.delimiter_votes(lines)))
    flags = grids.header_flags(grid)
    heads = grids.headers(grid, flags)
    assert grids.row_maps(grid, flags, heads).count() == 6001 and grids.row_maps(grid, flags, heads, cap=7).count() == 7
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(tx.detect_language(F.lit("привет " * 3000 + "hello " * 30000))) == "en"
    assert one(tx.detect_language(F.lit("привет " * 3000 + "hello " * 30000), first=20000)) == "ru"
    refs = F.lit(" ".join(f"https://a.b/{k}" for k in range(40)))
    assert len(one(tx.references(refs))) == 40 and len(one(tx.references(refs, 25))) == 25
    assert one(tx.elements(F.lit("Fe Ni Cu Al Zn Fe"))) == ["Fe", "Ni", "Cu", "Al", "Zn"]
    long = "t" * 130
    none = F.lit(None).cast("int")
    assert one(tx.dedupe_key(F.lit(""), F.lit(long + "a"), none)) != one(tx.dedupe_key(F.lit(""), F.lit(long + "b"), none))
    found = spark.createDataFrame([(1, k, f"T{k}" + "x" * 500, "c", None, None) for k in range(40)],
                                  "project_id long, pos long, title string, content string, reference string, year int")
    empty = spark.createDataFrame([], "project_id long, source_id long, title string, year int, reference string")
    rows = catalog.select_imports(found, empty).collect()
    assert sorted(r["import_rank"] for r in rows) == list(range(1, 41)) and all(len(r["title"]) > 500 for r in rows)
    assert catalog.select_imports(found, empty, max_import=12, title_chars=400).count() == 12


def test_patches_of_one_row_apply_in_turn(spark):
    base = spark.createDataFrame([(1, "a", "b", 2000), (2, "c", "d", None)], "source_id long, title string, content string, year int")
    patches = spark.createDataFrame([(1, 2, {"title": "second", "year": "1999"}), (1, 1, {"title": "first", "content": None})],
                                    "source_id long, pos int, patch map<string,string>")
    rows = sorted(map(tuple, catalog.patch_rows(base, patches, "source_id", ["title", "content", "year"]).collect()))
    assert rows == [(1, "second", None, 1999), (2, "c", "d", None)]


def test_dense_search_in_tiles_with_nulls(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(90, 5)).round(2)
    passages = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + [(500, None)], "pid long, vector array<double>")
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors[:17])] + [(99, None)], "query_id long, vector array<double>")
    whole = sorted(map(tuple, dense.nearest(passages, queries, 3).collect()))
    assert whole == sorted(map(tuple, dense.nearest(passages, queries, 3, block_bytes=200, tile=4).collect())) and len(whole) == 51
    for q in range(17):
        scores = sorted(((-float(dense.half_up(np.array([[vectors[q] @ v / np.linalg.norm(vectors[q]) / (np.linalg.norm(v) + 1e-9)]]))[0, 0]), p) for p, v in enumerate(vectors)))[:3]
        assert [(p, -s) for s, p in scores] == [(r[1], r[2]) for r in sorted((w for w in whole if w[0] == q), key=lambda r: (-r[2], r[1]))]
    ragged = passages.union(spark.createDataFrame([(7, [1.0])], "pid long, vector array<double>"))
    with pytest.raises(Exception, match="differs in length"):
        dense.nearest(ragged, queries, 3).collect()


def test_ranks_of_null_scores(spark):
    rows = spark.createDataFrame([("a", None, 3), ("a", 1.0, 2), ("a", None, 1), (None, None, 4)], "k string, s double, i long")
    got = {(r["k"], r["i"]): r["n"] for r in score_rank(rows, ["k"], "s", "i", "n").collect()}
    assert got == {("a", 2): 1, ("a", 1): 2, ("a", 3): 3, (None, 4): 1}
