"""Ranking, feedback, model answers, requests and exports."""

from pyspark.sql import functions as F

from siftline.functions import scores as sc, text as tx, vocab
from siftline.operators import catalog, hypotheses as hy
from siftline.plans import context, retrieve
from . import Registry, search, table
from .sqltext import half_up

registry = Registry()


def scored(spark, folder):
    """Documents as hypotheses of their source; quality and toxicity labels give value and risk."""
    n = F.col("doc_id")
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    override = F.when(n % 4 == 0, F.create_map(F.lit("value"), (n % 90).cast("double"), F.lit("risk"), F.lit(None).cast("double")))
    return docs.select(
        n.alias("hypothesis_id"), F.col("source").alias("project_id"), tx.first_meaningful_line(F.col("text")).alias("statement"),
        F.when(n % 2 == 0, F.col("lang")).alias("goal_link"), F.when(n % 3 == 0, F.lit("mech")).alias("mechanism"),
        F.lit("why").alias("rationale"), F.when(n % 5 == 0, F.lit("plan")).alias("validation"),
        F.element_at(F.array(*[F.lit(s) for s in ("proposed", "review", "accepted", "rejected")]), (n % 4 + 1).cast("int")).alias("status"),
        F.when(n % 7 == 0, F.concat(F.lit(" note "), n.cast("string"))).alias("expert_notes"), (n * 7919 % 1000).alias("created_at"),
        (n * 37 % 101).cast("double").alias("novelty"), (F.col("quality") * 100).cast("double").alias("value"),
        (n * 53 % 101).cast("double").alias("feasibility"), (F.col("toxic") * 100).cast("double").alias("risk"),
        override.alias("expert_scores"), F.array(F.col("lang"), F.col("source")).alias("tags"),
        F.array(F.struct(F.col("source").alias("title")), F.struct(F.when(n % 2 == 0, "B").alias("title"))).alias("evidence"))


SCORED = """
h AS (SELECT doc_id AS hypothesis_id, source AS project_id,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) BETWEEN 4 AND 180)[1] AS statement,
  CASE WHEN doc_id % 2 = 0 THEN lang END AS goal_link, CASE WHEN doc_id % 3 = 0 THEN 'mech' END AS mechanism,
  CASE WHEN doc_id % 5 = 0 THEN 'plan' END AS validation, lang, source,
  ['proposed', 'review', 'accepted', 'rejected'][doc_id % 4 + 1] AS status, CASE WHEN doc_id % 7 = 0 THEN 'note ' || doc_id END AS note,
  doc_id * 7919 % 1000 AS created_at, CAST(doc_id * 37 % 101 AS DOUBLE) AS novelty, CAST(quality * 100 AS DOUBLE) AS value,
  CAST(doc_id * 53 % 101 AS DOUBLE) AS feasibility, CAST(toxic * 100 AS DOUBLE) AS risk,
  CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 90 AS DOUBLE) ELSE CAST(quality * 100 AS DOUBLE) END AS eff_value
  FROM documents LEFT JOIN labels USING (doc_id))"""


def _composite(n="0.25", v="0.30", f="0.25", r="0.20"):
    w = [f"CAST({x} AS DOUBLE)" for x in (n, v, f, r)]
    num = (f"({w[0]} * coalesce(novelty, 0) + {w[1]} * coalesce(eff_value, 0) + {w[2]} * coalesce(feasibility, 0) "
           f"+ {w[3]} * (100 - coalesce(risk, 0)))")
    return f"coalesce({half_up(f'{num} / nullif({w[0]} + {w[1]} + {w[2]} + {w[3]}, 0)', 1)}, 0)"


RANKED = f"""{SCORED},
c AS (SELECT *, {_composite()} AS composite FROM h),
ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY composite DESC, hypothesis_id) AS rank FROM c)"""


@registry.add(f"WITH {RANKED} SELECT hypothesis_id, composite, rank, CASE WHEN composite >= 70 THEN 'good' WHEN composite >= 45 THEN 'mid' ELSE 'weak' END AS band FROM ranked")
def composite_rank(spark, folder):
    ranked = hy.rank(scored(spark, folder), ["project_id"])
    return ranked.select("hypothesis_id", "composite", "rank", sc.band(F.col("composite")).alias("band"))


@registry.add(f"""WITH {SCORED},
w AS (SELECT n_nationkey AS weighting_id, n_nationkey * 4 AS wn, 25 AS wv, n_regionkey AS wf, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 10 END AS wr FROM nation),
c AS (SELECT weighting_id, project_id, hypothesis_id, {_composite('wn', 'wv', 'wf', 'coalesce(wr, 0.20)')} AS composite FROM h, w)
SELECT weighting_id, hypothesis_id, composite, row_number() OVER (PARTITION BY weighting_id, project_id ORDER BY composite DESC, hypothesis_id) AS rank FROM c""")
def what_if_weights(spark, folder):
    weights = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("weighting_id"), (F.col("n_nationkey") * 4).alias("novelty"), F.lit(25).alias("value"),
        F.col("n_regionkey").alias("feasibility"), F.when(F.col("n_nationkey") % 5 != 0, 10).alias("risk"))
    ranked = hy.rank(scored(spark, folder), ["project_id"], weights)
    return ranked.select("weighting_id", "hypothesis_id", "composite", "rank")


@registry.add(f"""WITH {RANKED} SELECT hypothesis_id, row_number() OVER (PARTITION BY project_id
  ORDER BY coalesce(eff_value, 0) DESC, composite DESC, hypothesis_id) AS place FROM ranked""")
def axis_sort(spark, folder):
    ranked = hy.rank(scored(spark, folder), ["project_id"])
    return hy.sort_by_axis(ranked, ["project_id"], "value").select("hypothesis_id", "place")


_SUMMARY_SQL = f"""SELECT project_id, count(*) AS total, count(*) FILTER (WHERE status = 'accepted') AS confirmed,
  count(*) FILTER (WHERE status = 'rejected') AS refuted, count(*) FILTER (WHERE status = 'review') AS review,
  count(*) FILTER (WHERE status = 'proposed') AS proposed, {half_up('avg(composite)', 1)} AS avg_composite,
  count(*) FILTER (WHERE eff_value >= 70) AS high_value_count, first(statement ORDER BY rank) AS top_statement, first(composite ORDER BY rank) AS top_composite
FROM ranked GROUP BY project_id"""


@registry.add(f"WITH {RANKED} {_SUMMARY_SQL}")
def report_summary(spark, folder):
    return hy.report_summary(hy.rank(scored(spark, folder), ["project_id"]), ["project_id"])


_BUCKETS = f"""{SCORED},
b AS (SELECT project_id, hypothesis_id, CASE WHEN status = 'accepted' THEN 'confirmed' WHEN status = 'rejected' THEN 'refuted'
        WHEN status = 'review' OR note IS NOT NULL THEN 'reviewed' END AS bucket, statement, coalesce(note, '') AS note, created_at FROM h),
fb AS (SELECT *, row_number() OVER (PARTITION BY project_id, bucket ORDER BY created_at DESC, hypothesis_id DESC) AS n FROM b WHERE bucket IS NOT NULL)"""


@registry.add(f"WITH {_BUCKETS} SELECT project_id, bucket, n, coalesce(statement, '') AS statement, note FROM fb")
def feedback_buckets(spark, folder):
    return hy.feedback(scored(spark, folder)).select("project_id", "bucket", "n", "statement", "note")


_FB_TEXT = f"""blk AS (SELECT project_id, '{hy.FEEDBACK_TITLE}' || string_agg(chr(10) || heading || t, '' ORDER BY heading_no) || chr(10) || chr(10) AS feedback FROM (
  SELECT project_id, CASE bucket WHEN 'confirmed' THEN 1 WHEN 'refuted' THEN 2 ELSE 3 END AS heading_no,
    CASE bucket WHEN 'confirmed' THEN '{hy.FEEDBACK[0][1]}' WHEN 'refuted' THEN '{hy.FEEDBACK[1][1]}' ELSE '{hy.FEEDBACK[2][1]}' END AS heading,
    string_agg(chr(10) || '  • ' || coalesce(statement, '') || CASE WHEN note <> '' THEN ' — эксперт: ' || note ELSE '' END, '' ORDER BY n) AS t
  FROM fb GROUP BY project_id, bucket) GROUP BY project_id)"""


@registry.add(f"WITH {_BUCKETS}, {_FB_TEXT} SELECT project_id, feedback FROM blk")
def feedback_block(spark, folder):
    return hy.feedback_block(hy.feedback(scored(spark, folder)))


def _answers(spark, folder):
    """Every benchmark text as the statement of a model answer in one of several shapes."""
    n = F.col("item_id")
    one = F.struct(
        F.when(n % 6 != 5, F.col("text")).otherwise(" ").alias("statement"), F.lit("goal").alias("goal_link"),
        F.array(F.lit("t1"), F.lit("t2")).alias("tags"), (n * 9 - 20).alias("novelty"), F.concat(n.cast("string"), F.lit(".5")).alias("value"),
        F.lit("high").alias("feasibility"),
        F.array(F.struct(F.concat(F.lit("[s"), (n % 4 + 1).cast("string"), F.lit("]")).alias("source_id"), F.lit("own").alias("title"), F.col("text").alias("snippet")),
                F.struct(F.lit("S99").alias("source_id"), F.lit("own").alias("title"), F.lit("x").alias("snippet"))).alias("evidence"))
    many = F.to_json(F.struct(F.array(one, one).alias("hypotheses")))
    alone = F.to_json(F.struct(F.array().cast("array<string>").alias("hypotheses"), one.alias("data")))
    content = (F.when(n % 4 == 0, F.concat(F.lit("```json\n"), many, F.lit("\n```"))).when(n % 4 == 1, alone)
               .when(n % 4 == 2, F.concat(F.lit("Sure: "), many, F.lit(" done"))).otherwise("no json here"))
    return table(spark, folder, "benchmark").select(n.alias("run_id"), (n % 10).alias("project_id"), content.alias("content"))


_ANSWERS = r"""
a AS (SELECT item_id AS run_id, text, unnest(range(CASE WHEN item_id % 4 = 1 THEN 1 ELSE 2 END)) AS position FROM benchmark WHERE item_id % 4 <> 3),
hyp AS (SELECT run_id, position, regexp_replace(text, '^\s+|\s+$', '', 'g') AS statement, greatest(0, least(100, run_id * 9 - 20))::DOUBLE AS novelty,
          least(100, run_id + 0.5)::DOUBLE AS value, 0::DOUBLE AS feasibility, 0::DOUBLE AS risk, text FROM a WHERE run_id % 6 <> 5)"""


@registry.add(f"""WITH {_ANSWERS} SELECT run_id, position, statement, novelty, value, feasibility, risk, NULL AS error FROM hyp
UNION ALL SELECT item_id, NULL, NULL, NULL, NULL, NULL, NULL, 'unreadable model answer' FROM benchmark WHERE item_id % 4 = 3""")
def response_hypotheses(spark, folder):
    answers = _answers(spark, folder)
    good = hy.parse_responses(answers).select("run_id", "position", "statement", *vocab.AXES)
    return good.unionByName(hy.run_errors(answers).select("run_id", "error"), allowMissingColumns=True)


@registry.add(f"""WITH {_ANSWERS},
s AS (SELECT p_partkey, 'document:' || p_partkey AS source_key, p_name FROM part)
SELECT run_id, position, 0 AS place, CASE WHEN p_partkey IS NULL THEN 'lib:' || run_id ELSE source_key END AS source_key, p_partkey AS source_id, coalesce(p_name, 'own') AS title
FROM hyp LEFT JOIN s ON p_partkey = CASE WHEN run_id % 3 = 0 THEN -1 ELSE run_id + run_id % 4 + 1 END
UNION ALL SELECT run_id, position, 1, NULL, NULL, 'own' FROM hyp""")
def evidence_resolution(spark, folder):
    n = F.col("item_id")
    ids = table(spark, folder, "benchmark").select(n.alias("run_id"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k")).select(
        "run_id", F.concat(F.lit("S"), F.col("k").cast("string")).alias("sid"),
        F.when(F.col("run_id") % 3 == 0, F.concat(F.lit("lib:"), F.col("run_id").cast("string")))
        .otherwise(F.concat(F.lit("document:"), (F.col("run_id") + F.col("k")).cast("string"))).alias("source_key"))
    sources = table(spark, folder, "part").select(
        F.concat(F.lit("document:"), F.col("p_partkey").cast("string")).alias("source_key"), F.lit("document").alias("source_kind"),
        F.col("p_partkey").alias("source_id"), F.col("p_name").alias("title"))
    found = hy.resolve_evidence(hy.parse_responses(_answers(spark, folder)), ids, sources)
    return found.select("run_id", "position", F.col("place").cast("int").alias("place"), "source_key", "source_id", "title")


@registry.add(f"""
SELECT c_custkey AS project_id, CASE WHEN c_custkey % 3 = 0 THEN 'model' WHEN c_custkey % 3 = 1 AND c_custkey % 5 > 0 THEN 'expert' ELSE 'default' END AS weight_mode,
  CASE WHEN c_custkey % 3 = 0 THEN {half_up('(1 + c_custkey % 7) / (4.0 + c_custkey % 7)', 3)} WHEN c_custkey % 3 = 1 AND c_custkey % 5 > 0 THEN 0.0 ELSE 0.25 END AS novelty,
  CASE WHEN c_custkey % 3 = 0 THEN {half_up('3 / (4.0 + c_custkey % 7)', 3)} WHEN c_custkey % 3 = 1 AND c_custkey % 5 > 0 THEN 1.0 ELSE 0.3 END AS value
FROM customer""")
def weight_modes(spark, folder):
    n = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(
        n.alias("project_id"), F.when(n % 3 == 0, "model").alias("mode"),
        F.concat(F.lit('{"novelty": '), (1 + n % 7).cast("string"), F.lit(', "value": 3, "risk": -4}')).alias("suggested"),
        F.when(n % 3 == 1, F.when(n % 5 > 0, F.lit('{"value": 2.5, "novelty": 0}')).otherwise("not json")).alias("expert"))
    return hy.resolve_weights(rows).select("project_id", "weight_mode", "novelty", "value")


@registry.add("""
SELECT p_partkey, replace(regexp_replace(CASE WHEN p_size % 100 = 0 THEN '0,00' ELSE '0,' || lpad(CAST(p_size AS VARCHAR), 2, '0') END, ',?0+$', ''), '', '')
  || ' × новизна + 0,5 × ценность + 1 × реализуемость + 0,05 × (100 - риск)' AS formula FROM part""")
def rank_formula(spark, folder):
    weights = {"novelty": F.col("p_size"), "value": F.lit(50), "feasibility": F.lit(100), "risk": F.lit(5)}
    return table(spark, folder, "part").select("p_partkey", sc.formula_text(weights).alias("formula"))


@registry.add(f"""WITH {RANKED} SELECT project_id, rank, composite, status, statement, coalesce(goal_link, '') AS goal_link, coalesce(mechanism, '') AS mechanism,
  coalesce(validation, '') AS validation, novelty, eff_value AS value, feasibility, risk,
  CASE WHEN note IS NULL THEN '' ELSE ' ' || note END AS expert_notes, lang || ', ' || source AS tags,
  source || CASE WHEN hypothesis_id % 2 = 0 THEN '; B' ELSE '' END AS sources FROM ranked""")
def export_csv(spark, folder):
    ranked = hy.rank(scored(spark, folder), ["project_id"])
    return hy.csv_rows(ranked, ["project_id"])


def _md(label, column):
    return f"CASE WHEN coalesce({column}, '') <> '' THEN '**{label}:** ' || {column} || chr(10) || chr(10) ELSE '' END"


@registry.add(f"""WITH {RANKED} SELECT project_id, rank, '## ' || rank || '. ' || coalesce(statement, '') || chr(10) || chr(10) ||
  '**Ранг:** ' || composite || ' · **Статус:** ' || CASE status WHEN 'proposed' THEN 'Новая' WHEN 'review' THEN 'На проверке'
     WHEN 'accepted' THEN 'Подтверждена экспертом' ELSE 'Опровергнута экспертом' END || chr(10) || chr(10) ||
  {_md('Связь с целью', 'goal_link')} || {_md('Механизм', 'mechanism')} || {_md('План проверки', 'validation')} || {_md('Отзыв эксперта', "(' ' || note)")} ||
  '**Оценки:** новизна ' || coalesce(CAST(novelty AS VARCHAR), 'None') || ', ценность ' || coalesce(CAST(eff_value AS VARCHAR), 'None') ||
  ', реализуемость ' || coalesce(CAST(feasibility AS VARCHAR), 'None') || ', риск ' || coalesce(CAST(risk AS VARCHAR), 'None') || chr(10) || chr(10) || '---' || chr(10) AS block
FROM ranked""")
def export_markdown(spark, folder):
    return hy.markdown_blocks(hy.rank(scored(spark, folder), ["project_id"]))


@registry.add(f"""WITH {RANKED} SELECT project_id, rank, statement, composite, source || CASE WHEN hypothesis_id % 2 = 0 THEN ',B' ELSE '' END AS sources,
   eff_value AS value FROM ranked""")
def export_json(spark, folder):
    rows = hy.json_rows(hy.rank(scored(spark, folder), ["project_id"]))
    parsed = F.from_json("json", "statement string, composite double, sources array<string>, scores struct<value:double>")
    return rows.select("project_id", "rank", parsed.alias("j")).select(
        "project_id", "rank", "j.statement", "j.composite", F.array_join("j.sources", ",").alias("sources"), "j.scores.value")


@registry.add("""
SELECT doc_id AS hypothesis_id, CASE WHEN doc_id % 5 = 1 THEN 'accepted' ELSE ['proposed', 'review', 'accepted', 'rejected'][doc_id % 4 + 1] END AS status,
  CASE WHEN doc_id % 5 = 2 THEN NULL WHEN doc_id % 7 = 0 THEN ' note ' || doc_id END AS expert_notes,
  CASE doc_id % 5 WHEN 3 THEN 100.0 WHEN 4 THEN NULL ELSE CASE WHEN doc_id % 4 = 0 THEN doc_id % 90 END END::DOUBLE AS value,
  CASE WHEN doc_id % 5 = 3 THEN 0.0 END::DOUBLE AS novelty FROM documents""")
def hypothesis_patch(spark, folder):
    base = scored(spark, folder)
    n = F.col("hypothesis_id") % 5
    none = F.lit(None).cast("string")
    patches = base.select(
        "hypothesis_id",
        F.when(n == 0, F.create_map(F.lit("status"), F.lit("unknown"))).when(n == 1, F.create_map(F.lit("status"), F.lit("accepted")))
        .when(n == 2, F.create_map(F.lit("expert_notes"), none)).alias("patch"),
        F.when(n == 3, F.create_map(F.lit("value"), F.lit(170.0), F.lit("novelty"), F.lit(-1.0), F.lit("other"), F.lit(5.0)))
        .when(n == 4, F.create_map(F.lit("value"), F.lit(None).cast("double"))).alias("expert_scores"))
    out = catalog.patch_hypotheses(base, patches)
    return out.select("hypothesis_id", "status", "expert_notes", F.try_element_at("expert_scores", F.lit("value")).alias("value"),
                      F.try_element_at("expert_scores", F.lit("novelty")).alias("novelty"))


def _items(spark, folder):
    items, _ = retrieve.retrieve(search._library(spark, folder), search._goals(spark, folder), search._responses(spark, folder))
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("pid"), F.col("text").alias("passage"), F.col("lang").alias("authors"))
    n = F.col("pid")
    return items.join(docs, "pid").select(
        "*", F.concat(F.lit("Document "), n.cast("string")).alias("title"), F.when(n % 2 == 0, "report").otherwise("memo").alias("source_type"),
        F.when(n % 3 == 0, 2001).alias("year"), F.when(n % 2 == 0, "manual").otherwise("upload").alias("origin"),
        F.lit(None).cast("string").alias("section_title"), F.when(n % 5 == 0, "7").alias("page_ref"))


CONTEXT = f"""{search._PAIRS},
line AS (SELECT i.*, '[S' || final_rank || '] Document ' || pid || ' (' || concat_ws(' · ', CASE WHEN pid % 2 = 0 THEN 'отчёт' ELSE 'memo' END,
    CASE WHEN pid % 3 = 0 THEN '2001' END, d.lang, CASE WHEN pid % 2 = 1 THEN 'источник: upload' END, CASE WHEN pid % 5 = 0 THEN 'страница/лист: 7' END)
  || ')' || chr(10) || '    ' || CASE WHEN rerank IS NOT NULL THEN 'реранк=' || printf('%.3f', rerank) ELSE 'гибрид=' || round(hybrid, 6) END
  || '; совпавшие термины: ' || replace(terms, ',', ', ') || chr(10) || '    ' || text AS line
  FROM items i JOIN documents d ON d.doc_id = i.pid),
ctx AS (SELECT query_id, string_agg(line, chr(10) || chr(10) ORDER BY final_rank) AS context FROM line GROUP BY query_id)"""


@registry.add(f"WITH {CONTEXT} SELECT query_id, context FROM ctx")
def context_block(spark, folder):
    return context.context_blocks(_items(spark, folder))


@registry.add(f"""WITH {CONTEXT} SELECT query_id, count(*) AS n, string_agg(source_key || '=' || score || '/' || terms, '|' ORDER BY final_rank) AS log FROM line GROUP BY query_id""")
def retrieval_log(spark, folder):
    log = context.retrieval_log(_items(spark, folder))
    text = F.array_join(F.transform("retrieved", lambda r: F.concat(r["source_key"], F.lit("="), r["score"].cast("string"), F.lit("/"), F.array_join(r["terms"], ","))), "|")
    return log.select("query_id", F.size("retrieved").cast("long").alias("n"), text.alias("log"))


_REQUEST_PARTS = dict(rules=context.TASK_RULES, guide=context.SCORE_GUIDE, rule=context.FEEDBACK_RULE, empty=context.EMPTY_BASE)


@registry.add(f"""WITH {CONTEXT}, {_BUCKETS.replace('h AS (', 'h AS (', 1)}, {_FB_TEXT},
pj AS (SELECT doc_id, source, lang FROM documents)
SELECT doc_id AS project_id, md5('ЦЕЛЬ И КОНТЕКСТ ПРОЕКТА
Проект: P' || doc_id || '
Цель (KPI): goal
Метрика: ' || lang || ' (направление: ' || CASE WHEN doc_id % 2 = 0 THEN 'увеличить' ELSE 'снизить' END || ')
Область: материаловедение
Ограничения/ресурсы: не заданы
' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'ТЕМА/ФОКУС ЗАПРОСА: topic' || chr(10) ELSE '' END || '
БАЗА ЗНАНИЙ (RAG: TF-IDF отбор → переранжирование кросс-энкодером)
' || coalesce(context, '{_REQUEST_PARTS['empty']}') || '

' || coalesce(feedback, '') || 'ЗАДАЧА
Сгенерируй 5 РАЗНООБРАЗНЫХ, взаимодополняющих и проверяемых научных гипотез для достижения цели.
{_REQUEST_PARTS['rules']}' || CASE WHEN feedback IS NOT NULL THEN '{_REQUEST_PARTS['rule']}' ELSE '' END || '
{_REQUEST_PARTS['guide']}
') AS request
FROM pj LEFT JOIN ctx ON query_id = doc_id LEFT JOIN (SELECT replace(project_id, 'src', '') AS k, feedback FROM blk) b ON b.k = CAST(doc_id AS VARCHAR)""")
def prompt_table(spark, folder):
    """One request per document taken as a project; the first few have feedback."""
    n = F.col("doc_id")
    projects = table(spark, folder, "documents").select(
        n.alias("project_id"), F.concat(F.lit("P"), n.cast("string")).alias("title"), F.lit("goal").alias("kpi_target"),
        F.col("lang").alias("kpi_metric"), F.when(n % 2 == 1, "decrease").alias("kpi_direction"), F.lit("").alias("domain"),
        F.lit(None).cast("string").alias("constraints"), F.when(n % 3 == 0, "topic").alias("topic"))
    notes = hy.feedback_block(hy.feedback(scored(spark, folder)))
    notes = notes.select(F.replace("project_id", F.lit("src"), F.lit("")).try_cast("long").alias("project_id"), "feedback")
    ctx = context.context_blocks(_items(spark, folder))
    return context.generation_requests(projects, ctx, notes).select("project_id", F.md5("request").alias("request"))


@registry.add(f"""WITH {RANKED} SELECT hypothesis_id AS id, rank, composite, statement, goal_link, eff_value, value, risk, note AS expert_notes FROM ranked WHERE status = 'review'""")
def hypothesis_list(spark, folder):
    rows = hy.listing(hy.rank(scored(spark, folder), ["project_id"]), "review")
    return rows.select("id", "rank", "composite", "statement", "goal_link", F.col("effective_scores.value").alias("eff_value"), F.col("scores.value").alias("value"),
                       F.col("scores.risk").alias("risk"), F.trim("expert_notes").alias("expert_notes"))


@registry.add(f"""WITH {RANKED}, s AS ({_SUMMARY_SQL})
SELECT project_id, total + 2 AS lines, total, confirmed, avg_composite, top_statement, 'P ' || project_id AS title, 0.3::DOUBLE AS value_weight,
  total AS listed, (total * (total + 1)) // 2 AS rank_sum FROM s""")
def export_report(spark, folder):
    """The head and list of every project's JSON report, read back from its lines."""
    ranked = hy.rank(scored(spark, folder), ["project_id"])
    projects = ranked.select("project_id").distinct().withColumn("title", F.concat(F.lit("P "), "project_id"))
    lines = hy.report_lines(ranked, projects)
    body = F.when(F.col("rank") == 0, F.concat("line", F.lit("]}"))).when(F.col("line") != "]}", F.regexp_replace("line", r",\\z", ""))
    read = F.from_json(body, "project struct<title:string>, ranking_weights struct<value:double>, summary struct<total:long,confirmed:long,avg_composite:double,top_statement:string>, rank long, hypotheses array<string>")
    rows = lines.withColumn("j", read)
    return rows.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("lines"), F.max("j.summary.total").alias("total"), F.max("j.summary.confirmed").alias("confirmed"),
        F.max("j.summary.avg_composite").alias("avg_composite"), F.max("j.summary.top_statement").alias("top_statement"), F.max("j.project.title").alias("title"),
        F.max("j.ranking_weights.value").alias("value_weight"), F.count("j.rank").alias("listed"), F.sum("j.rank").alias("rank_sum"))
