"""Evidence graphs of hypotheses."""

from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.operators import graphs
from . import Registry, table
from .hypotheses import SCORED, _composite
from .sqltext import collapse
from siftline.operators import hypotheses as hy

registry = Registry()


def _prepared(spark, folder):
    """Documents as hypotheses; lines of the text are evidence and every third one has none."""
    from .hypotheses import scored

    ranked = hy.rank(scored(spark, folder), ["project_id"])
    n = F.col("hypothesis_id")
    lines = F.filter(F.transform(F.split("text", "\n"), tx.collapse), lambda x: x != "")
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("hypothesis_id"), lines.alias("lines"), F.split(tx.collapse(F.col("text")), " ").alias("words"))
    none = F.lit(None).cast("string")
    cited = F.transform("lines", lambda x: F.struct(x.alias("title"), F.substring(x, 1, 10).alias("snippet"), none.alias("relevance"), none.alias("source_id")))
    log = F.transform("lines", lambda x: F.struct(x.alias("title"), F.length(x).cast("double").alias("score"), F.array(F.lit("t")).alias("terms"), none.alias("source_id")))
    rows = ranked.join(docs, "hypothesis_id").select(
        "hypothesis_id", "statement", "rationale", "mechanism", "goal_link", F.lit("gain").alias("value_rationale"), "validation",
        F.when(n % 2 == 0, "risky").alias("risk_rationale"), "value", "feasibility", "risk", "composite", F.col("words").alias("tags"),
        F.when(n % 3 > 0, cited).alias("evidence"), log.alias("retrieved"), F.when(n % 4 > 0, "goal").alias("kpi_target"),
        F.when(n % 5 < 2, "limits").alias("constraints"))
    return graphs.prepare(rows)


_BASE = f"""{SCORED},
g AS (SELECT h.*, {_composite()} AS composite, CAST(hypothesis_id AS VARCHAR) AS i, 'hypothesis-' || hypothesis_id AS me,
   list_filter(list_transform(string_split(d.text, chr(10)), lambda x: {collapse('x')}), lambda x: x <> '') AS lines,
   list_filter(string_split({collapse('d.text')}, ' '), lambda x: x <> '') AS words
  FROM h JOIN documents d ON d.doc_id = hypothesis_id),
ev AS (SELECT *, CASE WHEN hypothesis_id % 3 > 0 THEN lines ELSE lines[:6] END AS items FROM g),
e0 AS (
  SELECT hypothesis_id, me AS source, 'goal-' || i AS target, 'targets' AS type FROM ev WHERE hypothesis_id % 4 > 0
  UNION ALL SELECT hypothesis_id, me, 'impact-' || i, 'produces' FROM ev
  UNION ALL SELECT hypothesis_id, 'mechanism-' || i, me, 'explains' FROM ev WHERE mechanism IS NOT NULL
  UNION ALL SELECT hypothesis_id, 'validation-' || i, me, 'tests' FROM ev WHERE validation IS NOT NULL
  UNION ALL SELECT hypothesis_id, 'constraint-' || i, CASE WHEN validation IS NOT NULL THEN 'validation-' || i ELSE me END, 'limits' FROM ev WHERE hypothesis_id % 5 < 2
  UNION ALL SELECT hypothesis_id, 'risk-' || i, me, 'threatens' FROM ev WHERE hypothesis_id % 2 = 0 OR risk IS NOT NULL
  UNION ALL SELECT hypothesis_id, 'evidence-' || i || '-' || CASE WHEN k = 4 THEN 'more' ELSE CAST(k AS VARCHAR) END, me, 'supports' FROM (SELECT *, unnest(range(least(len(items), 5))) AS k FROM ev)
  UNION ALL SELECT hypothesis_id, 'tag-' || i || '-' || CASE WHEN k = 4 THEN 'more' ELSE CAST(k AS VARCHAR) END, me, 'describes' FROM (SELECT *, unnest(range(least(len(words), 5))) AS k FROM ev)),
dir AS (SELECT hypothesis_id, source AS node_id, target AS neighbour, type FROM e0 UNION ALL SELECT hypothesis_id, target, source, type FROM e0)"""


def _short(x, n):
    return f"CASE WHEN length({x}) > {n} THEN rtrim(substr({x}, 1, {n - 1})) || '…' ELSE {x} END"


_NODES = f"""
nd AS (
  SELECT hypothesis_id, me AS node_id, 'hypothesis' AS type, coalesce(statement, '{graphs.NO_STATEMENT}') AS label, {_short(f"coalesce(statement, '{graphs.NO_STATEMENT}')", 92)} AS short_label,
     'why' AS description, round(composite) AS score FROM ev
  UNION ALL SELECT hypothesis_id, 'goal-' || i, 'goal', 'Цель / KPI', 'Цель / KPI', 'goal', NULL FROM ev WHERE hypothesis_id % 4 > 0
  UNION ALL SELECT hypothesis_id, 'impact-' || i, 'impact', 'Ожидаемый эффект', 'Ожидаемый эффект', coalesce(goal_link, 'gain'), value FROM ev
  UNION ALL SELECT hypothesis_id, 'mechanism-' || i, 'mechanism', 'Механизм', 'Механизм', mechanism, NULL FROM ev WHERE mechanism IS NOT NULL
  UNION ALL SELECT hypothesis_id, 'validation-' || i, 'validation', 'План проверки', 'План проверки', validation, feasibility FROM ev WHERE validation IS NOT NULL
  UNION ALL SELECT hypothesis_id, 'constraint-' || i, 'constraint', 'Ограничения', 'Ограничения', 'limits', NULL FROM ev WHERE hypothesis_id % 5 < 2
  UNION ALL SELECT hypothesis_id, 'risk-' || i, 'risk', 'Риски', CASE WHEN risk IS NULL THEN 'Риски' ELSE 'Риск ' || CAST(risk AS INT) || '/100' END,
     CASE WHEN hypothesis_id % 2 = 0 THEN 'risky' ELSE '{graphs.NO_RISK_TEXT}' END, risk FROM ev WHERE hypothesis_id % 2 = 0 OR risk IS NOT NULL
  UNION ALL SELECT hypothesis_id, 'evidence-' || i || '-' || k, 'evidence', items[k + 1], {_short('items[k + 1]', 32)},
     CASE WHEN hypothesis_id % 3 > 0 THEN trim(substr(items[k + 1], 1, 10)) ELSE 'score ' || length(items[k + 1]) || '.000 • t' END, NULL
     FROM (SELECT *, unnest(range(least(len(items), 4))) AS k FROM ev)
  UNION ALL SELECT hypothesis_id, 'evidence-' || i || '-more', 'evidence', '+' || (len(items) - 4) || ' источника', '+' || (len(items) - 4) || ' источника',
     array_to_string(items[5:], ' • '), NULL FROM ev WHERE len(items) > 4
  UNION ALL SELECT hypothesis_id, 'tag-' || i || '-' || k, 'tag', words[k + 1], {_short('words[k + 1]', 22)}, '{graphs.TAG_TEXT}', NULL
     FROM (SELECT *, unnest(range(least(len(words), 4))) AS k FROM ev)
  UNION ALL SELECT hypothesis_id, 'tag-' || i || '-more', 'tag', '+' || (len(words) - 4) || ' тегов', '+' || (len(words) - 4) || ' тегов',
     array_to_string(words[5:], ' • '), NULL FROM ev WHERE len(words) > 4)"""


@registry.add(f"WITH {_BASE}, {_NODES} SELECT hypothesis_id, node_id, type, label, short_label, md5(description) AS description, score FROM nd")
def evidence_nodes(spark, folder):
    return graphs.nodes(_prepared(spark, folder)).withColumn("description", F.md5("description"))


@registry.add(f"WITH {_BASE} SELECT hypothesis_id, source, target, type FROM e0")
def evidence_edges(spark, folder):
    return graphs.edges(_prepared(spark, folder)).drop("label")


@registry.add(f"""WITH {_BASE} SELECT hypothesis_id, node_id, string_agg(neighbour, ',' ORDER BY encode(neighbour)) AS neighbours
FROM (SELECT DISTINCT hypothesis_id, node_id, neighbour FROM dir) GROUP BY ALL""")
def adjacency(spark, folder):
    return graphs.adjacency(graphs.edges(_prepared(spark, folder))).withColumn("neighbours", F.array_join("neighbours", ","))


@registry.add(f"WITH {_BASE}, {_NODES} SELECT d.hypothesis_id, d.node_id, d.type, d.neighbour, n.label AS neighbour_label FROM dir d JOIN nd n ON n.node_id = d.neighbour")
def neighbours(spark, folder):
    prepared = _prepared(spark, folder)
    out = graphs.neighbours(graphs.edges(prepared), graphs.nodes(prepared))
    return out.select("hypothesis_id", "node_id", "type", "neighbour", "neighbour_label")
