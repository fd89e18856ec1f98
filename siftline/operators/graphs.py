"""Evidence graphs. All nodes and edges of a hypothesis come from its own row, so the
graphs of any number of hypotheses are built without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx

# How many evidence and tag nodes a graph shows, and the edge labels.
SHOWN = 4
EDGE_LABELS = {
    "targets": "Направлена на цель", "produces": "Даёт ожидаемый эффект", "explains": "Объясняет механизм",
    "tests": "Проверяется через план", "threatens": "Создаёт неопределённость", "limits": "Ограничивает эксперимент",
    "supports": "Поддерживает гипотезу", "describes": "Описывает тему",
}
# Fallback texts.
NO_STATEMENT = "Гипотеза без формулировки"
NO_RATIONALE = "Центральная идея гипотезы и точка сборки всей дорожной карты."
NO_RISK_TEXT = "Для этой гипотезы модель оценила риск, но не дала отдельное текстовое пояснение."
NO_SNIPPET = "Источник использовался как supporting context для гипотезы."
NO_SCORE = "Источник попал в retrieval-контекст последнего запуска."
TAG_TEXT = "Тематический маркер гипотезы для дальнейшей группировки и связей между гипотезами."


def _shorten(c: Column, limit: int) -> Column:
    return tx.cut(c, limit, limit - 1, "…")


def _or(c: Column, other: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(other))


def prepare(hypotheses: DataFrame) -> DataFrame:
    """One row per hypothesis with collapsed texts and its evidence entries.

    hypotheses: hypothesis_id, statement, rationale, mechanism, goal_link, value_rationale,
    validation, risk_rationale, scores value/feasibility/risk, composite, tags, evidence
    array<struct<title,snippet,relevance,source_id>>, the project's kpi_target and
    constraints, and retrieved array<struct<title,score,terms,source_id>> of the latest
    run, which stands in where a hypothesis cites nothing.
    """
    h = F.col("hypothesis_id").cast("string")

    def place(i):
        return F.concat(F.lit("Источник "), (i + 1).cast("string"))

    def own(e, i):
        title = F.coalesce(F.nullif(tx.collapse(e["title"]), F.lit("")), place(i))
        text = F.coalesce(F.nullif(tx.collapse(e["snippet"]), F.lit("")), F.nullif(tx.collapse(e["relevance"]), F.lit("")), F.lit(NO_SNIPPET))
        return F.struct(title.alias("title"), text.alias("description"))

    def fallback(e, i):
        title = F.coalesce(F.nullif(tx.collapse(e["title"]), F.lit("")), place(i))
        text = F.concat_ws(" • ", F.when(e["score"].isNotNull(), F.format_string("score %.3f", e["score"])),
                           F.nullif(F.array_join(F.filter(e["terms"], lambda t: t != ""), ", "), F.lit("")))
        return F.struct(title.alias("title"), _or(text, NO_SCORE).alias("description"))

    cited = F.coalesce(F.size("evidence") > 0, F.lit(False))
    empty = F.array().cast("array<struct<title:string,description:string>>")
    items = F.when(cited, F.transform("evidence", own)).otherwise(
        F.coalesce(F.transform(F.slice("retrieved", 1, SHOWN + 2), fallback), empty))
    impact = F.coalesce(F.nullif(F.col("goal_link"), F.lit("")), F.col("value_rationale"))
    tags = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    return hypotheses.select(
        "hypothesis_id", h.alias("_h"), tx.collapse(F.col("statement")).alias("statement"),
        F.coalesce(F.nullif(tx.collapse(F.col("rationale")), F.lit("")), F.nullif(tx.collapse(F.col("mechanism")), F.lit("")), F.lit(NO_RATIONALE)).alias("about"),
        tx.collapse(F.col("mechanism")).alias("mechanism"), tx.collapse(impact).alias("impact"),
        tx.collapse(F.col("validation")).alias("validation"), tx.collapse(F.col("risk_rationale")).alias("risk_text"),
        tx.collapse(F.col("kpi_target")).alias("goal"), tx.collapse(F.col("constraints")).alias("constraints"),
        F.round("composite").alias("composite"), F.round("value").alias("value"), F.round("feasibility").alias("feasibility"),
        F.round("risk").alias("risk"), items.alias("items"), tags.alias("tags"))


def _id(kind: str, suffix: Column | None = None) -> Column:
    parts = [F.lit(kind + "-"), F.col("_h")]
    return F.concat(*parts, F.lit("-"), suffix) if suffix is not None else F.concat(*parts)


def _has_risk() -> Column:
    return (F.col("risk_text") != "") | F.col("risk").isNotNull()


def nodes(prepared: DataFrame) -> DataFrame:
    """hypothesis_id, node_id, type, label, short_label, description, score."""
    def node(kind, node_id, label, short, description, score=None):
        return F.struct(node_id.alias("node_id"), F.lit(kind).alias("type"), label.alias("label"), short.alias("short_label"),
                        description.alias("description"), (F.lit(None) if score is None else score).cast("double").alias("score"))

    def fixed(kind, label, text, score=None):
        return node(kind, _id(kind), F.lit(label), F.lit(label), text, score)

    c = F.col
    single = F.array(
        node("hypothesis", _id("hypothesis"), _or(c("statement"), NO_STATEMENT), _or(_shorten(c("statement"), 92), NO_STATEMENT), c("about"), c("composite")),
        F.when(c("goal") != "", fixed("goal", "Цель / KPI", c("goal"))),
        F.when(c("impact") != "", fixed("impact", "Ожидаемый эффект", c("impact"), c("value"))),
        F.when(c("mechanism") != "", fixed("mechanism", "Механизм", c("mechanism"))),
        F.when(c("validation") != "", fixed("validation", "План проверки", c("validation"), c("feasibility"))),
        F.when(c("constraints") != "", fixed("constraint", "Ограничения", c("constraints"))),
        F.when(_has_risk(), node(
            "risk", _id("risk"), F.lit("Риски"),
            F.coalesce(F.concat(F.lit("Риск "), c("risk").cast("int").cast("string"), F.lit("/100")), F.lit("Риски")), _or(c("risk_text"), NO_RISK_TEXT), c("risk"))))
    shown = F.transform(F.slice("items", 1, SHOWN), lambda e, i: node(
        "evidence", _id("evidence", i.cast("string")), e["title"], _shorten(e["title"], 32), e["description"]))
    tags = F.transform(F.slice("tags", 1, SHOWN), lambda t, i: node(
        "tag", _id("tag", i.cast("string")), tx.collapse(t), _shorten(tx.collapse(t), 22), F.lit(TAG_TEXT)))

    def more(kind, column, unit, rest):
        count = F.size(column) - SHOWN
        label = F.concat(F.lit("+"), count.cast("string"), F.lit(" " + unit))
        return F.when(count > 0, F.array(node(kind, _id(kind, F.lit("more")), label, label, rest))).otherwise(F.array().cast(
            "array<struct<node_id:string,type:string,label:string,short_label:string,description:string,score:double>>"))

    hidden = F.array_join(F.transform(F.slice("items", SHOWN + 1, 2**30), lambda e: e["title"]), " • ")
    hidden_tags = F.array_join(F.slice("tags", SHOWN + 1, 2**30), " • ")
    everything = F.concat(F.filter(single, lambda n: n.isNotNull()), shown, more("evidence", "items", "источника", hidden),
                          tags, more("tag", "tags", "тегов", hidden_tags))
    return prepared.select("hypothesis_id", F.explode(everything).alias("n")).select("hypothesis_id", "n.*")


def edges(prepared: DataFrame) -> DataFrame:
    """hypothesis_id, source, target, type, label."""
    def edge(source, target, kind):
        return F.struct(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), F.lit(EDGE_LABELS[kind]).alias("label"))

    c, me = F.col, _id("hypothesis")
    plan = c("validation") != ""
    single = F.array(
        F.when(c("goal") != "", edge(me, _id("goal"), "targets")),
        F.when(c("impact") != "", edge(me, _id("impact"), "produces")),
        F.when(c("mechanism") != "", edge(_id("mechanism"), me, "explains")),
        F.when(plan, edge(_id("validation"), me, "tests")),
        F.when(c("constraints") != "", edge(_id("constraint"), F.when(plan, _id("validation")).otherwise(me), "limits")),
        F.when(_has_risk(), edge(_id("risk"), me, "threatens")))

    def many(column, kind, relation):
        shown = F.transform(F.slice(column, 1, SHOWN), lambda e, i: edge(_id(kind, i.cast("string")), me, relation))
        rest = F.when(F.size(column) > SHOWN, F.array(edge(_id(kind, F.lit("more")), me, relation)))
        return F.concat(shown, F.coalesce(rest, F.array().cast("array<struct<source:string,target:string,type:string,label:string>>")))

    everything = F.concat(F.filter(single, lambda e: e.isNotNull()), many("items", "evidence", "supports"), many("tags", "tag", "describes"))
    return prepared.select("hypothesis_id", F.explode(everything).alias("e")).select("hypothesis_id", "e.*")


def both_directions(edge_rows: DataFrame) -> DataFrame:
    """hypothesis_id, node_id, neighbour, type: every edge seen from both ends, from one scan."""
    ends = F.array(F.struct(F.col("source").alias("node_id"), F.col("target").alias("neighbour")),
                   F.struct(F.col("target").alias("node_id"), F.col("source").alias("neighbour")))
    return edge_rows.select("hypothesis_id", "type", F.explode(ends).alias("e")).select("hypothesis_id", "e.*", "type")


def adjacency(edge_rows: DataFrame) -> DataFrame:
    """hypothesis_id, node_id, neighbours (sorted). A graph has at most 17 nodes."""
    return both_directions(edge_rows).groupBy("hypothesis_id", "node_id").agg(
        F.array_sort(F.collect_set("neighbour")).alias("neighbours"))


def neighbours(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Every node with each edge and the node at its other end."""
    other = node_rows.select("hypothesis_id", F.col("node_id").alias("neighbour"), F.col("label").alias("neighbour_label"),
                             F.col("type").alias("neighbour_type"))
    return both_directions(edge_rows).join(other, ["hypothesis_id", "neighbour"])
