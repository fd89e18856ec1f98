"""Hypotheses: from model answers to ranked, explained, exported lists."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import scores as sc, text as tx, vocab
from .ranking import score_rank, top

# Weightings that travel together as one array.
WEIGHTINGS = 1000

_HYPOTHESIS = (
    "struct<statement:string,goal_link:string,rationale:string,mechanism:string,validation:string,"
    "evidence:array<struct<source_id:string,title:string,snippet:string,relevance:string>>,tags:array<string>,"
    "novelty:string,value:string,feasibility:string,risk:string,"
    "novelty_rationale:string,value_rationale:string,feasibility_rationale:string,risk_rationale:string>"
)


def parse_responses(responses: DataFrame) -> DataFrame:
    """responses (run_id, project_id, content) -> one row per hypothesis: run_id,
    project_id, position, the texts, tags, four clamped scores, evidence, status.

    The list may be called hypotheses or data and a single object counts as a list of
    one. Hypotheses without a statement are dropped.
    """
    body = responses.select("run_id", "project_id", tx.salvage_json(F.col("content")).alias("_b"))
    raw = F.coalesce(*[
        F.when(~F.coalesce(F.get_json_object("_b", path), F.lit("")).isin("", "[]", "{}", "null"), F.get_json_object("_b", path))
        for path in ("$.hypotheses", "$.data")])
    listed = F.when(F.startswith(F.ltrim(raw), F.lit("{")), F.concat(F.lit("["), raw, F.lit("]"))).otherwise(raw)
    rows = body.select("run_id", "project_id", F.posexplode(F.from_json(listed, f"array<{_HYPOTHESIS}>")).alias("position", "h"))
    texts = ["goal_link", "rationale", "mechanism", "validation"]
    none = F.array()
    return rows.select(
        "run_id", "project_id", F.col("position").cast("long").alias("position"),
        tx.strip(tx.text_or_empty(F.col("h.statement"))).alias("statement"),
        *[F.col(f"h.{c}").alias(c) for c in texts],
        F.coalesce("h.tags", none.cast("array<string>")).alias("tags"),
        *[sc.clamp(F.col(f"h.{a}")).alias(a) for a in vocab.AXES],
        *[F.col(f"h.{a}_rationale").alias(f"{a}_rationale") for a in vocab.AXES],
        F.coalesce("h.evidence", none.cast("array<struct<source_id:string,title:string,snippet:string,relevance:string>>")).alias("evidence"),
        F.lit("proposed").alias("status"),
    ).filter(F.col("statement") != "")


def run_errors(responses: DataFrame) -> DataFrame:
    """Runs whose answer holds no JSON, with the error they are logged with."""
    return responses.filter(tx.salvage_json(F.col("content")).isNull()).select(
        "run_id", "project_id", F.lit("unreadable model answer").alias("error"))


def resolve_evidence(hypotheses: DataFrame, id_map: DataFrame, sources: DataFrame) -> DataFrame:
    """hypotheses (run_id, position, evidence) -> one row per citation in order, with the
    source it points to. id_map: run_id, sid, source_key; sources: source_key,
    source_kind, source_id, title. An unknown citation keeps its own title."""
    cited = hypotheses.select("run_id", "position", F.posexplode("evidence").alias("place", "e")).withColumn(
        "sid", tx.citation_id(F.col("e.source_id")))
    known = sources.select("source_key", "source_kind", "source_id", F.col("title").alias("_t"))
    return (
        cited.join(id_map, ["run_id", "sid"], "left").join(known, "source_key", "left")
        .select("run_id", "position", F.col("place").cast("long").alias("place"), "source_key", "source_kind", "source_id",
                F.coalesce("_t", "e.title").alias("title"), F.col("e.snippet").alias("snippet"), F.col("e.relevance").alias("relevance"))
    )


def attach_evidence(hypotheses: DataFrame, resolved: DataFrame) -> DataFrame:
    """Put the resolved citations back as an array in their order."""
    fields = ["place", "source_key", "source_kind", "source_id", "title", "snippet", "relevance"]
    lists = resolved.groupBy("run_id", "position").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("evidence"))
    return hypotheses.drop("evidence").join(lists, ["run_id", "position"], "left")


def resolve_weights(projects: DataFrame) -> DataFrame:
    """projects (project_id, mode, suggested json text, expert json text) -> normalized
    weights and the mode that applied: the model's suggestion on request, else the
    expert's weights, else the defaults."""
    expert, model = sc.weights_from_json(F.col("expert")), sc.weights_from_json(F.col("suggested"))
    asked = F.col("mode") == "model"
    given = F.coalesce(F.size(expert) > 0, F.lit(False))
    mode = F.when(asked, "model").when(given, "expert").otherwise("default")
    raw = {a: F.when(mode == "model", F.try_element_at(model, F.lit(a)))
           .when(mode == "expert", F.try_element_at(expert, F.lit(a)))
           .otherwise(F.lit(vocab.DEFAULT_WEIGHTS[a])) for a in vocab.AXES}
    weights = sc.normalize_weights(raw)
    return projects.select("project_id", mode.alias("weight_mode"), *[w.alias(a) for a, w in weights.items()])


def effective_scores(hypotheses: DataFrame) -> DataFrame:
    """Adds eff_<axis>: the expert's score where given."""
    has = "expert_scores" in hypotheses.columns
    return hypotheses.select("*", *[
        (sc.effective(F.try_element_at("expert_scores", F.lit(a)), F.col(a)) if has else F.col(a)).cast("double").alias(f"eff_{a}")
        for a in vocab.AXES])


def rank(hypotheses: DataFrame, keys: list[str], weights: DataFrame | None = None) -> DataFrame:
    """Adds composite and rank per group of ``keys``.

    ``weights`` (weighting_id, four weights) is a small table of what-if weightings; every
    hypothesis is ranked under each of them. They travel as arrays of ``WEIGHTINGS`` at
    most, so a longer table takes more passes and no product of tables is planned.
    """
    rows = effective_scores(hypotheses)
    eff = {a: F.col(f"eff_{a}") for a in vocab.AXES}
    if weights is None:
        rows = rows.withColumn("composite", sc.composite(eff))
    else:
        fields = F.struct("weighting_id", *[F.col(a).cast("double").alias(a) for a in vocab.AXES])
        read = weights.select(fields.alias("w")).toLocalIterator()
        parts = []
        while grid := list(itertools.islice(read, WEIGHTINGS)):
            items = F.array(*[F.struct(F.lit(g.w["weighting_id"]).alias("weighting_id"),
                                       *[F.lit(g.w[a]).cast("double").alias(a) for a in vocab.AXES]) for g in grid])
            parts.append(rows.withColumn("_w", F.explode(items)))
        none = rows.withColumn("_w", F.explode(F.array().cast(T.ArrayType(weights.select(fields.alias("w")).schema["w"].dataType))))
        rows = functools.reduce(DataFrame.unionAll, parts) if parts else none
        rows = rows.withColumn("weighting_id", F.col("_w.weighting_id")).withColumn(
            "composite", sc.composite(eff, {a: F.col(f"_w.{a}") for a in vocab.AXES})).drop("_w")
        keys = ["weighting_id", *keys]
    return score_rank(rows, keys, "composite", "hypothesis_id", "rank")


def sort_by_axis(ranked: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """Adds place: by any axis (or the composite), ties by composite."""
    main = F.col("composite") if axis == "rank" else F.coalesce(F.col(f"eff_{axis}"), F.lit(0.0))
    keyed = ranked.withColumn("_main", F.struct(main.alias("m"), "composite"))
    return score_rank(keyed, keys, "_main", "hypothesis_id", "place").drop("_main")


def report_summary(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per state, mean composite, number of valuable ones and the best statement:
    one aggregation."""
    def state(name):
        return F.count_if(F.coalesce(F.col("status"), F.lit("proposed")) == name)

    best = F.struct(-F.col("rank"))
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), state("accepted").alias("confirmed"), state("rejected").alias("refuted"),
        state("review").alias("review"), state("proposed").alias("proposed"),
        sc.half_up(F.avg(F.coalesce("composite", F.lit(0.0))), 1).alias("avg_composite"),
        F.count_if(F.coalesce("eff_value", F.lit(0.0)) >= 70).alias("high_value_count"),
        F.max_by("statement", best).alias("top_statement"), F.max_by("composite", best).alias("top_composite"))


# ---- expert feedback ----

# Headings of the buckets.
FEEDBACK = [
    ("confirmed", "ПОДТВЕРЖДЕНЫ экспертом — развивай и усиливай эти направления, предлагай их вариации и следующие шаги:"),
    ("refuted", "ОПРОВЕРГНУТЫ/ОТКЛОНЕНЫ экспертом — НЕ повторяй эти идеи; если предлагаешь близкое, устрани указанную причину:"),
    ("reviewed", "НА ПРОВЕРКЕ / с замечаниями эксперта — учти замечания:"),
]
FEEDBACK_TITLE = "ОБРАТНАЯ СВЯЗЬ ЭКСПЕРТА ПО ПРЕДЫДУЩИМ ГИПОТЕЗАМ (учитывай обязательно):"


def feedback(hypotheses: DataFrame, limits: dict[str, int] | None = None, statement_chars: int | None = None) -> DataFrame:
    """project_id, bucket, n, statement, note: the judged hypotheses, newest first; if the
    caller limits them, the first ``limits[bucket]`` and statements cut to a length."""
    note = tx.strip(tx.text_or_empty(F.col("expert_notes")))
    bucket = (F.when(F.col("status") == "accepted", "confirmed").when(F.col("status") == "rejected", "refuted")
              .when((F.col("status") == "review") | (note != ""), "reviewed"))
    rows = hypotheses.select("project_id", "hypothesis_id", "created_at", bucket.alias("bucket"),
                             _cut_to(tx.strip(tx.text_or_empty(F.col("statement"))), statement_chars).alias("statement"), note.alias("note"))
    newest = [F.col("created_at").desc(), F.col("hypothesis_id").desc()]
    judged = rows.filter(F.col("bucket").isNotNull())
    if limits is None:
        return score_rank(judged.withColumn("_i", -F.col("hypothesis_id")), ["project_id", "bucket"], "created_at", "_i", "n").drop("_i")
    most = F.lit(0)
    for name, limit in limits.items():
        most = F.when(F.col("bucket") == name, limit).otherwise(most)
    return top(judged, ["project_id", "bucket"], newest, max(limits.values(), default=0), "n").filter(F.col("n") <= most)


def _cut_to(c: Column, chars: int | None) -> Column:
    return c if chars is None else F.substring(c, 1, chars)


def _in_bucket(name: str):
    return lambda entry: entry["bucket"] == name


def feedback_block(entries: DataFrame) -> DataFrame:
    """project_id, feedback: the text block of the request."""
    line = F.concat(F.lit("  • "), "statement", F.when(F.col("note") != "", F.concat(F.lit(" — эксперт: "), "note")).otherwise(""))
    sorted_lines = F.array_sort(F.collect_list(F.struct("bucket", "n", line.alias("line"))))
    grouped = entries.groupBy("project_id").agg(sorted_lines.alias("e"))
    parts = [F.lit(FEEDBACK_TITLE)]
    for name, heading in FEEDBACK:
        mine = F.filter("e", _in_bucket(name))
        lines = F.transform(mine, lambda x: x["line"])
        parts.append(F.when(F.size(lines) > 0, F.concat(F.lit(heading + "\n"), F.array_join(lines, "\n"))))
    return grouped.select("project_id", F.concat(F.concat_ws("\n", *parts), F.lit("\n\n")).alias("feedback"))


# ---- exports ----

def _titles(evidence: Column) -> Column:
    return F.filter(F.transform(evidence, lambda e: e["title"]), lambda t: t.isNotNull() & (t != ""))


def number_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def csv_rows(ranked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The 14 columns of the CSV export, in order, after any ``keys``."""
    def opt(name):
        return tx.text_or_empty(F.col(name)).alias(name)

    return ranked.select(
        *(keys or []), "rank", "composite", "status", "statement", opt("goal_link"), opt("mechanism"), opt("validation"),
        *[F.col(f"eff_{a}").alias(a) for a in vocab.AXES], opt("expert_notes"),
        F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", ").alias("tags"),
        F.coalesce(F.array_join(_titles(F.col("evidence")), "; "), F.lit("")).alias("sources"))


def markdown_blocks(ranked: DataFrame) -> DataFrame:
    """project_id, rank, block: one text block per hypothesis; absent fields are left out."""
    def field(name, label):
        return F.when(tx.text_or_empty(F.col(name)) != "", F.concat(F.lit(f"**{label}:** "), F.col(name), F.lit("\n")))

    block = F.concat_ws(
        "\n",
        F.concat(F.lit("## "), F.col("rank").cast("string"), F.lit(". "), tx.text_or_empty(F.col("statement")), F.lit("\n")),
        F.concat(F.lit("**Ранг:** "), number_text(F.col("composite")), F.lit(" · **Статус:** "), tx.status_label(F.col("status")), F.lit("\n")),
        field("goal_link", "Связь с целью"), field("mechanism", "Механизм"), field("validation", "План проверки"),
        field("expert_notes", "Отзыв эксперта"),
        F.concat(F.lit("**Оценки:** новизна "), number_text(F.col("eff_novelty")), F.lit(", ценность "), number_text(F.col("eff_value")),
                 F.lit(", реализуемость "), number_text(F.col("eff_feasibility")), F.lit(", риск "), number_text(F.col("eff_risk")),
                 F.lit("\n\n---\n")))
    return ranked.select("project_id", "rank", block.alias("block"))


def markdown_header(projects: DataFrame, totals: DataFrame) -> DataFrame:
    """project_id, header. projects: title, kpi_target, kpi_metric, kpi_direction, domain."""
    line = tx.kpi_line(F.col("kpi_metric"), F.col("kpi_direction"), F.col("domain"))
    text = F.concat_ws(
        "\n", F.concat(F.lit("# Гипотезы НИОКР — "), tx.text_or_empty(F.col("title")), F.lit("\n")),
        F.concat(F.lit("**Цель (KPI):** "), tx.text_or_empty(F.col("kpi_target")), F.lit("  ")),
        F.when(line != "", F.concat(F.lit("**"), line, F.lit("**  "))),
        F.concat(F.lit("\nВсего гипотез: "), F.coalesce("total", F.lit(0)).cast("string"), F.lit("\n\n---\n")))
    return projects.join(totals, "project_id", "left").select("project_id", text.alias("header"))


def report_lines(ranked: DataFrame, projects: DataFrame, weights: dict[str, float] | None = None, exported_at: str = "") -> DataFrame:
    """project_id, rank, line: the lines of one JSON document for each project, with its own columns, the weights, the
    summary and the ranked list. The head has rank 0, each hypothesis its own line, the tail follows the last rank, so
    a list of any length is written without being gathered in one row."""
    used = F.struct(*[F.lit(float((weights or vocab.DEFAULT_WEIGHTS)[a])).alias(a) for a in vocab.AXES])
    summary = report_summary(ranked, ["project_id"])
    names = [c for c in summary.columns if c != "project_id"]
    counted = [c for c in names if not c.startswith("top_")]
    about = projects.select(F.col("project_id").alias("_id"), F.struct("*").alias("project")).join(
        summary.withColumnRenamed("project_id", "_id"), "_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0).cast(summary.schema[c].dataType)) for c in counted})
    head = F.to_json(F.struct(F.lit(exported_at).alias("exported_at"), "project", used.alias("ranking_weights"),
                              F.struct(*names).alias("summary")), {"ignoreNullFields": "false"})
    first = about.select(F.col("_id").alias("project_id"), F.lit(0).cast("long").alias("rank"),
                         F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(',"hypotheses":[')).alias("line"))
    last = about.select(F.col("_id").alias("project_id"), (F.col("total") + 1).cast("long").alias("rank"), F.lit("]}").alias("line"))
    listed = json_rows(ranked).join(about.select(F.col("_id").alias("project_id"), "total"), "project_id")
    comma = F.when(F.col("rank") < F.col("total"), ",").otherwise("")
    return first.unionByName(listed.select("project_id", F.col("rank").cast("long").alias("rank"), F.concat("json", comma).alias("line"))).unionByName(last)


def listing(ranked: DataFrame, status: str | None = None) -> DataFrame:
    """The list form of hypotheses: scores, their reasons and the effective scores as structs; of one ``status`` only,
    if it is given. Columns that a table lacks are null."""
    rows = ranked if status is None else ranked.filter(F.coalesce("status", F.lit("proposed")) == status)

    def own(name, kind="string"):
        return F.col(name) if name in ranked.columns else F.lit(None).cast(kind)

    def opt(name, kind):
        return F.coalesce(own(name, kind), F.array().cast(ranked.schema[name].dataType if name in ranked.columns else kind)).alias(name)

    def axes(prefix, suffix="", kind="double"):
        return F.struct(*[own(f"{prefix}{a}{suffix}", kind).cast(kind).alias(a) for a in vocab.AXES])

    return rows.select(
        F.col("hypothesis_id").alias("id"), "project_id", own("run_id", "long").alias("run_id"), "statement",
        *[own(c).alias(c) for c in ("goal_link", "rationale", "mechanism", "validation")], opt("tags", "array<string>"),
        axes("").alias("scores"), axes("", "_rationale", "string").alias("rationales"), opt("evidence", "array<string>"), "status",
        own("expert_notes").alias("expert_notes"), own("expert_scores", "map<string,double>").alias("expert_scores"),
        axes("eff_").alias("effective_scores"), "composite", "rank")


def json_rows(ranked: DataFrame) -> DataFrame:
    """project_id, rank, json: one export object per hypothesis."""
    scores = F.struct(*[F.col(f"eff_{a}").alias(a) for a in vocab.AXES])
    model = F.struct(*[F.col(a).cast("double").alias(a) for a in vocab.AXES])
    body = F.struct("rank", "composite", "status", "statement", "goal_link", "mechanism", "rationale", "validation",
                    scores.alias("scores"), model.alias("model_scores"), "expert_notes",
                    F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
                    F.coalesce(_titles(F.col("evidence")), F.array().cast("array<string>")).alias("sources"))
    return ranked.select("project_id", "rank", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))
