"""Numbered context, request texts and the retrieval log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx, vocab

# Texts of the request.
EMPTY_BASE = "(база знаний пуста — опирайся на общие принципы, но снижай feasibility и повышай risk)"
FEEDBACK_RULE = ("\n  • ОБЯЗАТЕЛЬНО учитывай обратную связь эксперта выше: развивай подтверждённые "
                 "направления, не повторяй отклонённые, закрывай замечания;")
TASK_RULES = """Требования:
  • опирайся на конкретные источники и ссылайся на них по ID ([S1], [S2] ...);
  • каждая гипотеза — иной механизм/подход (не переформулировки одной идеи);
  • обязательно заполни goal_link — прямую связь с целью/метрикой проекта;
  • формулировка должна быть проверяемой в эксперименте;
  • оценки калибруй честно и обосновывай каждую;
  • если источников недостаточно — снижай feasibility и повышай risk;"""
SCORE_GUIDE = """
Шкалы оценок (целые 0..100):
  novelty     — насколько идея нетривиальна относительно базы знаний (100 = прорыв);
  value       — ожидаемый вклад/эффект для цели (100 = решающий);
  feasibility — реализуемость проверки имеющимися ресурсами (100 = легко проверить);
  risk        — суммарный научно-технический риск/неопределённость (100 = очень высокий).
"""
WEIGHT_GUIDE = """
Сумма весов должна быть близка к 1. Веса отражают приоритеты ПРОЕКТА:
  • ранняя/поисковая стадия, амбициозная цель  → выше novelty и value;
  • жёсткие ограничения по ресурсам/срокам/производству → выше feasibility и risk;
  • инкрементальное улучшение зрелой технологии → выше feasibility, ниже novelty.
"""


def numbered(items: DataFrame) -> DataFrame:
    """Adds sid 'S<n>'; (query_id, sid, source_key) is the map for citations."""
    return items.withColumn("sid", F.concat(F.lit("S"), F.col("final_rank").cast("string")))


def context_blocks(items: DataFrame) -> DataFrame:
    """query_id, context. items: query_id, final_rank, title, source_type, year, authors,
    origin, section_title, page_ref, rerank, hybrid, bm25, terms, passage. A query has at
    most top_k items, so the ordered collection is small."""
    kind = F.col("source_type")
    for key, label in vocab.SOURCE_TYPE_LABELS.items():
        kind = F.when(F.col("source_type") == key, label).otherwise(kind)

    def opt(c):
        return F.nullif(c.cast("string"), F.lit(""))

    origin = F.nullif(opt(F.col("origin")), F.lit("manual"))
    meta = F.concat_ws(
        " · ", opt(kind), F.nullif(opt(F.col("year")), F.lit("0")), opt(F.col("authors")), F.concat(F.lit("источник: "), origin),
        F.concat(F.lit("раздел: "), opt(F.col("section_title"))), F.concat(F.lit("страница/лист: "), opt(F.col("page_ref"))))
    score = F.coalesce(
        F.when(F.col("rerank").isNotNull(), F.format_string("реранк=%.3f", "rerank")),
        F.concat(F.lit("гибрид="), F.round("hybrid", 6).cast("string")),
        F.concat(F.lit("bm25="), F.col("bm25").cast("string")))
    entry = F.concat(
        F.lit("["), "sid", F.lit("] "), tx.text_or_empty(F.col("title")), F.lit(" ("), meta, F.lit(")\n    "), score,
        F.lit("; совпавшие термины: "), F.array_join(F.coalesce("terms", F.array().cast("array<string>")), ", "),
        F.lit("\n    "), tx.text_or_empty(F.col("passage")))
    lines = F.array_sort(F.collect_list(F.struct("final_rank", entry.alias("line"))))
    return numbered(items).groupBy("query_id").agg(
        F.array_join(F.transform(lines, lambda s: s["line"]), "\n\n").alias("context"))


def generation_requests(projects: DataFrame, context: DataFrame, feedback: DataFrame, n: int = 5) -> DataFrame:
    """project_id, request, preview: one request text per project (project_id, title,
    kpi_target, kpi_metric, kpi_direction, domain, constraints, topic)."""
    def either(name, other):
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(other))

    joined = (
        projects.join(context.withColumnRenamed("query_id", "project_id"), "project_id", "left")
        .join(feedback, "project_id", "left")
    )
    focus = F.when(tx.strip(tx.text_or_empty(F.col("topic"))) != "",
                   F.concat(F.lit("\nТЕМА/ФОКУС ЗАПРОСА: "), "topic", F.lit("\n"))).otherwise("")
    block = tx.text_or_empty(F.col("feedback"))
    request = F.concat(
        F.lit("ЦЕЛЬ И КОНТЕКСТ ПРОЕКТА\nПроект: "), tx.text_or_empty(F.col("title")),
        F.lit("\nЦель (KPI): "), tx.text_or_empty(F.col("kpi_target")),
        F.lit("\nМетрика: "), either("kpi_metric", "не задана"), F.lit(" (направление: "), tx.direction_verb(F.col("kpi_direction")),
        F.lit(")\nОбласть: "), either("domain", "материаловедение"),
        F.lit("\nОграничения/ресурсы: "), either("constraints", "не заданы"), F.lit("\n"), focus,
        F.lit("\nБАЗА ЗНАНИЙ (RAG: TF-IDF отбор → переранжирование кросс-энкодером)\n"),
        F.coalesce("context", F.lit(EMPTY_BASE)), F.lit("\n\n"), block, F.lit("ЗАДАЧА\n"),
        F.lit(f"Сгенерируй {n} РАЗНООБРАЗНЫХ, взаимодополняющих и проверяемых научных гипотез для достижения цели.\n"),
        F.lit(TASK_RULES), F.when(block != "", F.lit(FEEDBACK_RULE)).otherwise(""), F.lit("\n" + SCORE_GUIDE + "\n"))
    return joined.select("project_id", request.alias("request")).withColumn("preview", F.substring("request", 1, 6000))


def weight_requests(projects: DataFrame) -> DataFrame:
    def either(name, other):
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(other))

    return projects.select("project_id", F.concat(
        F.lit("ПРОЕКТ\nНазвание: "), tx.text_or_empty(F.col("title")), F.lit("\nЦель (KPI): "), tx.text_or_empty(F.col("kpi_target")),
        F.lit("\nМетрика: "), either("kpi_metric", "не задана"), F.lit(" (направление: "), tx.direction_verb(F.col("kpi_direction")),
        F.lit(")\nОбласть: "), either("domain", "материаловедение"), F.lit("\nОграничения/ресурсы: "), either("constraints", "не заданы"),
        F.lit("\n\nЗАДАЧА\nПредложи веса важности критериев ранжирования гипотез под ЭТОТ проект и его стадию.\n"),
        F.lit(WEIGHT_GUIDE + "\n")).alias("request"))


LOG_FIELDS = ["source_key", "source_kind", "source_id", "title", "source_type", "origin", "page_ref", "section_title",
              "bm25", "dense", "hybrid", "rerank", "score", "terms", "lang"]


def retrieval_log(items: DataFrame) -> DataFrame:
    """query_id, retrieved: the 15 fields of every item in rank order."""
    have = [F.col(c) if c in items.columns else F.lit(None).cast("string").alias(c) for c in LOG_FIELDS]
    logged = F.array_sort(F.collect_list(F.struct("final_rank", *have)))
    return items.groupBy("query_id").agg(logged.alias("retrieved"))


def audit_runs(projects: DataFrame, weights: DataFrame, log: DataFrame, stages: DataFrame, requests: DataFrame,
               errors: DataFrame) -> DataFrame:
    """One run row per project, failed runs included; append it to the run table."""
    return (
        projects.select("project_id").join(weights, "project_id", "left")
        .join(log.withColumnRenamed("query_id", "project_id"), "project_id", "left")
        .join(stages.select(F.col("query_id").alias("project_id"), F.struct(*[c for c in stages.columns if c != "query_id"]).alias("stages")), "project_id", "left")
        .join(requests.select("project_id", F.col("preview").alias("prompt_preview")), "project_id", "left")
        .join(errors.select("project_id", "error"), "project_id", "left")
    )
