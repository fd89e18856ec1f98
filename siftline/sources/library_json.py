"""Nested library files: every JSON file holds up to seven kinds of source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scores as sc, text as tx

_TEXTS = "array<string>"
SCHEMA = f"""
title string, note string,
retrieval_playbook struct<goal:string,selection_rules:{_TEXTS},log_fields:{_TEXTS}>,
domain_taxonomy struct<assets:{_TEXTS},media:{_TEXTS},failure_modes:{_TEXTS},action_classes:{_TEXTS}>,
sources array<struct<source_id:string,title:string,summary:string,content:string,source_type:string,authors:string,
  year:string,reference:string,tags:{_TEXTS},
  key_passages:array<struct<heading:string,text:string,signals:{_TEXTS},use_when:{_TEXTS}>>>>,
asset_profiles array<struct<asset_id:string,asset_type:string,weak_zones:{_TEXTS},monitoring_focus:{_TEXTS}>>,
failure_modes array<struct<failure_mode_id:string,name:string,diagnostic_signals:{_TEXTS},common_triggers:{_TEXTS}>>,
process_signals array<struct<signal_id:string,name:string,why_important:string>>,
retrieval_examples array<struct<example_id:string,query:string,project_context:string,selected_passages:{_TEXTS},
  selection_log:array<struct<passage_id:string,why_selected:string>>,
  rejected_passages:array<struct<passage_id:string,why_rejected:string>>,
  synthesis_hint:string,open_risks:{_TEXTS},next_checks:{_TEXTS}>>
"""


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file, json: whole files, a byte order mark removed."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\z", 1).alias("file"),
                        F.regexp_replace("value", "^\ufeff", "").alias("json"))


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed files, errors). A file that is not JSON is reported and skipped."""
    ok = F.try_parse_json("json").isNotNull()
    stem = F.regexp_replace("file", r"\.[^.]*\z", "")
    parsed = files.filter(ok).select("file", stem.alias("stem"), F.from_json("json", SCHEMA, {"mode": "PERMISSIVE"}).alias("d"))
    return parsed, files.filter(~ok).select("file", F.lit("not valid JSON").alias("error"))


def _first(*choices: Column) -> Column:
    return F.coalesce(*[F.nullif(tx.collapse(c), F.lit("")) for c in choices])


def _blocks(items: Column, compose) -> Column:
    return F.filter(F.transform(items, compose), lambda b: b.isNotNull())


def sources(parsed: DataFrame) -> DataFrame:
    """source_id, title, content, source_type, origin, authors, year, reference."""
    d = F.col("d")
    corpus = F.coalesce(F.nullif(tx.collapse(d["title"]), F.lit("")), F.col("stem"))
    none = F.lit(None).cast("string")

    def rows(df, raw_id, title, content, kind, authors=none, year=F.lit(None).cast("int"), reference=none):
        kept_id = F.coalesce(F.nullif(tx.collapse(raw_id), F.lit("")), kind)
        return df.select(
            F.concat(F.lit("lib:"), "stem", F.lit(":"), kept_id).alias("source_id"),
            F.substring(F.coalesce(F.nullif(title, F.lit("")), kind), 1, 400).alias("title"), content.alias("content"),
            kind.alias("source_type"), F.lit("local_lib").alias("origin"), authors.alias("authors"), year.alias("year"),
            F.coalesce(reference, F.concat(F.lit("lib/"), "file")).alias("reference"))

    p, t = d["retrieval_playbook"], d["domain_taxonomy"]
    parts = [
        rows(parsed, F.lit("playbook"), F.concat(corpus, F.lit(": retrieval playbook")), tx.compose(
            tx.labelled("Corpus", corpus), tx.labelled("Note", d["note"]), tx.labelled("Goal", p["goal"]),
            tx.bullet_list("Selection rules", p["selection_rules"]), tx.bullet_list("Log fields", p["log_fields"])), F.lit("playbook")),
        rows(parsed, F.lit("taxonomy"), F.concat(corpus, F.lit(": domain taxonomy")), tx.compose(
            tx.labelled("Corpus", corpus), tx.bullet_list("Assets", t["assets"]), tx.bullet_list("Media", t["media"]),
            tx.bullet_list("Failure modes", t["failure_modes"]), tx.bullet_list("Action classes", t["action_classes"])), F.lit("taxonomy")),
    ]

    def entries(field):
        return parsed.select("file", "stem", F.explode(d[field]).alias("e"))

    e = F.col("e")
    passages = _blocks(e["key_passages"], lambda x: tx.compose(
        tx.labelled("Heading", x["heading"]), tx.labelled("Text", x["text"]),
        tx.inline_list("Signals", x["signals"]), tx.inline_list("Use when", x["use_when"], "; ")))
    parts.append(rows(
        entries("sources"), _first(e["source_id"], e["title"], F.lit("reference")), _first(e["title"], e["source_id"], F.lit("reference")),
        tx.compose(tx.labelled("Summary", e["summary"]), tx.labelled("Content", e["content"]), tx.inline_list("Tags", e["tags"]),
                   tx.joined_blocks("Key passages", passages)),
        F.coalesce(_first(e["source_type"]), F.lit("literature")), _first(e["authors"]), sc.parse_year(e["year"]), _first(e["reference"])))
    parts.append(rows(
        entries("asset_profiles"), _first(e["asset_id"], e["asset_type"], F.lit("asset")), _first(e["asset_type"], e["asset_id"], F.lit("asset")),
        tx.compose(tx.bullet_list("Weak zones", e["weak_zones"]), tx.bullet_list("Monitoring focus", e["monitoring_focus"])), F.lit("asset_profile")))
    parts.append(rows(
        entries("failure_modes"), _first(e["failure_mode_id"], e["name"], F.lit("failure-mode")), _first(e["name"], e["failure_mode_id"], F.lit("failure-mode")),
        tx.compose(tx.bullet_list("Diagnostic signals", e["diagnostic_signals"]), tx.bullet_list("Common triggers", e["common_triggers"])), F.lit("failure_mode")))
    parts.append(rows(
        entries("process_signals"), _first(e["signal_id"], e["name"], F.lit("process-signal")), _first(e["name"], e["signal_id"], F.lit("process-signal")),
        tx.compose(tx.labelled("Why important", e["why_important"])), F.lit("process_signal")))
    chosen = _blocks(e["selection_log"], lambda x: tx.compose(tx.labelled("Passage", x["passage_id"]), tx.labelled("Why selected", x["why_selected"])))
    refused = _blocks(e["rejected_passages"], lambda x: tx.compose(tx.labelled("Passage", x["passage_id"]), tx.labelled("Why rejected", x["why_rejected"])))
    query = tx.collapse(e["query"])
    short = F.when(F.length(query) > 120, F.concat(F.substring(query, 1, 120), F.lit("..."))).otherwise(query)
    example = _first(e["example_id"], F.lit("retrieval-example"))
    parts.append(rows(
        entries("retrieval_examples"), example, F.concat(F.lit("Retrieval example: "), F.coalesce(F.nullif(short, F.lit("")), example)),
        tx.compose(tx.labelled("Query", e["query"]), tx.labelled("Project context", e["project_context"]),
                   tx.inline_list("Selected passages", e["selected_passages"]), tx.joined_blocks("Selection log", chosen),
                   tx.joined_blocks("Rejected passages", refused), tx.labelled("Synthesis hint", e["synthesis_hint"]),
                   tx.bullet_list("Open risks", e["open_risks"]), tx.bullet_list("Next checks", e["next_checks"])),
        F.lit("retrieval_example")))
    return reduce(DataFrame.unionByName, parts).filter(F.col("content").isNotNull())


def status(files: DataFrame, rows: DataFrame, errors: DataFrame) -> DataFrame:
    """metric, name, count: files, errors, sources and sources per type."""
    none = F.lit(None).cast("string")
    count = F.count(F.lit(1)).alias("count")
    return (
        files.agg(count).select(F.lit("files").alias("metric"), none.alias("name"), "count")
        .unionByName(errors.agg(count).select(F.lit("errors").alias("metric"), none.alias("name"), "count"))
        .unionByName(rows.agg(count).select(F.lit("sources").alias("metric"), none.alias("name"), "count"))
        .unionByName(rows.groupBy("source_type").agg(count).select(F.lit("source_type").alias("metric"), F.col("source_type").alias("name"), "count"))
    )
