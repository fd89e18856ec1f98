"""The source catalogue and its relational upkeep.

Tables are plain DataFrames; a change is a function from the old table (and the changes)
to the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import scores as sc, text as tx, vocab
from .ranking import first_row, ordinal, top


# ---- matching and import ----

def _lookup(catalogue: DataFrame, keys: dict[str, Column], keep: Column, name: str) -> DataFrame:
    rows = catalogue.select("project_id", F.col("source_id").alias(name), *[c.alias(k) for k, c in keys.items()], keep.alias("_keep"))
    return first_row(rows.filter("_keep").drop("_keep"), ["project_id", *keys], [F.col(name)])


def match_existing(candidates: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Adds existing_source_id: the catalogue row of the same project with the same
    reference, else the same title and year, else the same title; the lowest id wins.

    Three equi-joins on deduplicated lookups, so no candidate is multiplied. Candidates
    without a key get one of many that no catalogue row has, so they spread over all tasks.
    """
    title, ref = tx.source_key(F.col("title")), tx.source_key(F.col("reference"))
    # Keys are stripped, so none of theirs starts with a blank.
    nothing = F.concat(F.lit(" "), F.pmod(F.xxhash64(*[c for c, kind in candidates.dtypes if "map<" not in kind]), F.lit(4096)).cast("string"))
    by_ref = _lookup(catalogue, {"_ref": ref}, ref != "", "_m1")
    by_both = _lookup(catalogue, {"_title": title, "_year": F.col("year")}, (title != "") & F.col("year").isNotNull(), "_m2")
    by_title = _lookup(catalogue, {"_title": title}, title != "", "_m3")
    keyed = (
        candidates.withColumn("_ref", F.coalesce(F.nullif(ref, F.lit("")), nothing))
        .withColumn("_title", F.coalesce(F.nullif(title, F.lit("")), nothing)).withColumn("_year", F.col("year"))
    )
    return (
        keyed.join(by_ref, ["project_id", "_ref"], "left")
        .join(by_both, ["project_id", "_title", "_year"], "left")
        .join(by_title, ["project_id", "_title"], "left")
        .withColumn("existing_source_id", F.coalesce("_m1", "_m2", "_m3"))
        .drop("_ref", "_title", "_year", "_m1", "_m2", "_m3")
    )


def mark_candidates(candidates: DataFrame, catalogue: DataFrame) -> DataFrame:
    return match_existing(candidates, catalogue).withColumn(
        "already_added", F.col("existing_source_id").isNotNull())


def select_imports(candidates: DataFrame, catalogue: DataFrame, max_import: int | None = None,
                   title_chars: int | None = None) -> DataFrame:
    """Candidates (project_id, pos, title, content, reference, year ...) to be added: with
    title and content, not in the catalogue, the first of each reference (else title), and
    if the caller limits it the first ``max_import`` of a project. Adds import_rank."""
    title, content = tx.strip(tx.text_or_empty(F.col("title"))), tx.strip(tx.text_or_empty(F.col("content")))
    valid = candidates.filter((title != "") & (content != ""))
    fresh = match_existing(valid, catalogue).filter(F.col("existing_source_id").isNull()).drop("existing_source_id")
    key = F.coalesce(F.nullif(tx.source_key(F.col("reference")), F.lit("")), tx.source_key(F.col("title")))
    unique = first_row(fresh.withColumn("_key", key), ["project_id", "_key"], [F.col("pos")]).drop("_key")
    if max_import is None:
        ranked = ordinal(unique, ["project_id"], "pos", "import_rank")
    else:
        ranked = top(unique, ["project_id"], [F.col("pos")], max_import, "import_rank")
    kept = title if title_chars is None else F.substring(title, 1, title_chars)
    return ranked.withColumn("title", kept).withColumn("content", content)


def validate_sources(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): title and content must not be blank; both are trimmed."""
    title, content = tx.strip(tx.text_or_empty(F.col("title"))), tx.strip(tx.text_or_empty(F.col("content")))
    ok = (title != "") & (content != "")
    accepted = rows.filter(ok).withColumn("title", title).withColumn("content", content).withColumn("origin", F.lit("manual"))
    rejected = rows.filter(~ok).withColumn("error", F.lit("title and content are required"))
    return accepted, rejected


# ---- listing and access ----

def search_sources(sources: DataFrame, query: str, limit: int = 6) -> DataFrame:
    """Case-insensitive search in title, content, authors and reference, newest first.
    '%' and '_' in the query are wildcards; queries below two characters find nothing."""
    needle = query.strip()
    if len(needle) < 2:
        return sources.limit(0)
    hit = F.lit(False)
    for c in ("title", "content", "authors", "reference"):
        hit = hit | F.coalesce(F.col(c).ilike(f"%{needle}%"), F.lit(False))
    return sources.filter(hit).orderBy(F.col("created_at").desc(), F.col("source_id").desc()).limit(max(1, limit))


def newest_first(rows: DataFrame, id_column: str) -> DataFrame:
    return rows.orderBy(F.col("created_at").desc(), F.col(id_column).desc())


def user_projects(memberships: DataFrame, projects: DataFrame) -> DataFrame:
    """The projects of every user with the user's role; order by created_at for a listing."""
    return memberships.select("user_id", "project_id", "role").join(projects, "project_id")


def accessible(rows: DataFrame, memberships: DataFrame, owner_only: bool = False) -> DataFrame:
    """Rows (user_id, project_id ...) whose user belongs to the project."""
    allowed = memberships.filter(F.col("role") == "owner") if owner_only else memberships
    return rows.join(allowed.select("user_id", "project_id"), ["user_id", "project_id"], "left_semi")


def members(memberships: DataFrame, users: DataFrame) -> DataFrame:
    """Members by project, owners first, then by user name. The order is a range sort, so
    a project of any size is spread over tasks."""
    return memberships.join(users, "user_id", "left").orderBy(
        "project_id", F.col("role") != "owner", F.coalesce("username", F.lit("")), "user_id")


def claim_orphans(projects: DataFrame, memberships: DataFrame, user_id: int) -> DataFrame:
    """New owner memberships for projects that nobody belongs to."""
    return projects.select("project_id").join(memberships, "project_id", "left_anti").select(
        F.lit(user_id).cast("long").alias("user_id"), "project_id", F.lit("owner").alias("role"))


def upsert_members(memberships: DataFrame, added: DataFrame) -> DataFrame:
    """Add memberships; an existing (project, user) stays as it is."""
    new = first_row(added, ["project_id", "user_id"], [F.col("role").desc()])
    return memberships.unionByName(new.join(memberships, ["project_id", "user_id"], "left_anti"), allowMissingColumns=True)


def with_child_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Adds <name>_count per child table; parents without children get 0."""
    out = parents
    for name, rows in children.items():
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias(f"{name}_count"))
        out = out.join(counts, key, "left").withColumn(f"{name}_count", F.coalesce(f"{name}_count", F.lit(0)))
    return out


def page_of_children(rows: DataFrame, key: str, order: str, limit: int, offset: int = 0) -> DataFrame:
    """One page of every parent's children, with the total count of that parent."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    page = top(rows, [key], [F.col(order)], offset + limit, "_n").filter(F.col("_n") > offset).drop("_n")
    return page.join(counts, key)


def latest(rows: DataFrame, key: str, id_column: str) -> DataFrame:
    return first_row(rows, [key], [F.col("created_at").desc(), F.col(id_column).desc()])


def source_card(sources: DataFrame) -> DataFrame:
    """The list form of a source: an excerpt instead of the content."""
    origin = F.coalesce(F.nullif(F.col("origin"), F.lit("")), F.lit("manual"))
    return sources.withColumn("origin", origin).withColumn("is_external", origin != "manual").withColumn(
        "excerpt", tx.excerpt(F.col("content"), 240)).drop("content")


def document_card(documents: DataFrame, chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """The list form of a document (document_id, raw_text, metadata struct with summary and description, ...): a preview
    instead of the text, its summary and the numbers of its chunks and tables."""
    m = F.col("metadata")
    summary = F.coalesce(F.nullif(m["summary"], F.lit("")), m["description"])
    cards = documents.withColumn("raw_text_preview", tx.excerpt(tx.text_or_empty(F.col("raw_text")), 500)).withColumn(
        "summary", summary).withColumn("description", F.col("summary")).drop("raw_text")
    return with_child_counts(cards, "document_id", chunk=chunks, table=tables)


def document_facts(documents: DataFrame) -> DataFrame:
    """title, content, source_type, authors and year of parsed documents from their
    metadata struct (title, summary, description, source_type, authors, year)."""
    m = F.col("metadata")

    def some(c):
        return F.nullif(c, F.lit(""))

    authors = F.array_join(F.filter(F.transform(m["authors"], tx.strip), lambda a: a != ""), ", ")
    return documents.select(
        "*",
        tx.strip(F.coalesce(some(m["title"]), F.col("filename"), F.lit(""))).alias("title"),
        tx.strip(F.coalesce(some(F.col("raw_text")), some(m["summary"]), some(m["description"]), F.lit(""))).alias("content"),
        F.coalesce(some(m["source_type"]), F.when(F.col("file_type").isin("xlsx", "csv"), "dataset").otherwise("uploaded_document")).alias("source_type"),
        some(authors).alias("authors"), m["year"].alias("year"),
    )


def retrieval_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Parsed documents with chunks or non-blank text."""
    parsed = documents.filter(F.col("parse_status") == "parsed")
    has_chunks = chunks.select("document_id").distinct().withColumn("_c", F.lit(True))
    return parsed.join(has_chunks, "document_id", "left").filter(
        F.col("_c") | (tx.strip(tx.text_or_empty(F.col("raw_text"))) != "")).drop("_c")


def review_bundle(documents: DataFrame, chunks: DataFrame, tables: DataFrame, runs: DataFrame,
                  chunk_limit: int = 10, table_limit: int = 5) -> DataFrame:
    """A document with its first chunks, first tables and latest parse run. The children
    are limited before they are collected."""
    raw = tx.collapse(F.col("raw_text"))
    few_chunks = top(chunks, ["document_id"], [F.col("chunk_index")], chunk_limit, "_n").groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "section_title", "page_ref", tx.cut(F.col("text"), 700).alias("text")))).alias("chunks_sample"))
    few_tables = top(tables, ["document_id"], [F.col("table_id")], table_limit, "_n").groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("table_id", "table_name", "row_count", F.slice("rows", 1, 3).alias("rows_sample")))).alias("tables_sample"))
    last = latest(runs, "document_id", "run_id").select("document_id", F.struct("run_id", "status").alias("recent_parse_run"))
    counted = with_child_counts(documents, "document_id", chunk=chunks, table=tables)
    return (
        counted.select("document_id", "parse_status", F.length(tx.text_or_empty(F.col("raw_text"))).alias("raw_text_length"),
                       tx.cut(raw, 1800).alias("raw_text_preview"), "chunk_count", "table_count")
        .join(last, "document_id", "left").join(few_chunks, "document_id", "left").join(few_tables, "document_id", "left")
    )


def normalize_reviews(reviews: DataFrame) -> DataFrame:
    """Review answers (status, confidence, summary, issues, needs_ocr): unknown states
    become 'warning', confidence is clamped, missing lists are empty."""
    return reviews.select(
        "document_id", sc.review_status(F.col("status")).alias("status"), sc.confidence(F.col("confidence")).alias("confidence"),
        tx.strip(tx.text_or_empty(F.col("summary"))).alias("summary"),
        F.coalesce("issues", F.array().cast("array<string>")).alias("issues"),
        F.coalesce("needs_ocr", F.lit(False)).alias("needs_ocr"))


# ---- changes ----

def sync_metrics(projects: DataFrame, metrics: DataFrame, default_name: str = "Метрика эффективности",
                 name_chars: int | None = None, value_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(projects, metrics) after the metric lists (project_id, metrics array<struct<name,
    unit, current, target>>) replaced those of their projects. Empty entries go, position
    is the place in the given list, kpi_metric is the first given name."""
    def short(c, n):
        whole = tx.strip(tx.text_or_empty(c))
        return whole if n is None else F.substring(whole, 1, n)

    rows = metrics.select("project_id", F.posexplode("metrics").alias("position", "m")).select(
        "project_id", F.col("position").cast("long").alias("position"), short(F.col("m.name"), name_chars).alias("name"),
        short(F.col("m.unit"), value_chars).alias("unit"), short(F.col("m.current"), value_chars).alias("current_value"),
        short(F.col("m.target"), value_chars).alias("target_value"))
    rows = rows.filter(F.concat("name", "unit", "current_value", "target_value") != "")
    first_name = rows.filter(F.col("name") != "").groupBy("project_id").agg(F.min_by("name", "position").alias("_k"))
    given = metrics.select("project_id").distinct().withColumn("_g", F.lit(True))
    updated = (
        projects.join(given, "project_id", "left").join(first_name, "project_id", "left")
        .withColumn("kpi_metric", F.when(F.col("_g"), F.col("_k")).otherwise(F.col("kpi_metric"))).drop("_g", "_k")
    )
    named = rows.withColumn("name", F.when(F.col("name") == "", F.lit(default_name)).otherwise(F.col("name")))
    return updated, named


def _folded(maps: Column, kind: str) -> Column:
    """One map from several: a later one overrides the keys it names."""
    return F.aggregate(maps, F.create_map().cast(kind), lambda old, new: F.when(new.isNull(), old).otherwise(
        F.map_zip_with(old, new, lambda k, a, b: F.when(F.map_contains_key(new, k), b).otherwise(a))))


def fold_patches(patches: DataFrame, key: str) -> DataFrame:
    """One patch per key. Patches apply in the order of ``pos``, if there is such a column."""
    maps = {c: t for c, t in patches.dtypes if c in ("patch", "expert_scores")}
    order = F.col("pos") if "pos" in patches.columns else F.lit(0)
    # the lists are sorted by place; maps cannot be compared, so they follow in a list of the same order
    rows = patches.select(key, order.alias("_o"), *maps)
    listed = rows.groupBy(key).agg(F.collect_list(F.struct("_o", *maps)).alias("_all"))
    sorted_ = F.array_sort("_all", lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0))
    return listed.withColumn("_all", sorted_).select(key, *[
        F.when(F.exists("_all", lambda x: x[c].isNotNull()), _folded(F.transform("_all", lambda x: x[c]), t)).alias(c)
        for c, t in maps.items()])


def patch_rows(base: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Set the listed fields that the patches (key, patch map<string,string>, and pos if
    their order matters) name, null included; years are parsed, other types are cast."""
    return _patched(base.join(fold_patches(patches, key).select(key, "patch"), key, "left"), base, fields)


def _patched(joined: DataFrame, base: DataFrame, fields: list[str], *more: str) -> DataFrame:
    out = []
    for f in base.schema.fields:
        if f.name not in fields:
            out.append(F.col(f.name))
            continue
        raw = F.try_element_at("patch", F.lit(f.name))
        new = sc.parse_year(raw) if f.name == "year" else raw.try_cast(f.dataType)
        named = F.coalesce(F.map_contains_key("patch", F.lit(f.name)), F.lit(False))
        out.append(F.when(named, new).otherwise(F.col(f.name)).alias(f.name))
    return joined.select(*out, *more)


def patch_hypotheses(base: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches (hypothesis_id, patch map<string,string>, expert_scores map<string,double>).
    A state outside the four is ignored; scores are clamped, null deletes one, other axes
    are ignored, and an empty score map becomes null."""
    texts = ["statement", "rationale", "mechanism", "validation", "expert_notes"]
    folded = fold_patches(patches, "hypothesis_id").withColumnRenamed("expert_scores", "_new")
    joined = _patched(base.join(folded, "hypothesis_id", "left"), base, [c for c in texts if c in base.columns], "patch", "_new")
    state = F.try_element_at("patch", F.lit("status"))
    merged = F.map_filter(
        F.map_zip_with(
            F.coalesce("expert_scores", F.create_map().cast("map<string,double>")),
            F.map_filter("_new", lambda k, v: k.isin(vocab.AXES)),
            lambda k, old, new: F.when(F.map_contains_key(F.col("_new"), k), F.when(new.isNotNull(), sc.clamp(new))).otherwise(old)),
        lambda k, v: v.isNotNull())
    return (
        joined.withColumn("status", F.when(state.isin(list(vocab.STATUS_LABELS)), state).otherwise(F.col("status")))
        .withColumn("expert_scores", F.when(F.col("_new").isNull(), F.col("expert_scores"))
                    .otherwise(F.when(F.size(merged) > 0, merged)))
        .drop("patch", "_new")
    )


def delete_cascade(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """All tables without the projects in ``doomed`` (project_id) and what belongs to them.
    Tables without a project_id hang on a document."""
    documents = tables.get("documents")
    out = {}
    for name, rows in tables.items():
        if "project_id" in rows.columns:
            out[name] = rows.join(doomed.select("project_id"), "project_id", "left_anti")
        else:
            gone = documents.join(doomed.select("project_id"), "project_id", "left_semi").select("document_id")
            out[name] = rows.join(gone, "document_id", "left_anti")
    return out


def replace_children(old: DataFrame, new: DataFrame, parsed: DataFrame, key: str = "document_id") -> DataFrame:
    """Children after a re-parse of ``parsed`` (key): their old rows go, also where the
    new parse gave none. Applying the same parse twice changes nothing."""
    return old.join(parsed.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def add_missing_columns(rows: DataFrame, wanted: T.StructType) -> DataFrame:
    have = set(rows.columns)
    return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields if f.name not in have])


def parse_log(documents: DataFrame, outcome: DataFrame) -> DataFrame:
    """One run row per document: parsed, unsupported, or failed with its error.
    ``outcome``: document_id, warnings, error (null for success)."""
    supported = F.col("file_type").isin(vocab.SUPPORTED_TYPES)
    joined = documents.join(outcome, "document_id", "left")
    status = F.when(~supported, "unsupported").when(F.col("error").isNotNull(), "failed").otherwise("parsed")
    none = F.array().cast("array<string>")
    return joined.select(
        "document_id", status.alias("status"),
        F.when(status == "unsupported", F.array(F.lit("format unsupported")))
        .when(status == "failed", none).otherwise(F.coalesce("warnings", none)).alias("warnings"),
        F.when(status == "unsupported", "format unsupported").otherwise(F.col("error")).alias("error"))
