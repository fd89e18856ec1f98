"""Catalogue matching, access, listings and table changes."""

from pyspark.sql import functions as F, types as T

from siftline.functions import text as tx
from siftline.operators import catalog
from . import Registry, table
from .sqltext import collapse

registry = Registry()


def _candidates(spark, folder):
    n = F.col("page_id")
    return table(spark, folder, "pages").select(
        (n % 5).alias("project_id"), n.alias("pos"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        (2000 + n % 10).cast("int").alias("year"), F.when(n % 7 > 0, F.col("url")).alias("reference"),
        F.when(n % 11 > 0, F.col("html")).alias("content"))


def _catalogue(spark, folder):
    """Pages again: same link in another case, same title and year, same title, or nothing alike."""
    n = F.col("page_id")
    return _candidates(spark, folder).withColumnRenamed("pos", "page_id").select(
        "project_id", (1000 - n).alias("source_id"),
        F.when(n % 4 == 3, F.concat("title", F.lit(" other"))).otherwise(F.concat(F.lit("  "), "title", F.lit(" "))).alias("title"),
        F.when(n % 4 == 2, F.col("year") + 1).otherwise(F.col("year")).alias("year"),
        F.when(n % 4 == 0, F.concat(F.lit(" "), F.upper("reference"))).alias("reference"))


_MATCH = """
cand AS (SELECT page_id % 5 AS project_id, page_id AS pos, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
                2000 + page_id % 10 AS year, CASE WHEN page_id % 7 > 0 THEN url END AS reference,
                CASE WHEN page_id % 11 > 0 THEN html END AS content FROM pages),
cat AS (SELECT project_id, 1000 - pos AS source_id, lower(trim(CASE WHEN pos % 4 = 3 THEN title || ' other' ELSE title END)) AS title,
               CASE WHEN pos % 4 = 2 THEN year + 1 ELSE year END AS year,
               lower(CASE WHEN pos % 4 = 0 THEN reference END) AS reference FROM cand),
m AS (SELECT c.*, coalesce(
   (SELECT min(source_id) FROM cat k WHERE k.project_id = c.project_id AND k.reference = lower(c.reference)),
   (SELECT min(source_id) FROM cat k WHERE k.project_id = c.project_id AND k.title = lower(trim(c.title)) AND k.title <> '' AND k.year = c.year),
   (SELECT min(source_id) FROM cat k WHERE k.project_id = c.project_id AND k.title = lower(trim(c.title)) AND k.title <> '')) AS existing_source_id
  FROM cand c)"""


@registry.add(f"WITH {_MATCH} SELECT pos, existing_source_id, existing_source_id IS NOT NULL AS already_added FROM m")
def catalog_match(spark, folder):
    marked = catalog.mark_candidates(_candidates(spark, folder), _catalogue(spark, folder))
    return marked.select("pos", "existing_source_id", "already_added")


@registry.add(f"""WITH {_MATCH},
v AS (SELECT *, coalesce(lower(reference), lower(trim(title))) AS k FROM m
      WHERE existing_source_id IS NULL AND trim(title) <> '' AND content IS NOT NULL),
u AS (SELECT *, row_number() OVER (PARTITION BY project_id, k ORDER BY pos) AS d FROM v)
SELECT project_id, pos, row_number() OVER (PARTITION BY project_id ORDER BY pos) AS import_rank, trim(title) AS title
FROM u WHERE d = 1""")
def catalog_import(spark, folder):
    catalogue = _catalogue(spark, folder).filter(F.col("reference").isNotNull())
    picked = catalog.select_imports(_candidates(spark, folder), catalogue)
    return picked.select("project_id", "pos", "import_rank", "title")


registry.sql["catalog_import"] = registry.sql["catalog_import"].replace(
    "AS reference FROM cand),", "AS reference FROM cand WHERE pos % 4 = 0 AND reference IS NOT NULL),")


def _sources(spark, folder):
    d = table(spark, folder, "documents")
    n = F.col("doc_id")
    return d.select(
        n.alias("source_id"), F.col("source").alias("project_id"), tx.first_meaningful_line(F.col("text")).alias("title"),
        F.col("text").alias("content"), F.col("lang").alias("authors"), F.concat(F.lit("ref_"), n.cast("string")).alias("reference"),
        (n * 7919 % 1000).alias("created_at"), F.when(n % 3 == 0, "manual").when(n % 3 == 1, "crossref").alias("origin"),
        (2000 + n % 30).cast("int").alias("year"))


@registry.add("""
SELECT doc_id AS source_id FROM documents
WHERE text ILIKE '%then_and%' OR lang ILIKE '%then_and%' OR ('ref_' || doc_id) ILIKE '%then_and%'
ORDER BY doc_id * 7919 % 1000 DESC, doc_id DESC LIMIT 10""")
def source_search(spark, folder):
    return catalog.search_sources(_sources(spark, folder), "then_and", 10).select("source_id")


@registry.add(f"""
SELECT doc_id AS source_id, CASE doc_id % 3 WHEN 1 THEN 'crossref' ELSE 'manual' END AS origin, doc_id % 3 = 1 AS is_external,
  CASE WHEN length(c) <= 240 THEN c ELSE rtrim(substr(c, 1, 237)) || '...' END AS excerpt
FROM (SELECT doc_id, {collapse('text')} AS c FROM documents)""")
def source_cards(spark, folder):
    cards = catalog.newest_first(catalog.source_card(_sources(spark, folder)), "source_id")
    return cards.select("source_id", "origin", "is_external", "excerpt")


def _memberships(spark, folder):
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("project_id"))
    return rows.agg(F.when(F.min("l_linenumber") == 1, "owner").otherwise("member").alias("role"))


def _projects(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("created_by_id"), F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("budget"), F.col("o_orderstatus").alias("kpi_metric"))


_MEMBERS = """
mem AS (SELECT l_suppkey AS user_id, l_orderkey AS project_id, CASE WHEN min(l_linenumber) = 1 THEN 'owner' ELSE 'member' END AS role
        FROM lineitem GROUP BY ALL)"""


@registry.add(f"WITH {_MEMBERS} SELECT user_id, project_id, role, o_totalprice AS budget FROM mem JOIN orders ON o_orderkey = project_id")
def membership_projects(spark, folder):
    mine = catalog.user_projects(_memberships(spark, folder), _projects(spark, folder))
    return mine.select("user_id", "project_id", "role", "budget")


@registry.add(f"""WITH {_MEMBERS}, r AS (SELECT o_orderkey AS project_id, o_custkey % 100 + 1 AS user_id FROM orders)
SELECT r.project_id, r.user_id, max(CASE WHEN role = 'owner' THEN 1 ELSE 0 END) = 1 AS is_owner
FROM r JOIN mem USING (project_id, user_id) GROUP BY ALL""")
def membership_access(spark, folder):
    """Requests of users for projects: those allowed, and whether an owner right is there."""
    asked = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("project_id"), (F.col("o_custkey") % 100 + 1).alias("user_id"))
    mem = _memberships(spark, folder)
    allowed, owned = catalog.accessible(asked, mem), catalog.accessible(asked, mem, owner_only=True)
    return allowed.join(owned.withColumn("o", F.lit(True)), ["user_id", "project_id"], "left").select(
        "project_id", "user_id", F.coalesce("o", F.lit(False)).alias("is_owner"))


@registry.add(f"""WITH {_MEMBERS} SELECT CAST(1 AS BIGINT) AS user_id, o_orderkey AS project_id, 'owner' AS role FROM orders
WHERE o_orderkey NOT IN (SELECT project_id FROM mem WHERE role = 'owner')""")
def orphan_claim(spark, folder):
    owners = _memberships(spark, folder).filter(F.col("role") == "owner")
    return catalog.claim_orphans(_projects(spark, folder), owners, 1)


@registry.add(f"""WITH {_MEMBERS} SELECT project_id, user_id, role, s_name AS username FROM mem LEFT JOIN supplier ON s_suppkey = user_id""")
def member_listing(spark, folder):
    users = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("username"))
    return catalog.members(_memberships(spark, folder), users).select("project_id", "user_id", "role", "username")


@registry.add("""
SELECT c_custkey AS project_id, count(DISTINCT o_orderkey) AS order_count, count(l_orderkey) AS line_count
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def child_counts(spark, folder):
    parents = table(spark, folder, "customer").select(F.col("c_custkey").alias("project_id"))
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("project_id"), "o_orderkey")
    lines = table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return catalog.with_child_counts(parents, "project_id", order=orders, line=lines)


@registry.add("""
SELECT l_orderkey, l_linenumber, count FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS count,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem) WHERE n BETWEEN 2 AND 4""")
def paged_list(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    return catalog.page_of_children(rows, "l_orderkey", "l_linenumber", limit=3, offset=1)


@registry.add("""SELECT o_custkey AS document_id, o_orderkey AS run_id FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_run(spark, folder):
    runs = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"))
    return catalog.latest(runs, "document_id", "run_id").select("document_id", "run_id")


@registry.add(f"""
WITH d AS (SELECT doc_id, text, {collapse('text')} AS c FROM documents),
ch AS (SELECT conv_id, count(*) AS n, string_agg(turn || ':' || role || ':' || CASE WHEN length(text) <= 700 THEN text
         ELSE regexp_replace(substr(text, 1, 700), '\\s+$', '') || '...' END, '|' ORDER BY turn) FILTER (WHERE turn < 10) AS s FROM conversations GROUP BY conv_id),
tb AS (SELECT item_id % 50 AS k, count(*) AS n FROM benchmark GROUP BY ALL),
rn AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS run_id FROM events GROUP BY user_id)
SELECT doc_id, length(text) AS raw_text_length, md5(CASE WHEN length(c) <= 1800 THEN c ELSE rtrim(substr(c, 1, 1800)) || '...' END) AS preview,
  coalesce(ch.n, 0) AS chunk_count, coalesce(tb.n, 0) AS table_count, md5(ch.s) AS chunks, CASE WHEN tb.n > 5 THEN 5 ELSE tb.n END AS tables, rn.run_id
FROM d LEFT JOIN ch ON conv_id = doc_id LEFT JOIN tb ON tb.k = doc_id LEFT JOIN rn ON user_id = doc_id""")
def review_bundle(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), F.lit("parsed").alias("parse_status"), F.col("text").alias("raw_text"))
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("role").alias("section_title"), F.lit("1").alias("page_ref"), "text")
    tabs = table(spark, folder, "benchmark").select(
        (F.col("item_id") % 50).alias("document_id"), F.col("item_id").alias("table_id"), F.lit("t").alias("table_name"),
        F.lit(1).alias("row_count"), F.split("text", " ").alias("rows"))
    runs = table(spark, folder, "events").select(
        F.col("user_id").alias("document_id"), F.col("event_id").alias("run_id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"))
    out = catalog.review_bundle(docs, turns, tabs, runs)
    texts = F.array_join(F.transform("chunks_sample", lambda s: F.concat(s["chunk_index"], F.lit(":"), s["section_title"], F.lit(":"), s["text"])), "|")
    return out.select(
        F.col("document_id").alias("doc_id"), F.col("raw_text_length").cast("long").alias("raw_text_length"), F.md5("raw_text_preview").alias("preview"),
        "chunk_count", "table_count", F.md5(texts).alias("chunks"),
        F.when(F.col("tables_sample").isNotNull(), F.size("tables_sample").cast("long")).alias("tables"),
        F.col("recent_parse_run.run_id").alias("run_id"))


@registry.add("""
SELECT doc_id AS document_id, CASE doc_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' ELSE 'warning' END AS status,
  CASE doc_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE 0.25 END::DOUBLE AS confidence, 0 AS n_issues FROM documents""")
def review_normalize(spark, folder):
    n = F.col("doc_id")
    raw = table(spark, folder, "documents").select(
        n.alias("document_id"), F.when(n % 5 == 0, "ok").when(n % 5 == 1, "failed").when(n % 5 == 2, "OK").alias("status"),
        F.when(n % 4 == 0, "-3").when(n % 4 == 1, "7").when(n % 4 == 2, "high").otherwise("0.25").alias("confidence"),
        F.lit(None).cast("string").alias("summary"), F.lit(None).cast("array<string>").alias("issues"), F.lit(None).cast("boolean").alias("needs_ocr"))
    return catalog.normalize_reviews(raw).select("document_id", "status", "confidence", F.size("issues").alias("n_issues"))


@registry.add("""
SELECT c_custkey AS project_id, CAST(p AS BIGINT) AS position, coalesce(nullif(nm, ''), 'Метрика эффективности') AS name, unit,
       CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS kpi_metric
FROM (SELECT *, unnest([0, 1, 2]) AS p, unnest([CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, '', c_mktsegment]) AS nm,
             unnest(['%', '', 'x']) AS unit FROM customer) WHERE nm <> '' OR unit <> ''""")
def metrics_sync(spark, folder):
    base = table(spark, folder, "customer")
    projects = base.select(F.col("c_custkey").alias("project_id"), F.lit("old").alias("kpi_metric"))

    def entry(name, unit):
        return F.struct(name.alias("name"), F.lit(unit).alias("unit"), F.lit(None).cast("string").alias("current"), F.lit(" ").alias("target"))

    first = F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_name"))
    lists = base.select(F.col("c_custkey").alias("project_id"),
                        F.array(entry(first, "%"), entry(F.lit(None).cast("string"), " "), entry(F.col("c_mktsegment"), "x")).alias("metrics"))
    updated, rows = catalog.sync_metrics(projects, lists)
    return rows.join(updated, "project_id").select("project_id", "position", "name", "unit", "kpi_metric")


def _patches(rows, key):
    n = F.col(key)
    return rows.select(key, F.when(n % 3 == 0, F.create_map(F.lit("title"), F.lit("new title"), F.lit("year"), F.lit("abc")))
                       .when(n % 3 == 1, F.create_map(F.lit("year"), F.lit(" 1999 "), F.lit("authors"), F.lit(None).cast("string"))).alias("patch"))


@registry.add("""
SELECT doc_id AS source_id, CASE WHEN doc_id % 3 = 0 THEN 'new title' ELSE
   list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) BETWEEN 4 AND 180)[1] END AS title,
  CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 1999 ELSE CAST(2000 + doc_id % 30 AS INT) END AS year,
  CASE WHEN doc_id % 3 = 1 THEN NULL ELSE lang END AS authors FROM documents""")
def source_patch(spark, folder):
    base = _sources(spark, folder)
    out = catalog.patch_rows(base, _patches(base, "source_id"), "source_id", ["title", "content", "source_type", "authors", "year", "reference"])
    return out.select("source_id", "title", "year", "authors")


@registry.add("""
WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT 'orders' AS name, count(*) AS rows FROM orders WHERE o_orderkey NOT IN (FROM gone)
UNION ALL SELECT 'documents', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM gone)
UNION ALL SELECT 'chunks', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM gone)""")
def cascade_delete(spark, folder):
    """Orders are projects, lines are documents, and every line has one chunk."""
    projects = table(spark, folder, "orders").withColumnRenamed("o_orderkey", "project_id")
    documents = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("document_id"))
    left = catalog.delete_cascade({"orders": projects, "documents": documents, "chunks": documents.select("document_id")},
                                  projects.filter(F.col("o_orderstatus") == "F"))
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@registry.add("""
WITH parsed AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system')
SELECT conv_id AS document_id, turn AS chunk_index, text FROM conversations WHERE conv_id NOT IN (FROM parsed)
UNION ALL SELECT conv_id, turn, 'new ' || text FROM conversations WHERE conv_id IN (FROM parsed) AND role <> 'user'""")
def replace_content(spark, folder):
    """Conversations with a system turn are parsed again and lose their user turns."""
    old = table(spark, folder, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), "text", "role")
    parsed = old.filter(F.col("role") == "system").select("document_id").distinct()
    new = old.join(parsed, "document_id", "left_semi").filter(F.col("role") != "user").withColumn("text", F.concat(F.lit("new "), "text"))
    once = catalog.replace_children(old, new, parsed)
    return catalog.replace_children(once, new, parsed).select("document_id", "chunk_index", "text")


@registry.add("SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS topic, CAST(NULL AS BIGINT) AS created_by_id FROM region")
def evolve_schema(spark, folder):
    wanted = T.StructType().add("r_name", T.StringType()).add("topic", T.StringType()).add("created_by_id", T.LongType())
    return catalog.add_missing_columns(table(spark, folder, "region").select("r_regionkey", "r_name"), wanted)


@registry.add("""
SELECT conv_id, turn, trim(text, chr(10) || ' ') AS content, 'manual' AS origin FROM conversations WHERE role <> 'system' AND trim(text, chr(10) || ' ') <> ''
UNION ALL SELECT conv_id, turn, NULL, 'rejected' FROM conversations WHERE role = 'system' OR trim(text, chr(10) || ' ') = ''""")
def source_insert(spark, folder):
    rows = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") != "system", F.concat(F.lit(" "), "role")).alias("title"), F.col("text").alias("content"))
    good, bad = catalog.validate_sources(rows)
    return good.select("conv_id", "turn", "content", "origin").unionByName(
        bad.select("conv_id", "turn", F.lit(None).cast("string").alias("content"), F.lit("rejected").alias("origin")))


@registry.add("""
SELECT page_id AS document_id, CASE WHEN page_id % 4 = 3 THEN 'unsupported' WHEN page_id % 5 = 0 THEN 'failed' ELSE 'parsed' END AS status,
  CASE WHEN page_id % 4 = 3 THEN 'format unsupported' WHEN page_id % 5 = 0 THEN 'broken ' || page_id END AS error,
  CASE WHEN page_id % 4 = 3 THEN 'format unsupported' ELSE '' END AS warnings FROM pages""")
def parse_log(spark, folder):
    n = F.col("page_id")
    docs = table(spark, folder, "pages").select(n.alias("document_id"), F.when(n % 4 == 3, "zip").otherwise("txt").alias("file_type"))
    outcome = table(spark, folder, "pages").select(
        n.alias("document_id"), F.lit(None).cast("array<string>").alias("warnings"),
        F.when(n % 5 == 0, F.concat(F.lit("broken "), n.cast("string"))).alias("error"))
    return catalog.parse_log(docs, outcome).select("document_id", "status", "error", F.array_join("warnings", ",").alias("warnings"))


@registry.add("""
SELECT doc_id AS document_id, 'Document ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'dataset' ELSE 'uploaded_document' END AS source_type,
  md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS body FROM documents
WHERE doc_id % 3 > 0 AND (regexp_replace(text, '\\s', '', 'g') <> '' OR doc_id IN (SELECT conv_id FROM conversations))""")
def retrieval_documents(spark, folder):
    n = F.col("doc_id")
    none = F.lit(None).cast("string")
    meta = F.struct(none.alias("title"), none.alias("summary"), none.alias("description"), none.alias("source_type"),
                    F.array(F.lit(" a ")).alias("authors"), F.lit(None).cast("int").alias("year"))
    docs = table(spark, folder, "documents").select(
        n.alias("document_id"), F.concat(F.lit("Document "), n.cast("string")).alias("filename"), meta.alias("metadata"),
        F.when(n % 2 == 0, "csv").otherwise("txt").alias("file_type"), F.when(n % 3 > 0, "parsed").otherwise("failed").alias("parse_status"),
        F.col("text").alias("raw_text"))
    chunks = table(spark, folder, "conversations").select(F.col("conv_id").alias("document_id"))
    return catalog.document_facts(catalog.retrieval_documents(docs, chunks)).select(
        "document_id", "title", "source_type", F.md5("content").alias("body"))


@registry.add(f"""
SELECT d.doc_id AS document_id, CASE WHEN length(c) <= 500 THEN c ELSE rtrim(substr(c, 1, 497)) || '...' END AS raw_text_preview,
  CASE WHEN d.doc_id % 3 = 0 THEN lang ELSE source END AS summary, coalesce(k.n, 0) AS chunk_count, coalesce(t.n, 0) AS table_count
FROM (SELECT *, {collapse('text')} AS c FROM documents) d
LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) k ON k.conv_id = d.doc_id
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) t ON t.l_orderkey = d.doc_id""")
def document_cards(spark, folder):
    n = F.col("doc_id")
    docs = table(spark, folder, "documents").select(
        n.alias("document_id"), F.col("text").alias("raw_text"),
        F.struct(F.when(n % 3 == 0, F.col("lang")).when(n % 3 == 1, F.lit("")).alias("summary"), F.col("source").alias("description")).alias("metadata"))
    chunks = table(spark, folder, "conversations").select(F.col("conv_id").alias("document_id"))
    tables = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("document_id"))
    return catalog.document_card(docs, chunks, tables).select("document_id", "raw_text_preview", "summary", "chunk_count", "table_count")
