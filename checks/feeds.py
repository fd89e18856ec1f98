"""Feeds: raw JSON written from the tables, read back through the normalisers."""

from functools import reduce

from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.sources import feeds
from . import Registry, table
from .sqltext import collapse

registry = Registry()
ORDER = ["openalex", "crossref", "semantic_scholar", "materials_project"]


def _json(rows, feed, pos, **fields):
    body = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return rows.select(F.lit(feed).alias("feed"), F.col(pos).alias("pos"), body.alias("json"))


def _works(spark, folder):
    n = F.col("doc_id")
    rows = table(spark, folder, "documents").where(n.isNotNull()).groupBy("doc_id").agg(F.collect_list(F.struct("text")).alias("texts"))
    words = F.transform("texts", lambda x: F.split(tx.collapse(x["text"]), " "))
    docs = rows.select("doc_id", tx.inverted_index(words).alias("inv"), "texts").select("doc_id", "inv", F.inline("texts"))
    people = F.transform(F.sequence(F.lit(0), (n % 7).cast("int")),
                         lambda i: F.struct(F.struct(F.concat(F.lit(" A"), i.cast("string")).alias("display_name")).alias("author")))
    place = F.struct(F.when(n % 2 == 0, F.concat(F.lit("https://l/"), n.cast("string"))).alias("landing_page_url"),
                     F.struct(F.concat(F.lit("J"), (n % 5).cast("string")).alias("display_name"), F.lit("https://home").alias("homepage_url")).alias("source"))
    return _json(docs, "openalex", "doc_id",
                 id=F.concat(F.lit("https://w/"), n.cast("string")),
                 doi=F.when(n % 3 == 0, F.concat(F.lit("https://doi.org/10.1/D"), (n % 50).cast("string"))),
                 display_name=tx.first_meaningful_line(F.col("text")), publication_year=(2000 + n % 25).cast("int"),
                 abstract_inverted_index=F.col("inv"), authorships=people, primary_location=place,
                 open_access=F.struct((n % 2 == 1).alias("is_oa"), F.concat(F.lit("https://oa/"), n.cast("string"), F.lit(".PDF")).alias("oa_url")))


def _publications(spark, folder):
    n = F.col("page_id")
    return _json(table(spark, folder, "pages"), "crossref", "page_id", **{
        "title": F.array(F.regexp_extract("html", "<title>([^<]*)</title>", 1)),
        "author": F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit("Ann").alias("given"), F.col("url").alias("family"))),
        "issued": F.struct(F.array(F.array((2000 + n % 20).cast("int"), F.lit(3))).alias("date-parts")),
        "DOI": F.when(n % 2 == 0, F.concat(F.lit("10.1/D"), (n % 60).cast("string"))),
        "abstract": F.col("html"), "container-title": F.array(F.lit(" Pages ")), "URL": F.col("url")})


def _papers(spark, folder):
    n = F.col("conv_id")
    return _json(table(spark, folder, "conversations").withColumn("pos", n * 1000 + F.col("turn")), "semantic_scholar", "pos",
                 title=F.when(F.col("role") != "system", F.substring(tx.collapse(F.col("text")), 1, 60)),
                 abstract=F.when(F.col("turn") % 2 == 0, F.col("text")), venue=F.col("role"),
                 tldr=F.struct(F.concat(F.lit("In short: "), F.col("role")).alias("text")), year=(2010 + n % 3).cast("int"),
                 authors=F.array(F.struct(F.col("role").alias("name"))))


def _materials(spark, folder):
    n = F.col("p_partkey")
    return _json(table(spark, folder, "part"), "materials_project", "p_partkey",
                 material_id=F.concat(F.lit("mp-"), n.cast("string")), formula_pretty=F.col("p_brand"),
                 band_gap=F.when(n % 2 == 0, F.col("p_size") / 4.0), density=F.col("p_retailprice"), is_stable=n % 3 == 0)


_WORK = f"""
SELECT doc_id AS pos, 'https://w/' || doc_id AS external_id,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) BETWEEN 4 AND 180)[1] AS title,
  array_to_string(list_transform(range(least(doc_id % 7 + 1, 4)), lambda i: 'A' || i), ', ') || CASE WHEN doc_id % 7 + 1 > 4 THEN ' et al.' ELSE '' END AS authors,
  CAST(2000 + doc_id % 25 AS INT) AS year,
  CASE WHEN doc_id % 3 = 0 THEN 'https://doi.org/10.1/D' || (doc_id % 50) WHEN doc_id % 2 = 0 THEN 'https://l/' || doc_id ELSE 'https://home' END AS reference,
  {collapse('text')} AS content, 'J' || (doc_id % 5) AS journal,
  CASE WHEN doc_id % 2 = 0 THEN 'https://l/' || doc_id ELSE 'https://home' END AS landing_page_url,
  'https://oa/' || doc_id || '.PDF' AS pdf_url, doc_id % 2 = 1 AS is_open_access, 'openalex' AS origin, 0 AS priority FROM documents"""
_PUBLICATION = """
SELECT page_id AS pos, CASE WHEN page_id % 2 = 0 THEN 'https://doi.org/10.1/D' || (page_id % 60) ELSE url END AS external_id,
  trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, 'Ann ' || url AS authors, CAST(2000 + page_id % 20 AS INT) AS year,
  CASE WHEN page_id % 2 = 0 THEN 'https://doi.org/10.1/D' || (page_id % 60) ELSE url END AS reference,
  regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS content, 'Pages' AS journal,
  url AS landing_page_url, NULL AS pdf_url, NULL AS is_open_access, 'crossref' AS origin, 1 AS priority FROM pages"""
_PAPER = f"""
SELECT conv_id * 1000 + turn AS pos, '' AS external_id, trim(substr({collapse('text')}, 1, 60)) AS title, role AS authors,
  CAST(2010 + conv_id % 3 AS INT) AS year, NULL AS reference,
  CASE WHEN turn % 2 = 0 AND trim(text, chr(10) || ' ') <> '' THEN trim(text, chr(10) || ' ') ELSE 'In short: ' || role END AS content,
  role AS journal, NULL AS landing_page_url, NULL AS pdf_url, false AS is_open_access, 'semantic_scholar' AS origin, 2 AS priority
FROM conversations WHERE role <> 'system'"""
_MATERIAL = """
SELECT p_partkey AS pos, 'mp-' || p_partkey AS external_id, p_brand || ' — расчётные свойства (Materials Project)' AS title,
  'Materials Project' AS authors, CAST(NULL AS INT) AS year, 'https://materialsproject.org/materials/mp-' || p_partkey AS reference,
  'Материал ' || p_brand || ' (Materials Project). ' || concat_ws('; ',
    CASE WHEN p_partkey % 2 = 0 THEN 'band_gap=' || (p_size / 4.0)::DOUBLE || ' эВ' END,
    'плотность=' || p_retailprice || ' г/см³', CASE WHEN p_partkey % 3 = 0 THEN 'термодинамически стабильна' END) || '.' AS content,
  'Materials Project' AS journal, 'https://materialsproject.org/materials/mp-' || p_partkey AS landing_page_url, NULL AS pdf_url,
  true AS is_open_access, 'materials_project' AS origin, 3 AS priority FROM part"""
_COLS = ("pos, external_id, title, authors, year, reference, journal, landing_page_url, pdf_url, is_open_access, "
         "length(content) AS n_chars, md5(content) AS body")


def _shown(records):
    return records.select(
        "pos", "external_id", "title", "authors", "year", "reference", "journal", "landing_page_url", "pdf_url",
        "is_open_access", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("body"))


def _register(key, feed, raw, sql):
    @registry.add(f"SELECT {_COLS} FROM ({sql}) WHERE title <> ''", name=key)
    def query(spark, folder):
        return _shown(feeds.normalize(raw(spark, folder), feed))


_register("feed_works", "openalex", _works, _WORK)
_register("feed_publications", "crossref", _publications, _PUBLICATION)
_register("feed_papers", "semantic_scholar", _papers, _PAPER)
_register("feed_materials", "materials_project", _materials, _MATERIAL)


def raw_feeds(spark, folder):
    return reduce(lambda a, b: a.unionByName(b), [f(spark, folder) for f in (_works, _publications, _papers, _materials)])


UNION_SQL = f"""
a AS ({_WORK} UNION ALL BY NAME {_PUBLICATION} UNION ALL BY NAME {_PAPER} UNION ALL BY NAME {_MATERIAL}),
keyed AS (SELECT *, CASE WHEN coalesce(reference, '') <> ''
    THEN 'doi:' || regexp_replace(lower(trim(reference)), '^https?://(dx\\.)?doi\\.org/', '')
    ELSE 'tt:' || lower(title) || '|' || coalesce(CAST(year AS VARCHAR), 'None') END AS dedupe_key
  FROM a WHERE title <> '' AND trim(content) <> ''),
kept AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY priority, pos) AS r FROM keyed)"""


@registry.add(f"WITH {UNION_SQL} SELECT origin, pos, dedupe_key, title, year, md5(content) AS body FROM kept WHERE r = 1")
def ordered_dedup_union(spark, folder):
    kept = feeds.combine(raw_feeds(spark, folder), ORDER)
    return kept.select("origin", "pos", "dedupe_key", "title", "year", F.md5("content").alias("body"))


@registry.add(f"""WITH {UNION_SQL},
feeds AS (SELECT * FROM (VALUES ('openalex'), ('crossref'), ('semantic_scholar'), ('materials_project')) f(feed))
SELECT feed, count(origin) AS kept, CAST(CASE feed WHEN 'crossref' THEN (SELECT count(*) FROM supplier) ELSE 0 END AS BIGINT) AS errors
FROM feeds LEFT JOIN kept ON origin = feed AND r = 1 GROUP BY feed""")
def feed_stats(spark, folder):
    """One unreadable line per supplier is put into the second feed."""
    broken = table(spark, folder, "supplier").select(
        F.lit("crossref").alias("feed"), (F.col("s_suppkey") + 10**9).alias("pos"), F.concat(F.lit('{"title": ['), "s_name").alias("json"))
    raw = raw_feeds(spark, folder).unionByName(broken)
    return feeds.feed_stats(raw, feeds.combine(raw, ORDER), ORDER).select("feed", "kept", "errors")
