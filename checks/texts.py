"""Text functions, metadata, summaries, passages and chunks."""

from pyspark.sql import functions as F

from siftline.functions import text as tx, vocab
from siftline.operators import chunks, summaries
from siftline.operators.ranking import ordinal
from siftline.plans import sources
from . import Registry, table
from .sqltext import collapse, lang, letters, summary_key, tokens, words

registry = Registry()


def _docs(spark, folder):
    return table(spark, folder, "documents")


_LIB = (f"list_distinct(list_filter(regexp_extract_all(replace(lower({collapse('text')}), 'ё', 'е'), '[a-zа-я0-9\\-]+'), "
        f"lambda t: length(t) >= 3 AND NOT list_contains({words(vocab.LIBRARY_STOP)}, t) "
        f"AND NOT regexp_full_match(t, '\\d+')))")


@registry.add(f"""
SELECT doc_id, len({tokens('text')}) AS n_tokens, md5(array_to_string({tokens('text')}, ' ')) AS tokens,
       len(list_filter(regexp_extract_all(lower(text), '[a-zа-я0-9][a-zа-я0-9\\-]+'),
           lambda t: NOT list_contains({words(vocab.RU_STOP)}, t))) AS n_tfidf,
       len({_LIB}) AS n_library, md5(array_to_string(list_sort({_LIB}), ' ')) AS library
FROM documents""")
def token_profile(spark, folder):
    text = F.col("text")
    lib = tx.library_tokens(text)
    return _docs(spark, folder).select(
        "doc_id", F.size(tx.tokenize(text)).cast("long").alias("n_tokens"),
        F.md5(F.array_join(tx.tokenize(text), " ")).alias("tokens"),
        F.size(tx.tokenize_tfidf(text)).cast("long").alias("n_tfidf"),
        F.size(lib).cast("long").alias("n_library"), F.md5(F.array_join(F.array_sort(lib), " ")).alias("library"))


@registry.add(f"""
SELECT doc_id, {lang('text')} AS lang, CASE WHEN c + l < 40 THEN NULL WHEN c::DOUBLE / (c + l) > 0.55 THEN 'ru'
       WHEN l::DOUBLE / (c + l) > 0.55 THEN 'en' ELSE 'mixed' END AS language
FROM (SELECT doc_id, text, length(regexp_replace(text, '[^А-Яа-яЁё]', '', 'g')) AS c,
             length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM documents)""")
def language_detect(spark, folder):
    return _docs(spark, folder).select(
        "doc_id", tx.detect_lang(F.col("text")).alias("lang"), tx.detect_language(F.col("text")).alias("language"))


_C = collapse("text")


@registry.add(f"""
SELECT doc_id, md5(c) AS collapsed,
  md5(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n|\\r', '\n', 'g'), '[ \\t]+\\n', '\n', 'g'), '^\\s+|\\s+$', '', 'g')) AS cleaned,
  CASE WHEN length(c) <= 240 THEN c ELSE rtrim(substr(c, 1, 237)) || '...' END AS excerpt,
  CASE WHEN length(c) <= 165 THEN c ELSE rtrim(substr(c, 1, 165)) || '...' END AS clipped,
  CASE WHEN length(c) <= 22 THEN c ELSE rtrim(substr(c, 1, 21)) || '…' END AS short,
  CASE WHEN length(c) <= 220 THEN c
       WHEN strpos(substr(c, 1, 221), ' ') > 0 AND 221 - strpos(reverse(substr(c, 1, 221)), ' ') >= 132
       THEN rtrim(substr(c, 1, 221 - strpos(reverse(substr(c, 1, 221)), ' ')), ' ,;:-') || '...'
       ELSE rtrim(substr(c, 1, 220), ' ,;:-') || '...' END AS at_word,
  md5(CASE WHEN length(c) <= 900 THEN c
       ELSE rtrim(substr(c, 1, 540), ' ,;:-') || ' ... ' || ltrim(right(c, 355), ' ,;:-') END) AS head_tail
FROM (SELECT doc_id, text, {_C} AS c FROM documents)""")
def text_cuts(spark, folder):
    c = tx.collapse(F.col("text"))
    return _docs(spark, folder).select(
        "doc_id", F.md5(c).alias("collapsed"), F.md5(tx.clean_text(F.col("text"))).alias("cleaned"),
        tx.excerpt(F.col("text")).alias("excerpt"), tx.cut(c, 165).alias("clipped"),
        tx.cut(c, 22, 21, "…").alias("short"), tx.trim_at_word(F.col("text")).alias("at_word"),
        F.md5(tx.head_tail(F.col("text"), F.lit(900))).alias("head_tail"))


@registry.add("""
SELECT page_id, length(t) AS n_chars, md5(t) AS body, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title
FROM (SELECT page_id, html, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM pages)""")
def markup_strip(spark, folder):
    body = tx.strip_tags(F.col("html"))
    return table(spark, folder, "pages").select(
        "page_id", F.length(body).cast("long").alias("n_chars"), F.md5(body).alias("body"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


_REF_TEXT = "'See ' || url || ', doi 10.' || (1000 + page_id % 9000) || '/AB.' || page_id || '; ' || html || ' (' || upper(url) || '.)'"


@registry.add(f"""
WITH t AS (SELECT page_id, {_REF_TEXT} AS x FROM pages),
f AS (SELECT page_id, x, list_transform(
        list_concat(regexp_extract_all(x, '(?i)\\b10\\.\\d{{4,9}}/[-._;()/:A-Z0-9]+\\b'),
                    regexp_extract_all(x, '(?i)https?://[^\\s)>\\]]+')),
        lambda r: rtrim(r, '.,;')) AS refs FROM t)
SELECT page_id, CASE WHEN regexp_extract(x, '\\b(?:19|20)\\d{{2}}\\b') = '' THEN NULL
                     ELSE CAST(regexp_extract(x, '\\b(?:19|20)\\d{{2}}\\b') AS INT) END AS year,
       array_to_string((list_filter(refs, lambda r, i:
           list_position(list_transform(refs, lambda z: lower(z)), lower(r)) = i)), ' ') AS refs
FROM f""")
def reference_extract(spark, folder):
    pages = table(spark, folder, "pages")
    pid = F.col("page_id")
    text = F.concat(F.lit("See "), "url", F.lit(", doi 10."), (1000 + pid % 9000).cast("string"), F.lit("/AB."),
                    pid.cast("string"), F.lit("; "), "html", F.lit(" ("), F.upper("url"), F.lit(".)"))
    return pages.select("page_id", tx.extract_year(text).alias("year"),
                        F.array_join(tx.references(text), " ").alias("refs"))


@registry.add("""
WITH n AS (SELECT p_partkey, list_filter(list_transform(
             regexp_split_to_array(p_name || '; ' || p_brand || ', ' || p_type || ' and ' || p_name, ';|,|\\band\\b'),
             lambda x: trim(x)), lambda x: x <> '') AS names FROM part)
SELECT p_partkey, array_to_string(names, '|') AS names,
       array_to_string(names[:3], ', ') || CASE WHEN len(names) > 3 THEN ' et al.' ELSE '' END AS line FROM n""")
def author_lines(spark, folder):
    text = F.concat("p_name", F.lit("; "), "p_brand", F.lit(", "), "p_type", F.lit(" and "), "p_name")
    names = tx.split_names(text)
    return table(spark, folder, "part").select(
        "p_partkey", F.array_join(names, "|").alias("names"), tx.author_line(names, 3).alias("line"))


@registry.add("""
SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
                           lambda x: length(x) BETWEEN 4 AND 180)[1] AS first_line FROM documents""")
def first_lines(spark, folder):
    return _docs(spark, folder).select("doc_id", tx.first_meaningful_line(F.col("text")).alias("first_line"))


@registry.add(f"""
SELECT doc_id, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), ',') AS elements
FROM (SELECT doc_id, list_filter(
        list_transform(regexp_extract_all(regexp_replace(' ' || text || ' ', '[^\\p{{L}}\\p{{N}}_]+', '  ', 'g'), ' [A-Z][a-z]? '), lambda x: trim(x)),
        lambda x: list_contains({words(vocab.ELEMENTS)}, x)) AS e FROM documents)""")
def element_symbols(spark, folder):
    return _docs(spark, folder).select("doc_id", F.array_join(tx.elements(F.col("text")), ",").alias("elements"))


_RULES = " ".join(
    f"WHEN regexp_matches(h, '{'|'.join(ws)}') THEN '{label}'" for label, ws in vocab.TABLE_CLASSES)


@registry.add(f"""
SELECT doc_id, CASE {_RULES} END AS class
FROM (SELECT doc_id, lower(source || ' ' || regexp_replace(text, '\\|', ' ', 'g')) AS h FROM documents)""")
def table_classes(spark, folder):
    return _docs(spark, folder).select(
        "doc_id", tx.classify_table(F.col("source"), F.split("text", r"\|")).alias("class"))


@registry.add("""
SELECT page_id, len(regexp_extract_all(regexp_replace(html, '[^A-Za-z0-9_.,]', ' ', 'g'), '\\b\\d+(?:[.,]\\d+)?\\b')) AS numbers
FROM pages""")
def number_counts(spark, folder):
    ascii_only = F.regexp_replace("html", "[^A-Za-z0-9_.,]", " ")
    return table(spark, folder, "pages").select("page_id", tx.count_numbers(ascii_only).cast("long").alias("numbers"))


@registry.add(f"""
SELECT doc_id, md5(array_to_string({tokens('text')}, ' ')) AS rebuilt FROM documents WHERE len({tokens('text')}) > 0""")
def inverted_index_roundtrip(spark, folder):
    """Token -> positions, then back to text."""
    texts = _docs(spark, folder).groupBy("doc_id").agg(F.collect_list(F.struct("text")).alias("texts"))
    tokens = F.transform("texts", lambda x: tx.tokenize(x["text"]))
    index = texts.select("doc_id", tx.inverted_index(tokens).alias("index")).where(F.size("index") > 0)
    return index.select("doc_id", F.md5(tx.inverted_index_text(F.col("index"))).alias("rebuilt"))


@registry.add("""
SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k,
       CASE event_id % 4 WHEN 3 THEN true ELSE false END AS failed
FROM (SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE props END AS props FROM events)""")
def json_salvage(spark, folder):
    """Model answers: fenced, bare, inside prose, and one in four broken."""
    n = F.col("event_id") % 4
    answer = (
        F.when(n == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nbye")))
        .when(n == 1, F.col("props"))
        .when(n == 2, F.concat(F.lit("The answer is "), "props", F.lit(" as asked.")))
        .otherwise(F.concat(F.lit("no "), F.translate("props", "}", "{"))))
    body = tx.salvage_json(answer)
    return table(spark, folder, "events").select(
        "event_id", F.get_json_object(body, "$.k").cast("long").alias("k"), body.isNull().alias("failed"))


@registry.add("""
SELECT l_orderkey, l_linenumber, 'S' || l_linenumber AS sid,
       CASE WHEN l_linenumber % 2 = 0 THEN 'lib:' || lower(l_returnflag)
            WHEN l_suppkey % 3 > 0 THEN 'document:' || (l_suppkey % 3) END AS key FROM lineitem""")
def citation_keys(spark, folder):
    n = F.col("l_linenumber")
    raw = F.concat(F.lit(" [[s"), n.cast("string"), F.lit("] "))
    key = tx.evidence_key(
        F.when(n % 2 == 0, F.concat(F.lit(" LIB:"), "l_returnflag")).otherwise(""), F.lit("Document"),
        F.col("l_suppkey") % 3)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", tx.citation_id(raw).alias("sid"), key.alias("key"))


_TITLES = "list_filter([first_line, source], lambda x: x IS NOT NULL AND trim(x) <> '')"


def _title_only(key: str, titles: str) -> str:
    k = summary_key("z")
    return (f"(length({key}) < 12 OR len(list_filter(list_transform({titles}, lambda z: {k}), lambda w: w <> '' AND "
            f"({key} = w OR (length({key}) <= length(w) + 12 AND (starts_with({key}, w) OR starts_with(w, {key})))))) > 0)")


_SENTENCES = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


@registry.add(f"""
WITH d AS (SELECT doc_id, text, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
                  lambda x: length(x) BETWEEN 4 AND 180)[1] AS first_line FROM documents),
s AS (SELECT doc_id, {_TITLES} AS titles, unnest({_SENTENCES}) AS s, generate_subscripts({_SENTENCES}, 1) AS i FROM d),
f AS (SELECT doc_id, titles, i, regexp_replace({collapse('s')}, '^[ \\-:;,.''"]+|[ \\-:;,.''"]+$', '', 'g') AS f FROM s),
g AS (SELECT *, {summary_key('f')} AS k FROM f WHERE length(f) >= 24 AND {letters('f')} >= 12),
six AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM g WHERE NOT {_title_only('k', 'titles')}),
two AS (SELECT doc_id, titles, f, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id, lower(f) ORDER BY i) AS d FROM six WHERE n <= 6) WHERE d = 1),
j AS (SELECT doc_id, any_value(titles) AS titles, string_agg(f, ' ' ORDER BY i) AS c FROM two WHERE n <= 2 GROUP BY doc_id),
t AS (SELECT doc_id, titles, CASE WHEN length(c) <= 220 THEN c
       WHEN strpos(substr(c, 1, 221), ' ') > 0 AND 221 - strpos(reverse(substr(c, 1, 221)), ' ') >= 132
       THEN rtrim(substr(c, 1, 221 - strpos(reverse(substr(c, 1, 221)), ' ')), ' ,;:-') || '...'
       ELSE rtrim(substr(c, 1, 220), ' ,;:-') || '...' END AS summary FROM j)
SELECT d.doc_id, CASE WHEN NOT {_title_only(summary_key('summary'), 't.titles')} THEN summary END AS summary
FROM d LEFT JOIN t USING (doc_id)""")
def heuristic_summary(spark, folder):
    titles = F.filter(F.array(tx.first_meaningful_line(F.col("text")), F.col("source")),
                      lambda x: x.isNotNull() & (F.trim(x) != ""))
    return _docs(spark, folder).select("doc_id", tx.heuristic_summary(F.col("text"), titles).alias("summary"))


@registry.add("""
SELECT doc_id, first_line AS title, 'src' AS authors, year, source_type, language, n_refs FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
                             lambda x: length(x) BETWEEN 4 AND 180)[1] AS first_line,
         CASE WHEN regexp_extract(text, '\\b(?:19|20)\\d{2}\\b') = '' THEN NULL
              ELSE CAST(regexp_extract(text, '\\b(?:19|20)\\d{2}\\b') AS INT) END AS year,
         'uploaded' AS source_type,
         CASE WHEN l < 40 THEN NULL ELSE 'en' END AS language,
         CAST((len(list_distinct(list_transform(regexp_extract_all(text, '(?i)https?://[^\\s)>\\]]+'),
               lambda r: lower(rtrim(r, '.,;')))))) AS BIGINT) AS n_refs
  FROM (SELECT *, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM documents))""")
def metadata_enrichment(spark, folder):
    meta = summaries.enrich(
        F.col("text"), authors=F.array(F.lit(" src ")), source_type=F.lit("uploaded"))
    return _docs(spark, folder).select("doc_id", meta.alias("m")).select(
        "doc_id", "m.title", F.array_join("m.authors", ",").alias("authors"), "m.year", "m.source_type",
        "m.language", F.size("m.references").cast("long").alias("n_refs"))


_BODY = f"trim('Document ' || doc_id || '. ' || {_C})"


def _rfind(win: str, mark: str) -> str:
    r = mark[::-1]
    return f"(CASE WHEN strpos({win}, '{mark}') = 0 THEN -1 ELSE length({win}) - strpos(reverse({win}), '{r}') - {len(mark) - 1} END)"


_PASSAGE_STEP = f"""
  SELECT doc_id, x, s, CASE WHEN s + 900 >= length(x) THEN s + 900 WHEN b > 0 THEN s + b + 1 ELSE s + 900 END AS e FROM (
    SELECT doc_id, x, s, CASE WHEN b0 < 450 THEN {_rfind('w', ' ')} ELSE b0 END AS b FROM (
      SELECT doc_id, x, s, w, greatest({_rfind('w', '. ')}, {_rfind('w', '! ')}, {_rfind('w', '? ')}) AS b0 FROM (
        SELECT doc_id, x, s, substr(x, s + 1, 900) AS w FROM {{src}})))"""


@registry.add(f"""
WITH RECURSIVE t AS (SELECT doc_id, {_BODY} AS x, CAST(0 AS BIGINT) AS s FROM documents),
w AS ({_PASSAGE_STEP.format(src='t')}
  UNION ALL {_PASSAGE_STEP.format(src='(SELECT doc_id, x, greatest(e - 150, s + 1) AS s FROM w WHERE e < length(x))')})
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk,
       length(trim(substr(x, s + 1, e - s))) AS n_chars, md5(trim(substr(x, s + 1, e - s))) AS body FROM w""")
def passage_chunks(spark, folder):
    whole = F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit(". "), "text")
    cut = _docs(spark, folder).select("doc_id", F.posexplode(chunks.split_passages(whole)).alias("chunk", "piece"))
    return cut.select("doc_id", F.col("chunk").cast("long").alias("chunk"),
                      F.length("piece").cast("long").alias("n_chars"), F.md5("piece").alias("body"))


_PARAS = r"string_split(regexp_replace(text, '([.!?])\s+([A-ZА-Я0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))"

_PACKED = f"""
p0 AS (SELECT doc_id, generate_subscripts({_PARAS}, 1) AS i, unnest({_PARAS}) AS q FROM documents),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, c, length(c) AS n
      FROM (SELECT doc_id, i, {collapse('q')} AS c FROM p0) WHERE c <> ''),
k AS (SELECT doc_id, i, n, c, CAST(0 AS BIGINT) AS seq, CASE WHEN n > 1600 THEN 0 ELSE n + 1 END AS used FROM p WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.i, p.n, p.c,
         CASE WHEN p.n > 1600 OR k.n > 1600 OR k.used + p.n + 1 > 1600 THEN k.seq + 1 ELSE k.seq END,
         CASE WHEN p.n > 1600 THEN 0 WHEN k.n > 1600 OR k.used + p.n + 1 > 1600 THEN p.n + 1 ELSE k.used + p.n + 1 END
  FROM k JOIN p ON p.doc_id = k.doc_id AND p.i = k.i + 1),
packed AS (SELECT doc_id, seq, string_agg(c, ' ' ORDER BY i) AS c FROM k WHERE n <= 1600 GROUP BY ALL),
l AS ({{first}} UNION ALL {{rest}})"""

_LONG_STEP = """SELECT doc_id, seq, x, s, CASE WHEN s + 1600 >= length(x) THEN length(x)
   WHEN strpos(w, ' ') > 0 AND 1600 - strpos(reverse(w), ' ') > 800 THEN s + 1600 - strpos(reverse(w), ' ') + 1
   ELSE s + 1600 END AS e
  FROM (SELECT doc_id, seq, x, s, substr(x, s + 1, 1600) AS w FROM {src})"""

_SECTION_SQL = "WITH RECURSIVE " + _PACKED.format(
    first=_LONG_STEP.format(src="(SELECT doc_id, seq, c AS x, CAST(0 AS BIGINT) AS s FROM k WHERE n > 1600)"),
    rest=_LONG_STEP.format(src="(SELECT doc_id, seq, x, greatest(0, e - 180) AS s FROM l WHERE e < length(x))"))


@registry.add(_SECTION_SQL + """,
u AS (SELECT doc_id, seq, 0 AS s, c FROM packed UNION ALL
      SELECT doc_id, seq, s, trim(substr(x, s + 1, e - s)) AS c FROM l)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq, s) - 1 AS chunk_index,
       length(c) AS n_chars, md5(c) AS body FROM u""")
def section_chunks(spark, folder):
    sections = _docs(spark, folder).select(
        F.col("doc_id").alias("document_id"), F.lit(1).alias("section_order"), F.lit("Text").alias("title"), "text",
        F.lit(None).cast("int").alias("page_from"), F.lit(None).cast("int").alias("page_to"))
    out = chunks.section_chunks(sections)
    return out.select(F.col("document_id").alias("doc_id"), F.col("part").cast("long").alias("chunk_index"),
                      F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("body"))


@registry.add("WITH RECURSIVE k AS (SELECT doc_id, 0 AS seq, " + _C + f""" AS c FROM documents),
l AS ({_LONG_STEP.format(src="(SELECT doc_id, seq, c AS x, CAST(0 AS BIGINT) AS s FROM k WHERE c <> '')")}
  UNION ALL {_LONG_STEP.format(src="(SELECT doc_id, seq, x, greatest(0, e - 180) AS s FROM l WHERE e < length(x))")})
SELECT doc_id, count(*) AS pieces, CAST(sum(length(trim(substr(x, s + 1, e - s)))) AS BIGINT) AS chars,
       md5(string_agg(trim(substr(x, s + 1, e - s)), '|' ORDER BY s)) AS body FROM l GROUP BY doc_id""")
def long_text_split(spark, folder):
    pieces = _docs(spark, folder).select("doc_id", chunks.split_long(F.col("text")).alias("p"))
    return pieces.filter(F.size("p") > 0).select(
        "doc_id", F.size("p").cast("long").alias("pieces"),
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"),
        F.md5(F.array_join("p", "|")).alias("body"))


@registry.add(f"""
WITH c AS (SELECT conv_id, turn, role, {_C} AS body FROM conversations),
ch AS (SELECT 'document' AS kind, conv_id AS source_id, turn AS chunk,
        CASE WHEN position(lower(role || ' / page ' || (turn + 1)) IN lower(substr(body, 1, length(role || ' / page ' || (turn + 1)) + 40))) = 0
             THEN role || ' / page ' || (turn + 1) || '. ' || body ELSE body END AS text FROM c WHERE body <> ''),
src AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'document' ELSE 'source' END AS kind, text FROM documents),
rest AS (SELECT doc_id, kind, trim('Document ' || doc_id || '. ' || {_C}) AS x FROM src
         WHERE kind = 'source' OR doc_id NOT IN (SELECT conv_id FROM conversations))
SELECT kind, source_id, count(*) AS passages, CAST(sum(length(text)) AS BIGINT) AS chars FROM ch
WHERE source_id IN (SELECT doc_id FROM src WHERE kind = 'document') GROUP BY ALL
UNION ALL
SELECT kind, doc_id, NULL, NULL FROM rest""")
def passage_assembly(spark, folder):
    """Documents with even ids are parsed files whose chunks are the turns of a conversation."""
    docs = _docs(spark, folder).select(
        F.col("doc_id").alias("source_id"), F.when(F.col("doc_id") % 2 == 0, "document").otherwise("source").alias("source_kind"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"))
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("role").alias("section_title"),
        (F.col("turn") + 1).cast("string").alias("page_ref"), "text")
    out = chunks.assemble_passages(docs, turns)
    from_chunks = F.col("section_title").isNotNull()
    return out.groupBy(F.col("source_kind").alias("kind"), "source_id", from_chunks.alias("_c")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c")).select(
        "kind", "source_id", F.when(F.col("_c"), F.col("n")).alias("passages"), F.when(F.col("_c"), F.col("c")).alias("chars"))


@registry.add(f"""
WITH RECURSIVE src AS (SELECT doc_id, doc_id % 20 AS project, doc_id % 3 AS kind FROM documents WHERE doc_id % 3 <> 1 OR doc_id % 2 = 0),
ch AS (SELECT conv_id AS doc_id, turn AS chunk, CASE WHEN position(lower(role || ' / page ' || (turn + 1)) IN lower(substr(body, 1, length(role || ' / page ' || (turn + 1)) + 40))) = 0
         THEN role || ' / page ' || (turn + 1) || '. ' || body ELSE body END AS text FROM (SELECT conv_id, turn, role, {_C} AS body FROM conversations) WHERE body <> ''),
t AS (SELECT doc_id, {_BODY} AS x, CAST(0 AS BIGINT) AS s FROM documents JOIN src USING (doc_id) WHERE kind <> 1 OR doc_id NOT IN (SELECT conv_id FROM conversations)),
w AS ({_PASSAGE_STEP.format(src='t')}
  UNION ALL {_PASSAGE_STEP.format(src='(SELECT doc_id, x, greatest(e - 150, s + 1) AS s FROM w WHERE e < length(x))')}),
pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk, trim(substr(x, s + 1, e - s)) AS text FROM w
  UNION ALL SELECT doc_id, chunk, text FROM ch JOIN src USING (doc_id) WHERE kind = 1)
SELECT project AS corpus, ['source', 'document', 'library'][kind + 1] || ':' || doc_id AS source_key, chunk, md5(text) AS body,
       row_number() OVER (PARTITION BY project ORDER BY kind, doc_id, chunk) AS place
FROM pieces JOIN src USING (doc_id)""")
def project_retrieval(spark, folder):
    """Sources of three kinds in twenty projects; the chunks of parsed documents are turns
    of conversations, and every odd document is not parsed yet."""
    rows = _docs(spark, folder).select(
        (F.col("doc_id") % 20).alias("project_id"), F.col("doc_id").alias("source_id"), F.col("doc_id").alias("position"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"), (F.col("doc_id") % 3).alias("_k"))
    manual, library = (rows.where(F.col("_k") == k).drop("_k") for k in (0, 2))
    documents = rows.where("_k = 1").select(
        "project_id", F.col("source_id").alias("document_id"), "position", "title", F.col("content").alias("raw_text"),
        F.when(F.col("source_id") % 2 == 0, "parsed").otherwise("pending").alias("parse_status"))
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("role").alias("section_title"),
        (F.col("turn") + 1).cast("string").alias("page_ref"), "text")
    out = sources.project_passages(sources.project_sources(manual, documents, library), turns)
    return ordinal(out, ["corpus"], "pid", "place", width=1 << 44).select("corpus", "source_key", "chunk", F.md5("text").alias("body"), "place")


@registry.add("""
SELECT page_id, ext AS file_type, ext IN ('pdf', 'docx', 'xlsx', 'csv', 'txt', 'image') AS supported FROM (
  SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'doc' WHEN 3 THEN 'zip'
                                   WHEN 4 THEN 'unknown' ELSE 'csv' END AS ext FROM pages)""")
def file_routing(spark, folder):
    n = F.col("page_id") % 6
    suffix = F.when(n == 0, ".PDF").when(n == 1, ".tar.jpeg").when(n == 2, ".doc").when(n == 3, ".zip").when(n == 4, "").otherwise(".Csv")
    kind = tx.file_type(F.concat(F.lit("file"), F.col("page_id").cast("string"), suffix))
    return table(spark, folder, "pages").select("page_id", kind.alias("file_type"), kind.isin(vocab.SUPPORTED_TYPES).alias("supported"))


_QUERY_PARTS = "concat_ws(' ', nullif(c_mktsegment, ''), nullif(c_name, ''), nullif(n_name, ''))"


@registry.add(f"""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'topic ' || {_QUERY_PARTS} ELSE {_QUERY_PARTS} || ' low' END AS query,
       'Метрика: ' || c_name || ' (' || CASE WHEN c_custkey % 3 = 0 THEN 'снизить' ELSE 'увеличить' END || ') · Область: ' || n_name AS kpi
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def goal_texts(spark, folder):
    rows = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    topic = F.when(F.col("c_custkey") % 2 == 0, "topic").otherwise(" ")
    direction = F.when(F.col("c_custkey") % 3 == 0, "decrease").otherwise("increase")
    return rows.select(
        "c_custkey",
        tx.query_text(topic, F.col("c_mktsegment"), F.col("c_name"), F.col("n_name"), F.lit("low")).alias("query"),
        tx.kpi_line(F.col("c_name"), direction, F.col("n_name")).alias("kpi"))
