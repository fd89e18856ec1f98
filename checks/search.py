"""Retrieval: BM25, dense, fusion, pools, re-ranking, TF-IDF."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.operators import blockmax, bm25, corpus, dense, fusion, tfidf
from siftline.plans import retrieve
from siftline.session import cut_lineage

from . import Registry, table
from .sqltext import lang, tokens

registry = Registry()


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.lit("documents").alias("corpus"), F.col("doc_id").alias("pid"), "text")


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.lit("documents").alias("corpus"), "text")


_POSTINGS = f"""
tok AS (SELECT doc_id AS pid, {tokens('text')} AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM tok),
tf AS (SELECT pid, term, count(*) AS tf FROM (SELECT pid, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, term
      FROM (SELECT item_id, unnest({tokens('text')}) AS term FROM benchmark)),
part AS (
  SELECT query_id, tf.pid, tf.term,
         ln(1 + (n - df + 0.5) / (df + 0.5))
         * (tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * len(tok.t) / avg_len))) AS part
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN tok ON tok.pid = tf.pid, stats),
scored AS (SELECT query_id, pid, round(sum(part), 4) AS bm25 FROM part GROUP BY ALL)
"""


@registry.add(f"""
WITH {_POSTINGS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, pid) AS rank FROM scored),
why AS (SELECT query_id, pid, term,
               row_number() OVER (PARTITION BY query_id, pid ORDER BY part DESC, term) AS k FROM part)
SELECT r.query_id, r.pid, r.bm25, r.rank, string_agg(w.term, ',' ORDER BY w.k) AS terms
FROM ranked r JOIN why w ON w.query_id = r.query_id AND w.pid = r.pid AND w.k <= 6
WHERE r.rank <= 6 GROUP BY ALL""")
def bm25_topk(spark, folder):
    best = bm25.scan_best(_passages(spark, folder), _queries(spark, folder))
    return best.select("query_id", "pid", "bm25", "rank", F.array_join("terms", ",").alias("terms"))


@registry.add(registry.sql["bm25_topk"])
def bm25_index_topk(spark, folder):
    """The same answer from a kept index, block by block."""
    index = cut_lineage(blockmax.build(_passages(spark, folder)), **blockmax.LAYOUT)
    best, _ = blockmax.search(index, _queries(spark, folder))
    return best.select("query_id", "pid", "bm25", "rank", F.array_join("terms", ",").alias("terms"))


@registry.add(f"""
WITH {_POSTINGS}
SELECT term, df, CAST(sum(tf) AS BIGINT) AS tf, round(ln(1 + (max(n) - df + 0.5) / (df + 0.5)), 6) AS idf
FROM tf JOIN df USING (term), stats GROUP BY term, df""")
def corpus_term_stats(spark, folder):
    index = corpus.build_index(_passages(spark, folder))
    per_term = index.postings.filter("term <> ''").groupBy("corpus", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
    return per_term.join(index.stats, "corpus").select(
        "term", "df", "tf", F.round(bm25.idf(F.col("passages"), F.col("df")), 6).alias("idf"))


@registry.add(f"""
SELECT count(*) AS passages, round(avg(len({tokens('text')})), 6) AS avg_len FROM documents""")
def corpus_size(spark, folder):
    stats = corpus.build_index(_passages(spark, folder)).stats
    return stats.select("passages", F.round("avg_len", 6).alias("avg_len"))


@registry.add(f"""
SELECT source AS corpus, {lang('text')} AS lang, count(*) AS passages FROM documents GROUP BY ALL""")
def language_counts(spark, folder):
    docs = table(spark, folder, "documents").withColumnRenamed("source", "corpus")
    return corpus.language_counts(docs)


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))


_NORMS = """
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
             sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n
      FROM embeddings)"""

_COSINE = "round(list_dot_product(q.e, p.e) / CASE WHEN q.n = 0 THEN 1 ELSE q.n END / (p.n + 1e-9), 4)"


@registry.add(f"""
WITH {_NORMS},
s AS (SELECT b.item_id AS query_id, p.vec_id AS pid, {_COSINE} AS dense
      FROM benchmark b JOIN v q ON q.vec_id = b.item_id, v p)
SELECT query_id, pid, dense, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, pid) AS dense_rank
FROM s QUALIFY dense_rank <= 10""")
def dense_cosine_topk(spark, folder):
    vectors = _vectors(spark, folder)
    queries = table(spark, folder, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id")).select(
        F.col("item_id").alias("query_id"), "vector")
    return dense.nearest(vectors.select(F.col("vec_id").alias("pid"), "vector"), queries, 10)


def _library(spark, folder):
    """Documents with their vectors; a project is the set of documents of one source."""
    docs = table(spark, folder, "documents").join(
        _vectors(spark, folder), F.col("doc_id") == F.col("vec_id"), "left")
    return docs.select(
        F.col("source").alias("corpus"), F.col("doc_id").alias("pid"), "text", "vector",
        F.concat(F.lit("source:"), (F.col("doc_id") % 17).cast("string")).alias("source_key"))


def _goals(spark, folder):
    """Benchmark texts as goals of the project that owns the document with the same id."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("corpus"))
    goals = table(spark, folder, "benchmark").join(docs, F.col("item_id") == F.col("doc_id"))
    return goals.join(_vectors(spark, folder), F.col("item_id") == F.col("vec_id"), "left").select(
        F.col("item_id").alias("query_id"), "corpus", "text", "vector")


def _responses(spark, folder):
    """Scores of a re-rank provider, replayed from the event log."""
    events = table(spark, folder, "events").withColumn(
        "cand_idx", F.get_json_object("props", "$.k").try_cast("long"))
    return events.groupBy(F.col("user_id").alias("query_id"), "cand_idx").agg(
        F.min("event_id").alias("pos"), F.max("value").alias("score"))


_PAIRS = f"""
{_NORMS},
p AS (SELECT source AS corpus, doc_id AS pid, text, {tokens('text')} AS t, {lang('text')} AS lang,
             'source:' || (doc_id % 17) AS source_key, v.e, v.n
      FROM documents LEFT JOIN v ON v.vec_id = doc_id),
q AS (SELECT item_id AS query_id, d.source AS corpus, {tokens('b.text')} AS t, v.e, v.n
      FROM benchmark b JOIN documents d ON d.doc_id = b.item_id LEFT JOIN v ON v.vec_id = b.item_id),
stats AS (SELECT corpus, count(*) AS cnt, avg(len(t)) AS avg_len FROM p GROUP BY corpus),
tf AS (SELECT corpus, pid, len(t) AS dl, term, count(*) AS tf
       FROM (SELECT corpus, pid, t, unnest(t) AS term FROM p) GROUP BY ALL),
df AS (SELECT corpus, term, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT DISTINCT query_id, corpus, term FROM (SELECT query_id, corpus, unnest(t) AS term FROM q)),
part AS (
  SELECT query_id, tf.pid, qt.term, ln(1 + (cnt - df + 0.5) / (df + 0.5))
         * (tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * dl / avg_len))) AS part
  FROM qt JOIN tf USING (corpus, term) JOIN df USING (corpus, term) JOIN stats USING (corpus)),
bm AS (SELECT query_id, pid, round(sum(part), 4) AS bm25 FROM part GROUP BY ALL),
why AS (SELECT query_id, pid, string_agg(term, ',' ORDER BY k) AS terms FROM (
          SELECT query_id, pid, term, row_number() OVER (PARTITION BY query_id, pid ORDER BY part DESC, term) AS k
          FROM part) WHERE k <= 6 GROUP BY ALL),
pairs AS (
  SELECT q.query_id, p.corpus, p.pid, p.lang, p.source_key, coalesce(bm.bm25, 0) AS bm25,
         coalesce(why.terms, '') AS terms, {_COSINE} AS dense
  FROM q JOIN p USING (corpus) LEFT JOIN bm ON bm.query_id = q.query_id AND bm.pid = p.pid
  LEFT JOIN why ON why.query_id = q.query_id AND why.pid = p.pid),
fused AS (
  SELECT *, CASE WHEN den_on THEN 1.0::DOUBLE / (60 + bm25_rank) + CASE WHEN dense IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + dr) END
                 ELSE bm25 END AS hybrid,
         CASE WHEN dense IS NOT NULL THEN dr END AS dense_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, pid) AS bm25_rank,
               row_number() OVER (PARTITION BY query_id ORDER BY dense DESC NULLS LAST, pid) AS dr,
               count(dense) OVER (PARTITION BY query_id) > 0 AS den_on FROM pairs)),
r0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, pid) AS r,
              count(*) OVER (PARTITION BY query_id) AS total FROM fused),
r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY r) AS lr,
              min(r) OVER (PARTITION BY query_id, lang) AS lf FROM r0),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id
                 ORDER BY (lr <= 5) DESC, CASE WHEN lr <= 5 THEN lf ELSE r END, r) AS sel FROM r1),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id
                 ORDER BY hybrid DESC, CASE WHEN total <= 24 THEN r ELSE sel END) - 1 AS cand_idx
         FROM r2 WHERE sel <= 24),
resp AS (SELECT user_id AS query_id, CAST(props->>'$.k' AS BIGINT) AS cand_idx, min(event_id) AS p0,
                max(value) AS rerank FROM events GROUP BY ALL),
hits AS (SELECT pool.*, resp.rerank, p0 FROM pool JOIN resp USING (query_id, cand_idx)),
merged AS (
  SELECT *, true AS reranked FROM hits
  UNION ALL BY NAME
  SELECT *, CAST(NULL AS DOUBLE) AS rerank, cand_idx AS p0, false AS reranked FROM pool
  WHERE query_id NOT IN (SELECT query_id FROM hits)),
final AS (
  SELECT *, coalesce(rerank, round(hybrid, 6)) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY p0, cand_idx) AS pos FROM merged),
one AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_key ORDER BY pos) AS s FROM final),
items AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS final_rank
          FROM one WHERE s <= 1 QUALIFY final_rank <= 6)
"""


def _fused(spark, folder):
    return retrieve.fused_pairs(_library(spark, folder), _goals(spark, folder))


@registry.add(f"""WITH {_PAIRS}
SELECT query_id, pid, bm25, dense, bm25_rank, dense_rank, round(hybrid, 6) AS hybrid FROM fused""")
def hybrid_rrf(spark, folder):
    return _fused(spark, folder).select(
        "query_id", "pid", "bm25", "dense", "bm25_rank", "dense_rank", F.round("hybrid", 6).alias("hybrid"))


@registry.add(f"""WITH {_PAIRS}
SELECT query_id, cand_idx, pid, lang, bm25, dense, round(hybrid, 6) AS hybrid, terms FROM pool""")
def candidate_pool(spark, folder):
    pool = retrieve.candidate_pool(_library(spark, folder), _goals(spark, folder))
    return pool.select("query_id", "cand_idx", "pid", "lang", "bm25", "dense",
                       F.round("hybrid", 6).alias("hybrid"), F.array_join("terms", ",").alias("terms"))


@registry.add(f"""WITH {_PAIRS}
SELECT query_id, pid, cand_idx, rerank, score, pos, reranked FROM final""")
def rerank_merge(spark, folder):
    pool = retrieve.candidate_pool(_library(spark, folder), _goals(spark, folder))
    merged = fusion.merge_rerank(pool, _responses(spark, folder))
    return merged.select("query_id", "pid", "cand_idx", "rerank", "score", "pos", "reranked")


@registry.add(f"""WITH {_PAIRS}
SELECT query_id, pid, source_key, score, final_rank FROM items""")
def diversified_topk(spark, folder):
    pool = retrieve.candidate_pool(_library(spark, folder), _goals(spark, folder))
    merged = fusion.merge_rerank(pool, _responses(spark, folder))
    return fusion.diversify(merged).select("query_id", "pid", "source_key", "score", "final_rank")


@registry.add(f"""WITH {_PAIRS},
langs AS (SELECT query_id, string_agg(lang || ':' || c, ',' ORDER BY lang) AS languages FROM (
            SELECT query_id, lang, count(*) AS c FROM pairs GROUP BY ALL) GROUP BY query_id),
sizes AS (SELECT query_id, count(*) AS passages, count(dense) > 0 AS dense FROM pairs GROUP BY query_id),
cands AS (SELECT query_id, count(*) AS candidates FROM pool GROUP BY query_id)
SELECT i.query_id, i.final_rank, i.pid, i.score, i.terms, sizes.passages, cands.candidates, sizes.dense AS dense_on,
       CASE WHEN sizes.dense THEN 'rrf' ELSE 'bm25' END AS fusion, i.reranked, languages
FROM items i JOIN langs USING (query_id) JOIN sizes USING (query_id) JOIN cands USING (query_id)""")
def retrieve_many(spark, folder):
    items, stages = retrieve.retrieve(
        _library(spark, folder), _goals(spark, folder), _responses(spark, folder))
    items = items.select("query_id", "final_rank", "pid", "score", F.array_join("terms", ",").alias("terms"))
    langs = F.array_join(F.transform("languages", lambda s: F.concat_ws(":", s["lang"], s["passages"])), ",")
    stages = stages.select("query_id", "passages", "candidates", F.col("dense").alias("dense_on"), "fusion",
                           "reranked", langs.alias("languages"))
    return items.join(stages, "query_id")


@registry.add(f"""WITH {_PAIRS}
SELECT query_id, pid, score, round(score / greatest(max(score) OVER (PARTITION BY query_id), 0.0001), 6) AS bar
FROM items""")
def score_bars(spark, folder):
    items, _ = retrieve.retrieve(
        _library(spark, folder), _goals(spark, folder), _responses(spark, folder))
    bars = fusion.score_bars(items, ["query_id"])
    return bars.select("query_id", "pid", "score", F.round("bar", 6).alias("bar"))


_TFIDF_TOKENS = """list_filter(regexp_extract_all(lower({c}), '[a-zа-я0-9][a-zа-я0-9\\-]+'),
 lambda t: NOT list_contains({stop}, t))"""


def _sql_grams(source: str, key: str, column: str) -> str:
    from siftline.functions import vocab
    from .sqltext import words

    toks = _TFIDF_TOKENS.format(c=column, stop=words(vocab.RU_STOP))
    return f"""
SELECT {key}, term, count(*) AS tf FROM (
  SELECT {key}, unnest(t) AS term FROM (SELECT {key}, {toks} AS t FROM {source})
  UNION ALL
  SELECT {key}, unnest(list_transform(list_zip(t[:-2], t[2:]), lambda x: x[1] || ' ' || x[2])) AS term
  FROM (SELECT {key}, {toks} AS t FROM {source}) WHERE len(t) > 1) GROUP BY ALL"""


@registry.add(f"""
WITH d AS ({_sql_grams('documents', 'doc_id', 'text')}),
q AS ({_sql_grams('benchmark', 'item_id', 'text')}),
n AS (SELECT count(*) + 1 AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM d GROUP BY term),
base AS (SELECT doc_id, sum((tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1)) ** 2) AS base2 FROM d JOIN df USING (term), n GROUP BY doc_id),
qw AS (SELECT item_id, q.term, coalesce(df, 0) + 1 AS qdf,
              q.tf * (ln((1 + n)::DOUBLE / (2 + coalesce(df, 0))) + 1) AS w
       FROM q LEFT JOIN df USING (term), n),
qn AS (SELECT item_id, sum(w * w) AS q2 FROM qw GROUP BY item_id),
m AS (SELECT item_id, doc_id,
             sum(d.tf * (ln((1 + n)::DOUBLE / (1 + qdf)) + 1) * w) AS dot,
             sum((d.tf * (ln((1 + n)::DOUBLE / (1 + qdf)) + 1)) ** 2 - (d.tf * (ln((1 + n)::DOUBLE / (1 + df.df)) + 1)) ** 2) AS shift
      FROM d JOIN qw USING (term) JOIN df USING (term), n GROUP BY ALL),
s AS (SELECT item_id AS query_id, documents.doc_id AS pid,
             coalesce(round(dot / sqrt(base2 + shift) / sqrt(q2), 4), 0) AS score
      FROM benchmark CROSS JOIN documents LEFT JOIN m USING (item_id, doc_id) LEFT JOIN base USING (doc_id) LEFT JOIN qn USING (item_id)),
best AS (SELECT query_id, pid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pid DESC) AS rank FROM s QUALIFY rank <= 6),
why AS (SELECT query_id, pid, qw.term AS term, row_number() OVER (PARTITION BY query_id, pid
          ORDER BY d.tf * (ln((1 + n)::DOUBLE / (1 + qdf)) + 1) * w DESC, qw.term) AS place
        FROM best JOIN qw ON query_id = item_id JOIN d ON pid = doc_id AND d.term = qw.term, n)
SELECT query_id, pid, score, rank, coalesce((SELECT string_agg(term, '|' ORDER BY place) FROM why
  WHERE why.query_id = best.query_id AND why.pid = best.pid AND place <= 6), '') AS terms FROM best""")
def tfidf_topk(spark, folder):
    found = tfidf.search(_passages(spark, folder), _queries(spark, folder))
    return found.select("query_id", "pid", "score", "rank", F.array_join("terms", "|").alias("terms"))
