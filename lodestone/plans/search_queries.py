"""Retrieval queries over documents and vectors: every row whose id is divisible by 20 is a query against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import bm25, search
from lodestone.operators.best import best, hybrid_search
from lodestone.plans.record_queries import read
from lodestone.session import materialize


def _documents(s, d):
    return read(s, d, "documents").where(F.col("text").isNotNull())


def _index(s, d, status=None):
    return bm25.stored(bm25.build(_documents(s, d) if status is None else _documents(s, d).withColumn("status", status), "doc_id", "doc_id", None if status is None else "status"))


def _queries(s, d):
    """A query is a document's whole text."""
    return _documents(s, d).where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text")


def _with_terms(s, d, k, pick):
    """Rows that ``pick`` keeps of the k best scores, with the terms that matched."""
    index, terms = _index(s, d), bm25.query_terms(_queries(s, d))
    kept = materialize(pick(best(index, terms, k)), "kept")
    return bm25.matched_terms(index, terms, kept).withColumn("terms", F.array_join("matched_terms", " "))


def _dense(s, d):
    vectors = read(s, d, "embeddings")
    return search.dense_scores(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "vec_id")


def _vector_docs(s, d):
    return read(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("status"))


def _text_docs(s, d):
    return _documents(s, d).select(F.col("doc_id").alias("chunk_id"), "doc_id", F.coalesce("lang", F.lit("none")).alias("status"))


def _round(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


QUERIES = {
    "token_counts": lambda s, d: _documents(s, d).select("doc_id", F.size(T.tokenize(F.col("text"))).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(T.tokenize(F.col("text")))).cast("bigint").alias("n_distinct")),
    "idf_table": lambda s, d: _round(bm25.idf_table(_index(s, d)), "idf"),
    "bm25_search": lambda s, d: _with_terms(s, d, 10, lambda x: search.top_k(x, "query_id", [F.desc("score"), F.asc("chunk_id")], 10)).select("query_id", F.col("chunk_id").alias("doc_id"), "score", "terms"),
    "bm25_attribution": lambda s, d: _round(bm25.best_attribution(_index(s, d), bm25.query_terms(_queries(s, d)), 6), "idf"),
    "sparse_search": lambda s, d: _with_terms(s, d, 15, lambda x: search.sparse_search(x, _text_docs(s, d), 5, 0.2, ["en"])).select("query_id", "doc_id", "relative", "terms"),
    "dense_search": lambda s, d: search.dense_search(_dense(s, d).withColumn("similarity", F.round("similarity", 6)), _vector_docs(s, d), 5, 0.2).select("query_id", "doc_id", "similarity"),
    "hybrid_search": lambda s, d: _round(hybrid_search(_dense(s, d).withColumn("similarity", F.round("similarity", 6)), _index(s, d, F.coalesce("lang", F.lit("none"))), bm25.query_terms(_queries(s, d)), ["en", "de", "fr", "es"], 5, 0.2).select("query_id", "doc_id", "fused", "blended"), "fused", "blended"),
}

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _tokens(column: str) -> str:
    base = f"list_filter(list_transform(string_split(lower(regexp_replace({column}, '[^A-Za-z0-9_-]+', ' ', 'g')), ' '), lambda w: trim(w, '-_')), lambda w: length(w) >= 2 AND NOT list_contains([{_STOP}], w))"
    return f"flatten(list_transform({base}, lambda w: CASE WHEN contains(w, '_') THEN list_concat([w], list_filter(string_split(w, '_'), lambda p: length(p) >= 2 AND NOT list_contains([{_STOP}], p))) ELSE [w] END))"


_BASE = f"""
tok AS (SELECT doc_id, {_tokens('text')} AS t FROM documents WHERE text IS NOT NULL),
totals AS (SELECT count(*) AS n, avg(len(t)) AS avg_length FROM tok),
postings AS (SELECT doc_id, len AS length, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY 1, 2, 3),
freq AS (SELECT term, count(*) AS df, any_value(ln((n - df + 0.5) / (df + 0.5) + 1)) AS idf FROM (SELECT term, count(*) OVER (PARTITION BY term) AS df FROM postings), totals GROUP BY term),
asked AS (
  SELECT doc_id AS query_id, unnest(list_distinct(q)) AS term FROM (SELECT doc_id, {_tokens('text')} AS q FROM documents WHERE text IS NOT NULL AND doc_id % 20 = 0)
),
scored AS (
  SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 6) AS score, list(term) AS matched
  FROM asked JOIN postings USING (term) JOIN freq USING (term), totals GROUP BY 1, 2
),
first_pos AS (
  SELECT query_id, q, term, list_position(q, term) AS ord FROM (SELECT query_id, q, unnest(list_distinct(q)) AS term FROM (SELECT doc_id AS query_id, {_tokens('text')} AS q FROM documents WHERE text IS NOT NULL AND doc_id % 20 = 0))
),
terms AS (
  SELECT a.query_id, p.doc_id, string_agg(a.term, ' ' ORDER BY a.ord) AS terms FROM first_pos a JOIN postings p ON a.term = p.term GROUP BY 1, 2
)"""
_DENSE = """
dense AS (
  SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS similarity
  FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0
)"""

ORACLE = {
    "token_counts": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents WHERE text IS NOT NULL)",
    "idf_table": f"WITH {_BASE} SELECT term, df, round(idf, 6) AS idf FROM freq",
    "bm25_search": f"WITH {_BASE} SELECT query_id, doc_id, score, terms FROM scored JOIN terms USING (query_id, doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10",
    "bm25_attribution": f"WITH {_BASE} SELECT query_id, doc_id, term, CAST(tf AS BIGINT) AS tf, round(idf, 6) AS idf, round(idf * tf, 6) AS weight FROM asked JOIN postings USING (term) JOIN freq USING (term) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(idf * tf, 6) DESC, doc_id, term) <= 6",
    "sparse_search": f"""WITH {_BASE},
cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 15),
rel AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS r FROM cut),
kept AS (SELECT r.query_id, r.doc_id, r FROM rel r JOIN documents d ON r.doc_id = d.doc_id WHERE r >= 0.2 AND lower(d.lang) = 'en' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r DESC, r.doc_id) <= 5)
SELECT query_id, doc_id, floor(r * 1000 + 0.5) / 1000 AS relative, terms FROM kept JOIN terms USING (query_id, doc_id)""",
    "dense_search": f"WITH {_DENSE} SELECT query_id, doc_id, floor(similarity * 1000 + 0.5) / 1000 AS similarity FROM dense WHERE similarity >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) <= 5",
    "hybrid_search": f"""WITH {_BASE}, {_DENSE},
kept AS (SELECT doc_id FROM documents WHERE text IS NOT NULL AND lower(lang) IN ('en', 'de', 'fr', 'es')),
dr AS (SELECT d.*, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, d.doc_id) AS dense_rank FROM dense d JOIN kept USING (doc_id)),
sr AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS r, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS sparse_rank FROM scored),
f AS (
  SELECT query_id, doc_id, coalesce(similarity, 0) AS d, coalesce(r, 0) AS r, coalesce(1.0 / (60 + dense_rank), 0) + coalesce(1.0 / (60 + sparse_rank), 0) AS fused
  FROM dr FULL JOIN sr USING (query_id, doc_id)
), b AS (SELECT query_id, doc_id, fused, CASE WHEN d > 0 THEN greatest(d, 0.7 * d + 0.3 * r) ELSE r END AS blended FROM f JOIN kept USING (doc_id))
SELECT query_id, doc_id, round(fused, 6) AS fused, round(blended, 6) AS blended FROM b WHERE blended >= 0.2
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, blended DESC, doc_id) <= 5""",
}
