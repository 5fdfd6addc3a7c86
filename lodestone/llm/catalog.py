"""Queries of the training-data operators with the SQL that must give the same rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import distinctiveness, ideal_point, markup, mixing, neighbors, residue, splitting, tokens


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _scored(s, d):
    return distinctiveness.score_terms(_read(s, d, "bm25_entries"), _read(s, d, "chunks"))


def _mixture(s, d):
    return mixing.mix_sources(_read(s, d, "documents"), _read(s, d, "mix_targets"))


def _pieces(s, d):
    return splitting.split_oversized(_read(s, d, "documents_parsed"), _read(s, d, "split_limits"))


QUERIES = {
    "p2_found": lambda s, d: _pieces(s, d).where("piece = 0 AND n_pieces > 1").select("repo", "id", "item"),
    "p2_pieces": lambda s, d: _pieces(s, d),
    "p3_found": lambda s, d: distinctiveness.distinctive_terms(_read(s, d, "bm25_entries"), _read(s, d, "chunks")).select("chunk_id", "term"),
    "p3_scores": lambda s, d: _scored(s, d),
    "p3_spread": lambda s, d: distinctiveness.vocabulary_spread(_read(s, d, "vocabulary_terms")),
    "p4_found": lambda s, d: ideal_point.undisputed(ideal_point.ideal_point_ranking(_read(s, d, "candidate_evaluations"))),
    "p4_ranking": lambda s, d: ideal_point.ideal_point_ranking(_read(s, d, "candidate_evaluations")).withColumn("closeness", F.round("closeness", 6)),
    "p6_found": lambda s, d: markup.summaries_with_markup(_read(s, d, "documents_parsed")).select("repo", "id"),
    "p6_marks": lambda s, d: markup.summaries_with_markup(_read(s, d, "documents_parsed")),
    "p6_clean": lambda s, d: markup.clean_texts(_read(s, d, "documents_parsed")),
    "p6_clean_summaries": lambda s, d: markup.clean_summaries(_read(s, d, "documents_parsed")),
    "p7_found": lambda s, d: neighbors.similar_pairs(_read(s, d, "chunks")),
    "p7_links": lambda s, d: neighbors.similar_links(_read(s, d, "chunks")),
    "p7_groups": lambda s, d: neighbors.vector_groups(_read(s, d, "chunks")),
    "p7_nearest": lambda s, d: neighbors.nearest(_read(s, d, "chunks")),
    "p8_ids": lambda s, d: tokens.encode_corpus(_read(s, d, "documents")),
    "p9_mix": lambda s, d: _mixture(s, d),
    "p9_report": lambda s, d: mixing.mixture_report(_mixture(s, d), _read(s, d, "mix_targets")),
    "p10_found": lambda s, d: residue.judge(_read(s, d, "documents")).select("doc_id"),
    "p10_kinds": lambda s, d: residue.judge(_read(s, d, "documents")),
    "p10_clean": lambda s, d: residue.without_residue(_read(s, d, "documents")).select("doc_id", "lang", "source", "text"),
}

_VECTORS = """v AS (
  SELECT chunk_id, CAST(any_value(embedding) AS DOUBLE[]) AS e FROM chunks
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_id
)"""

ORACLE = {
    "p2_found": """
WITH cur AS (SELECT repo, id, max(revision) AS revision FROM documents_parsed GROUP BY repo, id),
rec AS (
  SELECT DISTINCT d.repo, d.id, length(d.raw_content) AS r, length(d.sections.context) AS c, length(d.sections.decision) AS e, length(d.sections.considered_options) AS o
  FROM documents_parsed d JOIN cur ON d.repo = cur.repo AND d.id = cur.id AND d.revision = cur.revision WHERE d.is_deleted = false
), items AS (
  SELECT repo, id, 'raw_content' AS item, r AS n FROM rec UNION ALL SELECT repo, id, 'context', c FROM rec
  UNION ALL SELECT repo, id, 'decision', e FROM rec UNION ALL SELECT repo, id, 'considered_options', o FROM rec
)
SELECT repo, id, item FROM items JOIN split_limits USING (item) WHERE n > max_chars""",
    "p3_found": """
WITH counting AS (
  SELECT chunk_id, term_counts FROM bm25_entries
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC, tokenizer_version DESC, token_length DESC) = 1
), tf AS (
  SELECT chunk_id, lower(e.key) AS term, sum(e.value) AS tf
  FROM (SELECT chunk_id, unnest(map_entries(term_counts)) AS e FROM counting) GROUP BY 1, 2
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT chunk_id, term FROM tf JOIN df USING (term) WHERE tf >= 4 AND df BETWEEN 2 AND 6""",
    "p3_spread": """
WITH last AS (
  SELECT shard_id, lower(trim(term)) AS term, coalesce(doc_count, 0) AS n FROM vocabulary_terms WHERE trim(term) <> ''
  QUALIFY row_number() OVER (PARTITION BY shard_id, lower(trim(term)) ORDER BY harvested_at DESC NULLS LAST, coalesce(doc_count, 0) DESC) = 1
)
SELECT term, count(CASE WHEN n > 0 THEN 1 END) AS n_shards, CAST(sum(n) AS BIGINT) AS doc_count,
  CASE WHEN count(CASE WHEN n > 0 THEN 1 END) > 0 THEN round(ln(1 + (SELECT count(DISTINCT shard_id) FROM vocabulary_terms) / count(CASE WHEN n > 0 THEN 1 END)), 6) END AS rarity
FROM last GROUP BY term""",
    "p4_found": """
WITH c AS (SELECT DISTINCT query_id, chunk_id, dense_score AS d, sparse_score AS s, blended_score AS b FROM candidate_evaluations),
n AS (SELECT query_id, count(*) AS n FROM c GROUP BY query_id),
wins AS (
  SELECT x.query_id, x.chunk_id, count(*) AS won FROM c x JOIN c y ON x.query_id = y.query_id AND x.chunk_id <> y.chunk_id
  WHERE (CASE WHEN x.d IS NOT NULL AND (y.d IS NULL OR x.d > y.d) THEN 1 ELSE 0 END
       + CASE WHEN x.s IS NOT NULL AND (y.s IS NULL OR x.s > y.s) THEN 1 ELSE 0 END
       + CASE WHEN x.b IS NOT NULL AND (y.b IS NULL OR x.b > y.b) THEN 1 ELSE 0 END) >= 2
  GROUP BY 1, 2
)
SELECT query_id, chunk_id FROM wins JOIN n USING (query_id) WHERE won = n - 1""",
    "p7_found": f"""WITH {_VECTORS}
SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM v a JOIN v b ON a.chunk_id < b.chunk_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9""",
    "p7_groups": f"""WITH {_VECTORS}, g AS (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY e) AS rep, count(*) OVER (PARTITION BY e) AS n FROM v)
SELECT rep, chunk_id AS id FROM g WHERE n > 1""",
    "p7_links": f"""WITH {_VECTORS}, r AS (SELECT min(chunk_id) AS id, e FROM v GROUP BY e)
SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.9""",
}
