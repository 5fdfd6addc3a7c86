"""Vocabulary, overlap and changeset queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import changeset, overlap, vocabulary
from lodestone.plans.parser_queries import _ENTITIES
from lodestone.plans.record_queries import read
from lodestone.session import materialize


def _current(s, d):
    """One row per live record: any of its newest deliveries, which are equal."""
    p = read(s, d, "documents_parsed")
    keep = F.max_by(F.struct("is_deleted", "raw_content", "metadata", "sections", "doc_ord"), "revision")
    return p.groupBy("repo", "id").agg(keep.alias("c")).select("repo", "id", "c.*").where("is_deleted = false")


def _chunks(s, d):
    usable = F.size(F.filter("embedding", lambda x: F.isnan(x) | x.isNull())) == 0
    return read(s, d, "chunks").where((F.size("embedding") == 64) & usable).dropDuplicates(["chunk_id"]).select("chunk_id", "doc_id", "section_type", "embedding")


def _titles(s, d):
    """(doc_id, id, title, entities) of every live record; entities that aren't stored are found in its text."""
    keep = F.max_by(F.struct("is_deleted", F.coalesce("metadata.title", F.lit("")).alias("title"), F.coalesce("entities", T.entities(F.coalesce("raw_content", F.lit("")))).alias("entities")), "revision")
    live = read(s, d, "documents_parsed").groupBy("repo", "id").agg(keep.alias("c")).where("c.is_deleted = false")
    return live.select(F.concat("repo", F.lit("/"), "id").alias("doc_id"), "id", "c.title", "c.entities")


def _pairs(s, d):
    c = materialize(_chunks(s, d), "chunks")
    drafts = c.where(F.expr("try_cast(regexp_extract(doc_id, '([0-9]+)$', 1) AS BIGINT) % 20 = 0")).select(F.col("doc_id").alias("draft_id"), "section_type", "embedding")
    near = overlap.similarities(drafts, c).where("draft_id <> doc_id")
    near = near.select("draft_id", "doc_id", *[F.round(k, 6).alias(k) for k in ("overall", "context", "decision")])
    told = materialize(_titles(s, d).join(c.select("doc_id").distinct(), "doc_id", "left_semi"), "titles")
    mine = told.join(drafts.where(F.col("section_type").isin(*overlap.PARTS)).select("draft_id").distinct(), F.col("doc_id") == F.col("draft_id"), "left_semi").withColumnRenamed("doc_id", "draft_id")
    titles = overlap.shared_words(mine.select("draft_id", F.col("title").alias("text")), told.select("doc_id", F.col("title").alias("text"))).where("draft_id <> doc_id")
    pairs = overlap.with_evidence(near, titles, mine.select("draft_id", "entities"), told.select("doc_id", "entities"), drafts, c)
    for k in ("overall", "context", "decision"):
        pairs = pairs.withColumn(k, F.round(k, 6))
    return overlap.verdicts(pairs)


def _diffs(s, d):
    """A diff per distinct record text, as if the record had just been added, with a manifest beside it."""
    p = read(s, d, "documents_parsed").where(F.col("raw_content").isNotNull()).select("repo", F.coalesce("relative_path", F.lit("record.md")).alias("relative_path"), "raw_content").distinct()
    added = F.regexp_replace(F.concat(F.lit("\n"), F.regexp_replace("raw_content", "\r", "")), "\n", "\n+")
    manifest = F.concat(F.lit('\ndiff --git a/package.json b/package.json\n--- a/package.json\n+++ b/package.json\n+  "'), "repo", F.lit('": "1.0.0",\n-  "old": "0.1"'))
    diff = F.concat(F.lit("diff --git a/"), "relative_path", F.lit(" b/"), "relative_path", F.lit("\nnew file mode 100644"), added, manifest)
    return p.select(F.sha2(F.concat_ws("|", "repo", "relative_path", "raw_content"), 256).alias("diff_id"), diff.alias("diff"))


def _files(s, d):
    return changeset.files(_diffs(s, d))


QUERIES = {
    "vocabulary": lambda s, d: vocabulary.harvest(_current(s, d)).select("term", "doc_count", "total_occurrences", F.array_join("sources", "|").alias("sources")),
    "vocabulary_top": lambda s, d: vocabulary.top_terms(vocabulary.harvest(_current(s, d)), 2, 50).select("term", "doc_count", "total_occurrences"),
    "phrase_bonding": lambda s, d: vocabulary.bond(read(s, d, "chunks").select("chunk_id", "text").distinct(), vocabulary.harvest(_current(s, d))),
    "overlap_verdicts": lambda s, d: _pairs(s, d).select("draft_id", "doc_id", "overall", "context", "decision", "verdict"),
    "overlap_summary": lambda s, d: overlap.draft_verdicts(_pairs(s, d)),
    "diff_files": lambda s, d: _files(s, d).select("diff_id", F.col("file_ord").cast("bigint").alias("file_ord"), "path", "change_type", F.size("added").cast("bigint").alias("n_added"), F.size("deleted").cast("bigint").alias("n_deleted")),
    "diff_dependencies": lambda s, d: changeset.dependencies(_files(s, d)),
    "diff_keywords": lambda s, d: changeset.keywords(_files(s, d)).groupBy("keyword").agg(F.count(F.lit(1)).alias("n")),
}

_COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"
_OVERLAP = f"""
u AS (SELECT chunk_id, any_value(doc_id) AS doc_id, any_value(section_type) AS section_type, any_value(embedding) AS embedding FROM chunks
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR x IS NULL)) = 0 GROUP BY chunk_id),
z AS (SELECT * FROM u),
dr AS (SELECT doc_id AS draft_id, max(CASE WHEN section_type = 'summary' THEN embedding END) AS s, max(CASE WHEN section_type = 'context' THEN embedding END) AS c, max(CASE WHEN section_type = 'decision' THEN embedding END) AS d
       FROM u WHERE CAST(regexp_extract(doc_id, '([0-9]+)$', 1) AS BIGINT) % 20 = 0 GROUP BY doc_id),
q AS (SELECT draft_id, 'overall' AS k, s AS embedding FROM dr UNION ALL SELECT draft_id, 'context', coalesce(c, s) FROM dr UNION ALL SELECT draft_id, 'decision', coalesce(d, s) FROM dr),
sc AS (SELECT a.draft_id, a.k, b.doc_id, b.section_type, coalesce(CASE WHEN list_sum(list_transform(b.embedding, lambda x: abs(x))) > 0 AND list_sum(list_transform(a.embedding, lambda x: abs(x))) > 0 THEN {_COS} ELSE 0.0 END, 0) AS v FROM q a JOIN z b ON a.draft_id <> b.doc_id WHERE a.embedding IS NOT NULL),
p AS (SELECT draft_id, doc_id, coalesce(max(CASE WHEN k = 'overall' THEN v END), 0) AS overall,
  coalesce(max(CASE WHEN k = 'context' AND section_type = 'context' THEN v END), max(CASE WHEN k = 'context' AND section_type = 'summary' THEN v END), 0) AS context,
  coalesce(max(CASE WHEN k = 'decision' AND section_type = 'decision' THEN v END), max(CASE WHEN k = 'decision' AND section_type = 'summary' THEN v END), 0) AS decision FROM sc GROUP BY 1, 2),
cur AS (SELECT repo, id, max(revision) AS revision FROM documents_parsed GROUP BY repo, id),
told AS (SELECT DISTINCT d.repo || '/' || d.id AS doc_id, list_distinct(regexp_extract_all(lower(coalesce(d.metadata.title, '')), '[a-z0-9]+')) AS w, coalesce(d.entities, {_ENTITIES.replace("(t,", "(coalesce(d.raw_content, ''),")}) AS e
  FROM documents_parsed d JOIN cur ON d.repo = cur.repo AND d.id = cur.id AND d.revision = cur.revision WHERE d.is_deleted = false AND d.repo || '/' || d.id IN (SELECT doc_id FROM u)),
f AS (SELECT p.draft_id, p.doc_id, overall, context, decision, coalesce(len(list_intersect(a.w, b.w)) / sqrt(len(a.w) * len(b.w)), 0) AS t, len(list_intersect(list_distinct(coalesce(a.e, [])), list_distinct(coalesce(b.e, [])))) AS shared
  FROM p LEFT JOIN told a ON a.doc_id = p.draft_id LEFT JOIN told b ON b.doc_id = p.doc_id),
h AS (SELECT draft_id, doc_id, overall, context, decision, coalesce(t >= 0.78 OR (t >= 0.72 AND shared >= 1), false) AS high_title, overall >= 0.75 OR (overall >= 0.7 AND shared >= 2) AS high_overall, context >= 0.6 OR (context >= 0.55 AND shared >= 1) AS high_context FROM f),
j AS (SELECT *, CASE WHEN (high_title AND (overall >= 0.55 OR context >= 0.4 OR decision >= 0.45)) OR high_overall OR (high_context AND decision >= 0.55) THEN 'DUPLICATE_RISK' WHEN high_context AND decision < 0.52 THEN 'CONFLICT_RISK'
  WHEN overall >= 0.52 OR high_context OR decision >= 0.55 OR high_title THEN 'EXTENSION_CANDIDATE' ELSE 'NOVEL' END AS verdict FROM h WHERE overall >= 0.5 OR context >= 0.5 OR decision >= 0.5 OR high_title)"""
_STOP = ", ".join(f"'{w}'" for w in (*T.STOP_WORDS, *T.GENERIC_WORDS))


def _shingles(column: str) -> str:
    clauses = f"string_split_regex(coalesce({column}, ''), '[.!?;:\\n\\r|()\\[\\]{{}}\"]+')"
    words = "list_filter(string_split_regex(regexp_replace(lower(c), '[^a-z0-9\\s_-]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
    gram = lambda n: f"list_transform(list_filter(range(1, greatest(len(ws) - {n} + 2, 1)), lambda i: len(list_filter(list_slice(ws, i, i + {n} - 1), lambda w: list_contains(stop, w))) = 0), lambda i: array_to_string(list_slice(ws, i, i + {n} - 1), ' '))"
    return clauses, words, gram


def _vocabulary_sql() -> str:
    clauses, words, gram = _shingles("body")
    return f"""
WITH cur AS (SELECT repo, id, max(revision) AS revision FROM documents_parsed GROUP BY repo, id),
rec AS (
  SELECT d.repo, d.id, any_value(coalesce(d.raw_content, '')) AS t, any_value(d.metadata) AS metadata, any_value(d.sections) AS sections
  FROM documents_parsed d JOIN cur ON d.repo = cur.repo AND d.id = cur.id AND d.revision = cur.revision WHERE d.is_deleted = false GROUP BY d.repo, d.id
),
head AS (SELECT repo, id, trim(regexp_replace(regexp_replace(h, '(?i)^ADR[-:\\s]*[0-9]{{1,4}}[:\\s-]*', ''), '[:|()]', ' ', 'g')) AS phrase FROM (SELECT repo, id, unnest(regexp_extract_all(t, '(?m)^#{{1,3}}[ \\t]+([^\\r\\n]+)\\r?$', 1)) AS h FROM rec)),
opt AS (SELECT repo, id, trim(regexp_replace(o, '["`]', '', 'g')) AS phrase FROM (SELECT repo, id, unnest(regexp_extract_all(t, '(?i)(?:Option|\\* Option|\\+ Option|- Option)[ \\t]+[0-9]+:[ \\t]*([^\\n\\r]+)', 1)) AS o FROM rec)),
body AS (
  SELECT repo, id, 'clause_shingle' AS source, concat_ws(chr(10), metadata.title, sections.context, sections.decision, sections.considered_options) AS body FROM rec
  UNION ALL SELECT repo, id, 'header', phrase FROM head UNION ALL SELECT repo, id, 'option_title', phrase FROM opt
),
cl AS (SELECT repo, id, source, {words} AS ws, [{_STOP}] AS stop FROM (SELECT repo, id, source, unnest({clauses}) AS c FROM body)),
cand AS (
  SELECT repo, id, 'code_span' AS source, trim(s) AS phrase FROM (SELECT repo, id, unnest(regexp_extract_all(t, '`([^`\\n\\r]+)`', 1)) AS s FROM rec) WHERE length(trim(s)) BETWEEN 2 AND 45
  UNION ALL SELECT repo, id, 'header', phrase FROM head UNION ALL SELECT repo, id, 'option_title', phrase FROM opt
  UNION ALL SELECT repo, id, 'acronym', a FROM (SELECT repo, id, unnest(regexp_extract_all(t, '\\b(?:[a-z]{{1,2}}[A-Z]{{2,}}|[A-Z][A-Z0-9_-]{{1,8}})\\b')) AS a FROM rec) WHERE a NOT IN ({", ".join(f"'{a}'" for a in T.STOP_ACRONYMS)})
  UNION ALL SELECT repo, id, 'title_case', unnest(regexp_extract_all(t, '\\b[A-Z][a-z0-9]+(?:\\s+[A-Z][a-z0-9]+){{1,3}}\\b')) FROM rec
  UNION ALL SELECT repo, id, source, unnest({gram(2)}) FROM cl UNION ALL SELECT repo, id, source, unnest({gram(3)}) FROM cl
),
cleaned AS (SELECT repo, id, source, trim(regexp_replace(regexp_replace(regexp_replace(lower(phrase), '[`*_~#\\[\\]()<>]', ' ', 'g'), '[^a-z0-9\\s_-]', ' ', 'g'), '\\s+', ' ', 'g')) AS p FROM cand),
kept AS (
  SELECT *, regexp_replace(regexp_replace(p, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS term, len(string_split(p, ' ')) AS n FROM cleaned
  WHERE length(p) BETWEEN 2 AND 50 AND len(string_split(p, ' ')) BETWEEN 1 AND 4 AND NOT (len(string_split(p, ' ')) = 1 AND p IN ({_STOP})) AND p NOT IN ({", ".join(f"'{a}'" for a in vocabulary.SENTENCE_STARTERS)}) AND regexp_matches(p, '[a-z0-9]')
),
agg AS (SELECT term, count(DISTINCT repo || '/' || id) AS doc_count, count(*) AS total_occurrences, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources, max(CASE WHEN contains(term, '_') THEN 1 ELSE 0 END) AS bonded FROM kept WHERE term <> '' GROUP BY term)
SELECT term, doc_count, total_occurrences, sources FROM agg WHERE regexp_matches(sources, 'code_span|header|option_title|acronym') OR doc_count >= 2 OR (bonded = 1 AND total_occurrences >= 3)"""


_DIFFS = """
p AS (SELECT DISTINCT repo, coalesce(relative_path, 'record.md') AS relative_path, raw_content FROM documents_parsed WHERE raw_content IS NOT NULL),
x AS (SELECT sha256(concat_ws('|', repo, relative_path, raw_content)) AS diff_id, repo, relative_path, replace(raw_content, chr(13), '') AS t FROM p)"""

ORACLE = {
    "vocabulary": _vocabulary_sql(),
    "vocabulary_top": f"SELECT term, doc_count, total_occurrences FROM ({_vocabulary_sql()}) WHERE doc_count >= 2 ORDER BY doc_count DESC, total_occurrences DESC, term LIMIT 50",
    "overlap_verdicts": f"WITH {_OVERLAP} SELECT draft_id, doc_id, overall, context, decision, verdict FROM j",
    "overlap_summary": f"""WITH {_OVERLAP}, t AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY draft_id ORDER BY overall DESC, doc_id) <= 5)
SELECT draft_id, CASE max(CASE verdict WHEN 'DUPLICATE_RISK' THEN 3 WHEN 'CONFLICT_RISK' THEN 2 WHEN 'EXTENSION_CANDIDATE' THEN 1 ELSE 0 END) WHEN 3 THEN 'DUPLICATE_RISK' WHEN 2 THEN 'CONFLICT_RISK' WHEN 1 THEN 'EXTENSION_CANDIDATE' ELSE 'NOVEL' END AS verdict,
  max(overall) AS confidence, count(*) AS matches FROM t GROUP BY draft_id""",
    "diff_files": f"WITH {_DIFFS} SELECT diff_id, 0 AS file_ord, relative_path AS path, 'added' AS change_type, len(list_filter(string_split(t, chr(10)), lambda l: NOT starts_with(l, '++'))) AS n_added, 0 AS n_deleted FROM x UNION ALL SELECT diff_id, 1, 'package.json', 'modified', 1, 1 FROM x",
    "diff_dependencies": f"WITH {_DIFFS} SELECT diff_id, 'package.json' AS path, repo AS name, '1.0.0' AS version FROM x",
}
