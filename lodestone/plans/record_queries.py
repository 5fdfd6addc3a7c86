"""Queries on deliveries of records: the next run's work and references that lead nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators import incremental, references
from lodestone.session import scratch_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _work(spark, d, operator):
    return operator(read(spark, d, "documents_parsed"), read(spark, d, "index_state"), read(spark, d, "index_runs"))


def _run(spark, d):
    """The next run's records, planned, leased and committed through a ledger of its own in the shared folder."""
    return _work(spark, d, lambda *tables: incremental.run_pending(*tables, scratch_path(spark, "ledger"), "next"))


QUERIES = {
    "p1_found": lambda s, d: _run(s, d).select("repo", "id"),
    "p1_reasons": lambda s, d: _run(s, d).select("repo", "id", "content_hash", "reason", "prior_token"),
    "p1_removed": lambda s, d: _work(s, d, incremental.removed_records).select("repo", "id", "token"),
    "p5_found": lambda s, d: references.orphan_references(read(s, d, "documents_parsed")).drop("period"),
    "p5_report": lambda s, d: references.orphan_report(read(s, d, "documents_parsed")),
}

_CURRENT = """
cur AS (
  SELECT repo, id, max(revision) AS revision FROM documents_parsed GROUP BY repo, id
), rec AS (
  SELECT d.repo, d.id, max(CASE WHEN d.is_deleted = false THEN 1 ELSE 0 END) AS live,
         max(coalesce(regexp_replace(lower(trim(d.content_hash)), '^[a-z0-9_-]+[:=]', ''), sha256(d.raw_content))) AS content_hash
  FROM documents_parsed d JOIN cur ON d.repo = cur.repo AND d.id = cur.id AND d.revision = cur.revision
  GROUP BY d.repo, d.id
), done AS (
  SELECT repo, id, run_id AS token, regexp_replace(lower(trim(content_hash)), '^[a-z0-9_-]+[:=]', '') AS done_hash
  FROM index_state JOIN index_runs USING (run_id) WHERE status = 'succeeded'
  QUALIFY row_number() OVER (PARTITION BY repo, id ORDER BY run_id DESC, indexed_at DESC, content_hash DESC) = 1
)"""

_REFS = """
first_seen AS (
  SELECT repo, id, min(ingested_at) AS seen, max(revision) AS revision FROM documents_parsed GROUP BY repo, id
), src AS (
  SELECT d.repo, d.id, min(d.ingested_at) AS seen, max(CASE WHEN d.is_deleted = false THEN 1 ELSE 0 END) AS live,
         any_value(d.metadata) AS metadata
  FROM documents_parsed d JOIN first_seen f ON d.repo = f.repo AND d.id = f.id AND d.revision = f.revision
  GROUP BY d.repo, d.id
), named AS (
  SELECT repo, id, seen, 'depends_on' AS field, unnest(metadata.depends_on) AS v FROM src WHERE live = 1
  UNION ALL SELECT repo, id, seen, 'superseded_by', unnest(metadata.superseded_by) FROM src WHERE live = 1
  UNION ALL SELECT repo, id, seen, 'required_by', unnest(metadata.required_by) FROM src WHERE live = 1
), refs AS (
  SELECT DISTINCT repo, id, seen, field, CAST(regexp_extract(v, '[0-9]+') AS BIGINT) AS n FROM named WHERE regexp_matches(v, '[0-9]')
), target AS (
  SELECT s.repo, CAST(regexp_extract(s.id, '[0-9]+') AS BIGINT) AS n, max(s.live) AS live, min(f.seen) AS target_seen
  FROM src s JOIN first_seen f ON s.repo = f.repo AND s.id = f.id GROUP BY 1, 2
), judged AS (
  SELECT r.repo, r.id, r.field, CASE WHEN r.n < 10000 THEN lpad(CAST(r.n AS VARCHAR), 4, '0') ELSE CAST(r.n AS VARCHAR) END AS target_id,
         CASE WHEN t.n IS NULL THEN 'missing' WHEN t.live = 0 THEN 'deleted' WHEN t.target_seen > r.seen THEN 'late' ELSE 'ok' END AS kind,
         strftime(r.seen, '%Y-%m') AS period
  FROM refs r LEFT JOIN target t ON r.repo = t.repo AND r.n = t.n
)"""

ORACLE = {
    "p1_found": f"WITH {_CURRENT} SELECT r.repo, r.id FROM rec r LEFT JOIN done USING (repo, id) WHERE r.live = 1 AND r.content_hash IS DISTINCT FROM done.done_hash",
    "p1_reasons": f"WITH {_CURRENT} SELECT r.repo, r.id, r.content_hash, CASE WHEN token IS NULL THEN 'new' ELSE 'changed' END AS reason, token AS prior_token FROM rec r LEFT JOIN done USING (repo, id) WHERE r.live = 1 AND r.content_hash IS DISTINCT FROM done.done_hash",
    "p1_removed": f"WITH {_CURRENT} SELECT done.repo, done.id, done.token FROM done LEFT JOIN rec r USING (repo, id) WHERE coalesce(r.live, 0) = 0",
    "p5_found": f"WITH {_REFS} SELECT repo, id, field, target_id, kind FROM judged WHERE kind <> 'ok'",
    "p5_report": f"WITH {_REFS} SELECT field, period, count(*) AS n_references, count(CASE WHEN kind = 'missing' THEN 1 END) AS missing, count(CASE WHEN kind = 'deleted' THEN 1 END) AS deleted, count(CASE WHEN kind = 'late' THEN 1 END) AS late FROM judged GROUP BY field, period",
}
