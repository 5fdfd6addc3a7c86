"""Graph queries; every record whose number is divisible by 20 is a start, over all edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.plans.record_queries import read
from lodestone.session import materialize


def _parts(s, d):
    records = graph.current(read(s, d, "documents_parsed"))
    node, edge = materialize(graph.nodes(records), "nodes"), materialize(graph.edges(records), "edges")
    starts = node.where(F.expr("try_cast(id AS BIGINT) % 20 = 0")).select("repo", "id")
    return node, edge, starts


def _query(f):
    return lambda s, d: f(*_parts(s, d))


QUERIES = {
    "graph_edges": _query(lambda n, e, st: e.select("repo", "source", "target", "type", "explicit")),
    "graph_inverse": _query(lambda n, e, st: graph.with_inverse(e).groupBy("type").agg(F.count(F.lit(1)).alias("n"))),
    "graph_aliases": _query(lambda n, e, st: graph.aliases(n)),
    "graph_dependencies": _query(lambda n, e, st: graph.dependencies(st, e, n).select("repo", "start", "id", "status", "depth", "outdated")),
    "graph_impact": _query(lambda n, e, st: graph.impact(st, e)),
    "graph_ancestors": _query(lambda n, e, st: graph.ancestors(st, e)),
    "graph_lineage": _query(lambda n, e, st: graph.lineage(n.select("repo", "id"), e).select("repo", "start", "active", "steps")),
    "graph_neighborhood": _query(lambda n, e, st: graph.neighborhood(st, e, 2)),
    "graph_cycles": _query(lambda n, e, st: graph.cycles(e)),
    "graph_issues": _query(lambda n, e, st: graph.issues(e, n)),
    "graph_diagram": _query(lambda n, e, st: graph.diagram(n, e)),
}

_NUM = "CASE WHEN {0} IS NULL OR NOT regexp_matches({0}, '[0-9]') THEN NULL ELSE CASE WHEN CAST(regexp_extract({0}, '[0-9]+') AS BIGINT) > 9999 THEN CAST(CAST(regexp_extract({0}, '[0-9]+') AS BIGINT) AS VARCHAR) ELSE lpad(CAST(CAST(regexp_extract({0}, '[0-9]+') AS BIGINT) AS VARCHAR), 4, '0') END END"
_LISTS = " UNION ALL ".join(
    f"SELECT repo, own, '{r}' AS type, {'true' if back else 'false'} AS back, unnest(metadata.{name}) AS v FROM rec" for name, r, back in graph.LISTS
)
_BASE = f"""
cur AS (SELECT repo, id, max(revision) AS revision FROM documents_parsed GROUP BY repo, id),
rec0 AS (
  SELECT d.repo, d.id, any_value(d.metadata) AS metadata, any_value(d.inline_references) AS inline_references, any_value(d.file_path) AS file_path, max(d.doc_ord) AS doc_ord
  FROM documents_parsed d JOIN cur ON d.repo = cur.repo AND d.id = cur.id AND d.revision = cur.revision WHERE d.is_deleted = false GROUP BY d.repo, d.id
),
rec AS (SELECT *, {_NUM.format('id')} AS own FROM rec0 WHERE NOT contains(coalesce(file_path, ''), 'legacy')),
node AS (SELECT repo, own AS id, arg_min(lower(regexp_extract(metadata.status, '[A-Za-z][A-Za-z-]*')), doc_ord) AS status, min(doc_ord) AS doc_ord FROM rec GROUP BY 1, 2),
named AS ({_LISTS}),
expl AS (
  SELECT DISTINCT repo, CASE WHEN back THEN o ELSE own END AS source, CASE WHEN back THEN own ELSE o END AS target, type FROM (SELECT *, {_NUM.format('v')} AS o FROM named) WHERE o IS NOT NULL
),
cited AS (
  SELECT DISTINCT c.repo, c.own AS source, c.o AS target, 'REFERENCES' AS type FROM (SELECT repo, own, {_NUM.format('v')} AS o FROM (SELECT repo, own, unnest(inline_references) AS v FROM rec)) c
  JOIN node ON node.repo = c.repo AND node.id = c.o WHERE c.o <> c.own AND NOT EXISTS (SELECT 1 FROM expl x WHERE x.repo = c.repo AND x.source = c.own AND x.target = c.o)
),
edge AS (SELECT *, true AS explicit FROM expl UNION ALL SELECT *, false AS explicit FROM cited),
start AS (SELECT repo, id FROM node WHERE CAST(id AS BIGINT) % 20 = 0)"""


def _reach(step: str, starts: str = "start") -> str:
    return f"""r AS (
  SELECT repo, id AS start, id, 0 AS depth, [id] AS path FROM {starts}
  UNION SELECT r.repo, r.start, s.target, r.depth + 1, list_append(r.path, s.target) FROM r JOIN ({step}) s ON s.repo = r.repo AND s.source = r.id WHERE s.target <> r.start AND NOT list_contains(r.path, s.target)
), reach AS (SELECT repo, start, id, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY 1, 2, 3)"""


_UP = "SELECT * FROM edge WHERE type IN ('DEPENDS_ON', 'EXTENDS', 'AMENDS')"
_DOWN = "SELECT repo, target AS source, source AS target FROM edge WHERE type IN ('DEPENDS_ON', 'EXTENDS', 'AMENDS')"
_REPLACED = "SELECT * FROM edge WHERE type = 'OBSOLETES'"

ORACLE = {
    "graph_edges": f"WITH {_BASE} SELECT repo, source, target, type, explicit FROM edge",
    "graph_inverse": f"WITH {_BASE} SELECT type, count(*) AS n FROM (SELECT type FROM edge UNION ALL SELECT CASE type WHEN 'OBSOLETES' THEN 'OBSOLETED_BY' WHEN 'EXTENDS' THEN 'EXTENDED_BY' WHEN 'AMENDS' THEN 'AMENDED_BY' WHEN 'DEPENDS_ON' THEN 'REQUIRED_BY' ELSE 'REFERENCED_BY' END FROM edge) GROUP BY type",
    "graph_aliases": f"WITH {_BASE}, a AS (SELECT DISTINCT repo, id, doc_ord, unnest([lower(id), 'adr-' || lower(id), regexp_replace(id, '^0+(.)', '\\1'), 'adr-' || regexp_replace(id, '^0+(.)', '\\1')]) AS alias FROM node) SELECT repo, alias, arg_max(id, (doc_ord, id)) AS id FROM a GROUP BY repo, alias",
    "graph_dependencies": f"WITH RECURSIVE {_BASE}, {_reach(_UP)} SELECT reach.repo, reach.start, reach.id, coalesce(status, 'unknown') AS status, depth, coalesce(status, 'unknown') IN ('deprecated', 'superseded') AS outdated FROM reach LEFT JOIN node ON node.repo = reach.repo AND node.id = reach.id",
    "graph_impact": f"""WITH RECURSIVE {_BASE}, {_reach(_DOWN)},
deep AS (SELECT repo, start, count(*) AS transitive FROM reach WHERE depth >= 2 GROUP BY 1, 2),
near AS (SELECT repo, target AS start, count(CASE WHEN type = 'DEPENDS_ON' THEN 1 END) AS direct, count(CASE WHEN type IN ('EXTENDS', 'AMENDS') THEN 1 END) AS extensions, count(CASE WHEN type = 'REFERENCES' THEN 1 END) AS citations FROM edge GROUP BY 1, 2)
SELECT s.repo, s.id AS start, coalesce(direct, 0) AS direct, coalesce(extensions, 0) AS extensions, coalesce(citations, 0) AS citations, coalesce(transitive, 0) AS transitive,
  CAST(3 * coalesce(direct, 0) + 2 * coalesce(extensions, 0) + 1.5 * coalesce(transitive, 0) AS DOUBLE) AS score
FROM start s LEFT JOIN near ON near.repo = s.repo AND near.start = s.id LEFT JOIN deep ON deep.repo = s.repo AND deep.start = s.id""",
    "graph_ancestors": f"WITH RECURSIVE {_BASE}, {_reach(_REPLACED)} SELECT repo, start, id, depth FROM reach",
    "graph_lineage": f"""WITH RECURSIVE {_BASE},
succ AS (SELECT repo, target AS id, arg_min(source, (CASE WHEN type = 'OBSOLETES' THEN 0 ELSE 1 END, source)) AS next FROM edge WHERE type IN ('OBSOLETES', 'AMENDS') GROUP BY 1, 2),
c AS (SELECT repo, id AS start, id, [id] AS path FROM node UNION ALL SELECT c.repo, c.start, s.next, list_append(c.path, s.next) FROM c JOIN succ s ON s.repo = c.repo AND s.id = c.id WHERE NOT list_contains(c.path, s.next))
SELECT repo, start, arg_max(id, len(path)) AS active, CAST(max(len(path)) - 1 AS INTEGER) AS steps FROM c GROUP BY repo, start""",
    "graph_neighborhood": f"""WITH {_BASE}, both_ AS (SELECT repo, source, target FROM edge UNION SELECT repo, target, source FROM edge),
one AS (SELECT s.repo, s.id AS start, b.target AS id FROM start s JOIN both_ b ON b.repo = s.repo AND b.source = s.id),
two AS (SELECT o.repo, o.start, b.target AS id FROM one o JOIN both_ b ON b.repo = o.repo AND b.source = o.id)
SELECT repo, start, id, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT *, 1 AS depth FROM one UNION ALL SELECT *, 2 FROM two) WHERE id <> start GROUP BY repo, start, id""",
    "graph_issues": f"""WITH {_BASE}
SELECT repo, 'DANGLING_TARGET' AS code, 'error' AS severity, source AS id, target AS other FROM edge e WHERE explicit AND NOT EXISTS (SELECT 1 FROM node n WHERE n.repo = e.repo AND n.id = e.target)
UNION ALL SELECT repo, 'DANGLING_SOURCE', 'error', source, target FROM edge e WHERE explicit AND NOT EXISTS (SELECT 1 FROM node n WHERE n.repo = e.repo AND n.id = e.source)
UNION ALL SELECT * FROM (SELECT DISTINCT e.repo, 'STATUS_CONTRADICTION', 'warning', e.source, e.target FROM edge e JOIN node a ON a.repo = e.repo AND a.id = e.source JOIN node b ON b.repo = e.repo AND b.id = e.target WHERE a.status = 'accepted' AND e.type IN ('EXTENDS', 'DEPENDS_ON') AND b.status IN ('superseded', 'deprecated'))
UNION ALL SELECT e.repo, 'SPLIT_BRAIN', 'error', e.target, e.source FROM edge e JOIN node a ON a.repo = e.repo AND a.id = e.source JOIN node b ON b.repo = e.repo AND b.id = e.target WHERE a.status = 'accepted' AND e.type = 'OBSOLETES' AND b.status = 'accepted'
UNION ALL SELECT repo, 'ORPHAN_RECORD', 'warning', id, NULL FROM node n WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.repo = n.repo AND (e.source = n.id OR e.target = n.id))""",
}
