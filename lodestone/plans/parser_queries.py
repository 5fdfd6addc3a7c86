"""Queries that parse every delivered record anew and list its chunks, entities and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import records
from lodestone.plans.record_queries import read


def _raw(s, d):
    """Every delivery with a text, by its distinct content."""
    return read(s, d, "documents_parsed").where(F.col("raw_content").isNotNull()).select("repo", "relative_path", "raw_content").distinct()


def _parsed(s, d):
    return records.parse(_raw(s, d), "relative_path", "raw_content")


def _list(c):
    return F.coalesce(F.array_join(F.col(c), "|"), F.lit(""))


def _catalog(s, d, status=None):
    """Live records in the catalogue's order, each with its place in its repository."""
    keep = F.max_by(F.struct("is_deleted", F.struct(F.coalesce("metadata.status", F.lit("")).alias("status")).alias("metadata")), "revision")
    live = read(s, d, "documents_parsed").groupBy("repo", "id").agg(keep.alias("c")).select("repo", "id", "c.*").where("is_deleted = false")
    return records.catalog_places(live, status).select("repo", "id", F.col("metadata.status").alias("status"), "place")


QUERIES = {
    "record_fields": lambda s, d: _parsed(s, d).select(
        "repo", F.col("file_path").alias("path"), "content_hash", "parsed_id", F.col("metadata.title").alias("title"), F.col("metadata.status").alias("status"), F.col("metadata.date").alias("date"),
        _list("metadata.deciders").alias("deciders"), F.col("metadata.technical_story").alias("story"), _list("metadata.depends_on").alias("depends_on"), _list("metadata.superseded_by").alias("superseded_by"), F.col("metadata.category").alias("category"),
    ),
    "record_sections": lambda s, d: _parsed(s, d).select("repo", F.col("file_path").alias("path"), "content_hash", *[F.col(f"sections.{k}").alias(k) for k in records.SECTIONS]),
    "record_chunks": lambda s, d: records.chunks(_parsed(s, d)).groupBy("repo", "section_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")),
    "record_entities": lambda s, d: _raw(s, d).select("repo", F.col("relative_path").alias("path"), F.sha2("raw_content", 256).alias("content_hash"), F.array_join(T.entities(F.col("raw_content")), "|").alias("entities")),
    "record_citations": lambda s, d: _parsed(s, d).select("repo", F.col("file_path").alias("path"), "content_hash", F.array_join("inline_references", "|").alias("citations")),
    "catalog_order": lambda s, d: _catalog(s, d),
    "catalog_by_status": lambda s, d: _catalog(s, d, "accepted"),
    "record_diagrams": lambda s, d: _parsed(s, d).select("repo", F.col("file_path").alias("path"), "content_hash", F.size(F.coalesce("sections.diagrams", F.array().cast("array<string>"))).cast("bigint").alias("n_diagrams"), _list("sections.diagrams").alias("diagrams")),
    "record_links": lambda s, d: _parsed(s, d).select("repo", F.col("file_path").alias("path"), "content_hash", *[_list(f"metadata.{k}").alias(k) for k in ("supersedes", "extends", "amends", "required_by")]),
}

_WS = r"[\s\x{00A0}\x{FEFF}]"


def _trim(x):
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def _last(column, keys):
    names = ", ".join(f"'{k}'" for k in keys)
    return f"list_filter({column}, lambda z: z.k IN ({names}))[-1].v"


_RAW = "raw AS (SELECT DISTINCT repo, relative_path AS path, raw_content AS t FROM documents_parsed WHERE raw_content IS NOT NULL)"
_LINES = f"""{_RAW},
l AS (SELECT repo, path, t, sha256(t) AS content_hash, string_split_regex(t, '\\r?\\n') AS ls, regexp_extract(path, '[^/\\\\]*$') AS name FROM raw),
h AS (
  SELECT *, list_filter(ls, lambda x: starts_with({_trim('x')}, '# '))[1] AS h1raw,
    list_position(list_transform(ls, lambda x: regexp_matches({_trim('x')}, '^##\\s+')), true) AS h2,
    list_transform(list_slice(string_split_regex(chr(10) || replace(t, chr(13) || chr(10), chr(10)), '\\n##[ \\t\\x{{00A0}}]+'), 2, 100000), lambda p: struct_pack(k := lower({_trim("regexp_extract(p, '^[^\\n]*')")}), v := CASE WHEN contains(p, chr(10)) THEN {_trim("regexp_replace(p, '^[^\\n]*\\n', '')")} ELSE '' END)) AS sec
  FROM l
),
k AS (
  SELECT *, {_trim("regexp_replace(h1raw, '^#\\s+', '')")} AS h1,
    list_transform(list_filter(list_transform(list_slice(ls, 1, CASE WHEN h2 > 0 THEN h2 - 1 ELSE 40 END), lambda x: regexp_replace({_trim('x')}, '^[*+-]\\s+', '')), lambda x: contains(x, ':')),
      lambda x: struct_pack(k := lower({_trim("regexp_replace(split_part(x, ':', 1), '[*_#]', '', 'g')")}), v := {_trim("regexp_replace(regexp_replace(regexp_replace(x, '^[^:]*:', ''), '^[*_]+', ''), '[*_]+$', '')")})) AS kv
  FROM h
)"""
_F1 = r"(?i)^(?:ADR[-:]\s*([0-9A-Za-z-]+)|([0-9]{1,4})\.)(?::|\s+)-(.*)$"
_F2 = r"(?i)^(?:ADR-)?([0-9A-Za-z_-]+):\s*(.*)$"
_ID = f"""coalesce(nullif(regexp_extract(name, '(?i)^(?:adr-)?([0-9]{{3,4}})', 1), ''),
  nullif(CASE WHEN regexp_matches(h1, '{_F1}') THEN coalesce(nullif(regexp_extract(h1, '{_F1}', 1), ''), regexp_extract(h1, '{_F1}', 2)) WHEN regexp_matches(h1, '{_F2}') THEN regexp_extract(h1, '{_F2}', 1) END, ''),
  nullif(regexp_replace(name, '(?i)\\.md$', ''), ''))"""
_TITLE = f"""coalesce(nullif({_trim(f"CASE WHEN regexp_matches(h1, '{_F1}') THEN coalesce(nullif(regexp_extract(h1, '{_F1}', 3), ''), nullif(regexp_extract(h1, '{_F1}', 2), ''), h1) WHEN regexp_matches(h1, '{_F2}') THEN coalesce(nullif(regexp_extract(h1, '{_F2}', 2), ''), h1) ELSE h1 END")}, ''),
  regexp_replace(regexp_replace(name, '(?i)\\.md$', ''), '[-_]', ' ', 'g'))"""


def _value(key):
    return _last("kv", records.KEYS[key])


def _joined(v):
    return f"array_to_string(list_filter(list_transform(string_split_regex({v}, '[,;]'), lambda x: {_trim('x')}), lambda x: length(x) > 0), '|')"


def _numbers(v):
    all_ = f"regexp_extract_all({v}, '[0-9]{{3,4}}')"
    ordered = f"list_filter({all_}, lambda x, i: list_position({all_}, x) = i)"
    return f"coalesce(CASE WHEN len({all_}) > 0 THEN array_to_string({ordered}, '|') ELSE {_joined(v)} END, '')"


def _section(name):
    return "coalesce(" + ", ".join(f"nullif({_last('sec', [n])}, '')" for n in records.SECTIONS[name]) + ", '')"


_ENTITIES = f"""list_concat(list_concat(list_concat(
  list_transform(list_filter(list_transform(regexp_extract_all(t, '`([^`\\n\\r]+)`', 1), lambda x: trim(x)), lambda x: length(x) BETWEEN 2 AND 40 AND NOT contains(x, ' ')), lambda x: lower(x)),
  list_transform(list_filter(regexp_extract_all(t, '\\b[A-Z][A-Z0-9_-]{{1,10}}\\b'), lambda x: x NOT IN ({", ".join(f"'{a}'" for a in T.STOP_ACRONYMS)})), lambda x: lower(x))),
  list_transform(regexp_extract_all(t, '(?i)\\b({T.TECHNOLOGIES})\\b'), lambda x: regexp_replace(lower(x), '\\s+', '-', 'g'))),
  list_transform(regexp_extract_all(t, '(?i)ADR[-:\\s]*([0-9]{{1,4}})', 1), lambda x: 'adr-' || lpad(x, 4, '0')))"""


def _prose(x):
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?s)```.*?```', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[|:-]{{3,}}', ' ', 'g'), '{_WS}+', ' ', 'g'))"


def _words(x, n):
    return f"CASE WHEN len(string_split({x}, ' ')) <= {n} THEN {x} ELSE array_to_string(list_slice(string_split({x}, ' '), 1, {n}), ' ') || '...' END"


_CATALOG = """WITH cur AS (SELECT repo, id, max(revision) AS revision FROM documents_parsed GROUP BY repo, id),
live AS (
  SELECT d.repo, d.id, any_value(coalesce(d.metadata.status, '')) AS status, TRY_CAST(regexp_extract(d.id, '([0-9]+)', 1) AS BIGINT) AS n
  FROM documents_parsed d JOIN cur ON d.repo = cur.repo AND d.id = cur.id AND d.revision = cur.revision WHERE d.is_deleted = false GROUP BY d.repo, d.id
)"""

ORACLE = {
    "record_fields": f"""WITH {_LINES}
SELECT repo, path, content_hash, {_ID} AS parsed_id, {_TITLE} AS title, coalesce(lower({_value('status')}), 'proposed') AS status,
  CASE WHEN regexp_matches({_value('date')}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN regexp_extract({_value('date')}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') ELSE {_value('date')} END AS date,
  coalesce({_joined(_value('deciders'))}, '') AS deciders, {_value('technical_story')} AS story, {_numbers(_value('depends_on'))} AS depends_on, {_numbers(_value('superseded_by'))} AS superseded_by, {_value('category')} AS category FROM k""",
    "record_sections": f"WITH {_LINES} SELECT repo, path, content_hash, " + ", ".join(f"{_section(n)} AS {n}" for n in records.SECTIONS) + " FROM k",
    "record_entities": f"WITH {_RAW}, e AS (SELECT repo, path, t, {_ENTITIES} AS e FROM raw) SELECT repo, path, sha256(t) AS content_hash, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), '|') AS entities FROM e",
    "catalog_order": f"{_CATALOG} SELECT repo, id, status, row_number() OVER (PARTITION BY repo ORDER BY n NULLS LAST, id) AS place FROM live",
    "catalog_by_status": f"{_CATALOG} SELECT repo, id, status, row_number() OVER (PARTITION BY repo ORDER BY n NULLS LAST, id) AS place FROM live WHERE lower(status) = 'accepted'",
    "record_diagrams": f"""WITH {_LINES}, g AS (SELECT repo, path, content_hash, list_transform(regexp_extract_all(replace(t, chr(13) || chr(10), chr(10)), '(?s)```mermaid(.*?)```', 1), lambda x: {_trim('x')}) AS g FROM k)
SELECT repo, path, content_hash, len(g) AS n_diagrams, array_to_string(g, '|') AS diagrams FROM g""",
    "record_links": f"WITH {_LINES} SELECT repo, path, content_hash, " + ", ".join(f"{_numbers(_value(name))} AS {name}" for name in ("supersedes", "extends", "amends", "required_by")) + " FROM k",
    "record_citations": f"""WITH {_LINES},
c AS (SELECT repo, path, content_hash, {_ID} AS own, list_transform(regexp_extract_all(t, '(?i)(?:legacy\\s+adr[-:\\s]*[0-9]{{1,4}}|adr[-:\\s]*[0-9]{{3,4}}|(?:docs/adr|legacy_adr)/(?:adr-)?[0-9]{{3,4}})'), lambda x: regexp_extract(x, '([0-9]+)$', 1)) AS n FROM k)
SELECT repo, path, content_hash, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i AND x <> coalesce(own, '')), '|') AS citations FROM c""",
    "record_chunks": f"""WITH {_LINES},
p AS (SELECT repo, {_ID} AS id, {_TITLE} AS title, coalesce(lower({_value('status')}), 'proposed') AS status, {_value('category')} AS category, {_prose(_section('context'))} AS c, {_prose(_section('decision'))} AS d, {_prose(_section('considered_options'))} AS o,
  length({_section('context')}) > 0 AS has_c, length({_section('decision')}) > 0 AS has_d FROM k),
t AS (
  SELECT repo, 'summary' AS section_type, concat_ws(chr(10), 'ADR ' || id || ': ' || title, 'Status: ' || status, CASE WHEN length(category) > 0 THEN 'Category: ' || category END, CASE WHEN has_c THEN 'Context: ' || {_words('c', 120)} END, CASE WHEN has_d THEN 'Decision: ' || {_words('d', 120)} END) AS text FROM p
  UNION ALL SELECT repo, 'context', 'ADR ' || id || ' Context: ' || {_words('c', 250)} FROM p WHERE length(c) > 0
  UNION ALL SELECT repo, 'decision', 'ADR ' || id || ' Decision: ' || {_words('d', 250)} FROM p WHERE length(d) > 0
  UNION ALL SELECT repo, 'options', 'ADR ' || id || ' Options: ' || {_words('o', 200)} FROM p WHERE length(o) > 0
)
SELECT repo, section_type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM t GROUP BY 1, 2""",
}
