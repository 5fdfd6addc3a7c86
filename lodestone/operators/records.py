"""Decision records: parsing of Markdown into typed rows, and chunks of them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T

_EDGE = rf"^{T.BLANK}+|{T.BLANK}+$"
# Spellings of the header keys and section headings that are read.
KEYS = {
    "status": ["status"], "date": ["date"], "deciders": ["deciders", "decision owners"], "technical_story": ["technical story", "related work items"], "supersedes": ["supersedes", "obsoletes"],
    "superseded_by": ["superseded by", "superseded-by", "obsoleted by", "obsoleted-by"], "extends": ["extends"], "amends": ["amends", "updates"],
    "depends_on": ["depends on", "depends-on", "prerequisites", "dependencies"], "required_by": ["required by", "required-by", "decision required before"], "category": ["category"],
}
SECTIONS = {
    "context": ["context and problem statement", "context", "problem statement"], "decision_drivers": ["decision drivers", "drivers"],
    "considered_options": ["considered options", "alternatives considered", "options"], "decision": ["decision outcome", "decision", "decision outcome & rationale"],
    "consequences": ["consequences", "pros and cons of the options"],
}
#: A slice to the end: more elements than a row can hold.
MOST = 1 << 30
REFERENCES = ("supersedes", "superseded_by", "extends", "amends", "depends_on", "required_by")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def _delimited(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[,;]"), _trim), lambda v: F.length(v) > 0)


def _reference_list(c: Column) -> Column:
    """Numbers of three or four digits in order, once each; without any, the delimited values."""
    numbers = F.array_distinct(F.regexp_extract_all(c, F.lit(r"([0-9]{3,4})"), 1))
    return F.when(F.size(numbers) > 0, numbers).otherwise(_delimited(c))


def _some(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def parse(files: DataFrame, path: str = "file_path", content: str = "content", mtime: str | None = None, base_dir: str = "") -> DataFrame:
    """One typed record per row of (path, content); all other columns are kept behind it.

    The id comes from the file name, else from the first heading, else it is the file
    name.  Of repeated keys and headings the last counts.  Headings are recognised on
    any line, also inside code.  Null contents give a record with the default status
    and empty sections.
    """
    kept = [c for c in files.columns if c not in (path, content, mtime)]
    text = F.coalesce(F.col(content), F.lit(""))
    name = F.element_at(F.split(F.col(path), r"[/\\]"), -1)
    stem = F.regexp_replace(name, r"(?i)\.md$", "")
    rows = files.select(
        *kept, F.col(path).alias("file_path"), F.col(content).alias("raw_content"), name.alias("_name"), stem.alias("_stem"),
        (F.col(mtime).cast("double") if mtime else F.lit(None).cast("double")).alias("mtime"), F.split(text, r"\r?\n").alias("_lines"), F.regexp_replace(text, r"\r\n", "\n").alias("_text"),
    )
    h1 = F.element_at(F.filter("_lines", lambda x: _trim(x).startswith("# ")), 1)
    rows = rows.withColumn("_h1", F.when(F.size(F.filter("_lines", lambda x: _trim(x).startswith("# "))) > 0, _trim(F.regexp_replace(h1, r"^#\s+", ""))))
    first, second = r"(?i)^(?:ADR[-:]\s*([0-9A-Za-z-]+)|([0-9]{1,4})\.)(?::|\s+)-(.*)$", r"(?i)^(?:ADR-)?([0-9A-Za-z_-]+):\s*(.*)$"
    by_first, by_second = F.col("_h1").rlike(first), F.col("_h1").rlike(second)
    named = F.when(by_first, F.coalesce(_some(F.regexp_extract("_h1", first, 1)), _some(F.regexp_extract("_h1", first, 2)))).when(by_second, F.regexp_extract("_h1", second, 1))
    titled = (
        F.when(by_first, F.coalesce(_some(F.regexp_extract("_h1", first, 3)), _some(F.regexp_extract("_h1", first, 2)), F.col("_h1")))
        .when(by_second, F.coalesce(_some(F.regexp_extract("_h1", second, 2)), F.col("_h1")))
        .otherwise(F.col("_h1"))
    )
    from_name = _some(F.regexp_extract("_name", r"(?i)^(?:adr-)?([0-9]{3,4})", 1))
    rows = rows.withColumn("_id", F.coalesce(from_name, _some(_trim(named)), _some(F.col("_stem")))).withColumn("_title", F.coalesce(_some(_trim(titled)), F.regexp_replace("_stem", "[-_]", " ")))
    h2 = F.array_position(F.transform("_lines", lambda x: _trim(x).rlike(r"^##\s+")), True)
    zone = F.slice("_lines", F.lit(1), F.when(h2 > 0, (h2 - 1).cast("int")).otherwise(F.lit(40)))
    bare = F.filter(F.transform(zone, lambda x: F.regexp_replace(_trim(x), r"^[*+-]\s+", "")), lambda x: F.contains(x, F.lit(":")))
    pair = lambda x: F.struct(
        F.lower(_trim(F.regexp_replace(F.substring_index(x, ":", 1), "[*_#]", ""))).alias("k"), _trim(F.regexp_replace(F.regexp_replace(x, "^[^:]*:", ""), r"^[*_]+|[*_]+$", "")).alias("v")
    )
    rows = rows.withColumn("_kv", F.transform(bare, pair))
    parts = F.slice(F.split(F.concat(F.lit("\n"), F.col("_text")), r"\n##[ \t ]+(?=[^\s])"), 2, MOST)
    section = lambda p: F.struct(F.lower(_trim(F.substring_index(p, "\n", 1))).alias("k"), F.when(F.contains(p, F.lit("\n")), _trim(F.regexp_replace(p, r"^[^\n]*\n", ""))).otherwise(F.lit("")).alias("v"))
    rows = rows.withColumn("_sec", F.transform(parts, section))

    def last(column: str, keys: list[str]) -> Column:
        hits = F.filter(column, lambda x: x["k"].isin(keys))
        return F.when(F.size(hits) > 0, F.element_at(hits, -1)["v"])

    values = {k: last("_kv", names) for k, names in KEYS.items()}
    iso = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
    date = F.when(values["date"].rlike(iso), F.regexp_extract(values["date"], iso, 1)).otherwise(values["date"])
    metadata = F.struct(
        F.col("_id").alias("id"), F.col("_title").alias("title"), F.coalesce(F.lower(values["status"]), F.lit("proposed")).alias("status"), date.alias("date"), _delimited(values["deciders"]).alias("deciders"),
        values["technical_story"].alias("technical_story"), *[F.when(values[r].isNotNull(), _reference_list(values[r])).alias(r) for r in REFERENCES], values["category"].alias("category"),
    )
    section_texts = {k: F.coalesce(*[_some(last("_sec", [n])) for n in names], F.lit("")) for k, names in SECTIONS.items()}
    diagrams = F.transform(F.regexp_extract_all("_text", F.lit(r"(?s)```mermaid(.*?)```"), 1), _trim)
    sections = F.struct(*[v.alias(k) for k, v in section_texts.items()], F.when(F.size(diagrams) > 0, diagrams).alias("diagrams"))
    rows = rows.withColumn("metadata", metadata).withColumn("sections", sections)
    prose = lambda c: T.truncate_words(T.clean_prose(c), 120)
    summary = F.concat_ws(
        "\n", F.concat(F.lit("ADR "), F.col("_id"), F.lit(": "), F.col("_title")), F.concat(F.lit("Status: "), F.col("metadata.status")),
        F.when(F.length("metadata.category") > 0, F.concat(F.lit("Category: "), F.col("metadata.category"))),
        F.when(F.length("sections.context") > 0, F.concat(F.lit("Context: "), prose(F.col("sections.context")))),
        F.when(F.length("sections.decision") > 0, F.concat(F.lit("Decision: "), prose(F.col("sections.decision")))),
    )
    relative = F.when(F.col("file_path").startswith(base_dir.rstrip("/") + "/"), F.substring(F.col("file_path"), len(base_dir.rstrip("/")) + 2, 1 << 20)).otherwise(F.col("file_path")) if base_dir else F.col("file_path")
    source = F.coalesce("raw_content", F.lit(""))
    return rows.select(
        *kept, F.col("_id").alias("parsed_id"), "file_path", relative.alias("relative_path"), F.sha2(source, 256).alias("content_hash"), "mtime", "metadata", "sections", "raw_content",
        summary.alias("summary_text"), T.citations(source, F.col("_id")).alias("inline_references"), T.entities(source).alias("entities"),
    )


def chunks(records: DataFrame, key: str = "parsed_id") -> DataFrame:
    """One to four chunks per record: the summary, and context, decision and options where they have prose."""
    label = {"context": ("Context", 250, "context"), "decision": ("Decision", 250, "decision"), "options": ("Options", 200, "considered_options")}
    made = [F.struct(F.lit("summary").alias("section_type"), F.col("summary_text").alias("text"))]
    for kind, (name, most, section) in label.items():
        prose = T.clean_prose(F.col(f"sections.{section}"))
        text = F.concat(F.lit("ADR "), F.col(key), F.lit(f" {name}: "), T.truncate_words(prose, most))
        made.append(F.when(F.length(prose) > 0, F.struct(F.lit(kind).alias("section_type"), text.alias("text"))))
    kept = [c for c in records.columns if c in ("repo", "revision", "doc_ord")]
    rows = records.select(*kept, F.col(key).alias("doc_id"), F.posexplode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("chunk_ord", "c"))
    return rows.select(*kept, F.concat("doc_id", F.lit("#"), F.col("c.section_type")).alias("chunk_id"), "doc_id", F.col("c.section_type").alias("section_type"), F.col("c.text").alias("text"), "chunk_ord")


def status_word(status: Column) -> Column:
    """The first word of a status; ``superseded by [adr-0012](...)`` is ``superseded``."""
    return F.lower(F.regexp_extract(status, r"([A-Za-z][A-Za-z-]*)", 1))


def lookup(records: DataFrame, wanted: str, key: str = "id", path: str = "file_path", order: str = "doc_ord") -> DataFrame:
    """The record of an exact id, else the first whose id ends with the wanted digits, else whose path ends with it."""
    digits = "".join(c for c in wanted if c.isdigit())
    rank = F.when(F.col(key) == wanted, 0)
    if digits:
        rank = rank.when(F.col(key).endswith(digits), 1)
    if wanted:
        rank = rank.when(F.col(path).endswith(wanted), 1)
    return records.withColumn("_rank", rank).where(F.col("_rank").isNotNull()).orderBy("_rank", order).limit(1).drop("_rank")


def catalog(records: DataFrame, status: str | None = None, key: str = "id") -> DataFrame:
    """Records with a status (any if none is given) in natural order of their ids."""
    kept = records if status is None else records.where(F.lower(F.col("metadata.status")) == status.lower())
    return kept.orderBy(F.expr(f"try_cast(regexp_extract(`{key}`, '([0-9]+)', 1) AS BIGINT)").asc_nulls_last(), key)


def catalog_places(records: DataFrame, status: str | None = None, key: str = "id") -> DataFrame:
    """`catalog` for many repositories at once: adds ``place``, a record's number in its repository's order.

    Records of a status, or all.  Places are counted over ranges of a thousand numbers
    first, so no repository is sorted in one task.
    """
    kept = records if status is None else records.where(F.lower(F.col("metadata.status")) == status.lower())
    number = F.expr(f"try_cast(regexp_extract(`{key}`, '([0-9]+)', 1) AS BIGINT)")
    celled = kept.withColumn("_n", number).withColumn("_cell", F.coalesce(F.floor(F.col("_n") / 1000), F.lit(2**62)))
    counts = celled.groupBy("repo", "_cell").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy("repo").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("repo", "_cell").orderBy(F.col("_n").asc_nulls_last(), key))
    placed = celled.withColumn("_in", inside).join(counts.select("repo", "_cell", before.alias("_before")), ["repo", "_cell"])
    return placed.withColumn("place", (F.col("_before") + F.col("_in")).cast("bigint")).drop("_n", "_cell", "_in", "_before")
