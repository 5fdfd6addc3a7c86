"""Changesets: unified diffs as rows of files, dependencies and keywords; alignment with governing records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Path segments that say nothing, and technologies looked for in added lines.
PLAIN_SEGMENTS = ("src", "lib", "test", "tests", "dist", "app")
KEYWORDS = (
    "postgres|postgresql|mysql|sqlite|redis|kafka|rabbitmq|grpc|protobuf|rest|graphql|oauth|jwt|openid|docker|kubernetes|helm|terraform|vault|aws|azure|gcp|s3|sqs|sns|dynamodb|tracer|otel|"
    "opentelemetry|zap|winston|prometheus"
)
#: A slice to the end: more elements than a row can hold.
MOST = 1 << 30
ADVISORY = ("proposed", "draft", "in-review", "under-review")
HISTORICAL = ("superseded", "deprecated", "rejected", "obsolete")


def files(diffs: DataFrame, key: str = "diff_id", diff: str = "diff") -> DataFrame:
    """(diff_id, file_ord, path, change_type, added, deleted): one row per file of each diff."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), F.coalesce(diff, F.lit(""))), "\ndiff --git "), 2, MOST)
    rows = diffs.select(F.col(key).alias("diff_id"), F.posexplode(parts).alias("file_ord", "part"))
    rows = rows.withColumn("lines", F.slice(F.split("part", "\n"), 2, MOST)).withColumn("head", F.substring_index("part", "\n", 1))
    path = F.regexp_extract("head", r"^a/(.+?) b/(.+)$", 2)
    signal = lambda *starts: F.exists("lines", lambda x: F.startswith(x, F.lit(starts[0])) if len(starts) == 1 else F.startswith(x, F.lit(starts[0])) | F.startswith(x, F.lit(starts[1])))
    last = F.element_at(F.filter("lines", lambda x: x.rlike(r"^(?:new file mode|deleted file mode|similarity index|rename from)")), -1)
    kind = F.when(~signal("new file mode") & ~signal("deleted file mode") & ~signal("similarity index", "rename from"), "modified").otherwise(F.when(last.startswith("new"), "added").when(last.startswith("deleted"), "deleted").otherwise("renamed"))
    cut = lambda sign: F.transform(F.filter("lines", lambda x: F.startswith(x, F.lit(sign)) & ~F.startswith(x, F.lit(sign * 3))), lambda x: F.substr(x, F.lit(2)))
    return rows.select("diff_id", "file_ord", F.when(path == "", "unknown").otherwise(path).alias("path"), kind.alias("change_type"), cut("+").alias("added"), cut("-").alias("deleted"))


def dependencies(file_rows: DataFrame) -> DataFrame:
    """(diff_id, path, name, version): what added lines of package manifests name."""
    lines = file_rows.select("diff_id", "path", F.lower("path").alias("p"), F.explode("added").alias("line"))
    npm, go, py, java = r'"([^"]+)":\s*"([^"]+)"', r"^\s*([a-zA-Z0-9.\-/]+)\s+v([0-9a-zA-Z.\-+]+)", r"^([a-zA-Z0-9_\-]+)\s*(?:==|>=|<=|~=)\s*([a-zA-Z0-9.\-]+)", r"<artifactId>([^<]+)</artifactId>"
    pick = lambda rule, version: F.when(F.col("line").rlike(rule), F.struct(F.regexp_extract("line", rule, 1).alias("name"), version.alias("version")))
    found = (
        F.when(F.col("p").endswith("package.json"), pick(npm, F.regexp_extract("line", npm, 2)))
        .when(F.col("p").endswith("go.mod"), pick(go, F.concat(F.lit("v"), F.regexp_extract("line", go, 2))))
        .when(F.col("p").endswith("requirements.txt") | F.col("p").endswith("pyproject.toml"), pick(py, F.regexp_extract("line", py, 2)))
        .when(F.col("p").endswith("pom.xml") | F.col("p").endswith("build.gradle"), pick(java, F.lit(None).cast("string")))
    )
    return lines.select("diff_id", "path", found.alias("d")).where(F.col("d").isNotNull() & ~F.startswith(F.col("d.name"), F.lit("@types/"))).select("diff_id", "path", "d.*")


def keywords(file_rows: DataFrame) -> DataFrame:
    """(diff_id, keyword): distinct path segments, imported modules and technologies of the first 100 added lines."""
    segments = F.filter(F.transform(F.split(F.lower("path"), r"[/\\]"), lambda s: F.regexp_replace(s, r"\.[^.]+$", "")), lambda s: (F.length(s) > 2) & ~s.isin(*PLAIN_SEGMENTS))
    first = F.slice("added", 1, 100)
    modules = F.filter(F.transform(first, lambda x: F.lower(F.regexp_extract(F.trim(x), r"(?:import|require|from|using)\s+['\"]?([@\w/.-]+)['\"]?", 1))), lambda m: (F.length(m) > 2) & ~F.startswith(m, F.lit(".")))
    named = F.flatten(F.transform(first, lambda x: F.transform(F.regexp_extract_all(x, F.lit(rf"(?i)(?<![A-Za-z0-9_])({KEYWORDS})(?![A-Za-z0-9_])"), 1), lambda k: F.lower(k))))
    return file_rows.select("diff_id", F.explode(F.array_distinct(F.concat(segments, modules, named))).alias("keyword")).distinct()


def queries(diffs: DataFrame, file_rows: DataFrame, dependency_rows: DataFrame, keyword_rows: DataFrame) -> DataFrame:
    """(diff_id, query_id, text): up to three search texts per diff: a summary, its dependencies, its topics."""
    paths = file_rows.groupBy("diff_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("file_ord", "path"))).alias("ps"))
    names = dependency_rows.groupBy("diff_id").agg(F.array_sort(F.collect_set("name")).alias("deps"))
    topics = keyword_rows.groupBy("diff_id").agg(F.array_sort(F.collect_set("keyword")).alias("topics"))
    all_ = diffs.select("diff_id").distinct().join(paths, "diff_id", "left").join(names, "diff_id", "left").join(topics, "diff_id", "left")
    summary = F.concat(F.lit("Modified "), F.coalesce(F.col("n"), F.lit(0)), F.lit(" files: "), F.array_join(F.slice(F.coalesce(F.transform("ps", lambda x: x["path"]), F.array().cast("array<string>")), 1, 15), ", "), F.lit("."))
    texts = F.array(summary, F.concat(F.lit("Dependencies: "), F.array_join("deps", ", ")), F.concat(F.lit("Architecture topics: "), F.array_join(F.slice("topics", 1, 10), " ")))
    rows = all_.select("diff_id", F.posexplode(texts).alias("k", "text")).where("text IS NOT NULL")
    return rows.select("diff_id", F.concat_ws("#", "diff_id", "k").alias("query_id"), "text")


def align(hits: DataFrame, file_rows: DataFrame, dependency_rows: DataFrame, docs: DataFrame, k: int = 8) -> DataFrame:
    """Records that a changeset meets: (diff_id, doc_id, score, classification, files, terms).

    ``hits`` is (diff_id, doc_id, score, terms) of all its queries; a document keeps its
    best score and all its terms.  Files and dependencies are held against the texts of
    a diff's own k documents only, so no diff meets all documents.  Unknown statuses
    bind.  ``docs`` is (doc_id, status, text).
    """
    best = hits.groupBy("diff_id", "doc_id").agg(F.max("score").alias("score"), F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    ranked = best.withColumn("_r", F.row_number().over(W.partitionBy("diff_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("_r") <= k).drop("_r")
    matched = ranked.join(docs.select("doc_id", "status", F.lower("text").alias("low")), "doc_id")
    base = F.lower(F.element_at(F.split("path", r"[/\\]"), -1))
    stem = F.regexp_replace(base, r"\.[^.]+$", "")
    named = file_rows.select("diff_id", "path", base.alias("base"), stem.alias("stem"))
    governs = F.contains("low", F.lower("path")) | F.contains("low", F.col("base")) | ((F.length("stem") > 3) & F.contains("low", F.col("stem")))
    governed = matched.select("diff_id", "doc_id", "low").join(named, "diff_id").where(governs).groupBy("diff_id", "doc_id").agg(F.array_sort(F.collect_set("path")).alias("files"))
    used = matched.select("diff_id", "doc_id", "low").join(dependency_rows, "diff_id").where(F.contains("low", F.lower("name"))).groupBy("diff_id", "doc_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    empty = F.array().cast("array<string>")
    status = F.lower("status")
    kind = F.when(status.isin(*ADVISORY), "advisory").when(status.isin(*HISTORICAL), "historical").otherwise("binding")
    out = matched.join(governed, ["diff_id", "doc_id"], "left").join(used, ["diff_id", "doc_id"], "left")
    return out.select("diff_id", "doc_id", "score", kind.alias("classification"), F.coalesce("files", empty).alias("files"), F.array_distinct(F.concat("terms", F.coalesce("names", empty))).alias("terms"))


def noncompliant(aligned: DataFrame) -> DataFrame:
    """(diff_id, fails): whether any binding record is met."""
    return aligned.groupBy("diff_id").agg(F.max((F.col("classification") == "binding").cast("int")).cast("boolean").alias("fails"))
