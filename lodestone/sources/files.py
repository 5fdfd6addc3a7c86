"""Reading Markdown records from directories, and records and indexes from JSON snapshots."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import records

# Directories that are not read, and where records are looked for by default.
PRUNED = ("node_modules", ".git", ".adr-cache", "dist", "legacy_adr", "legacy")
DEFAULT_DIRS = ("docs/adr", "docs/decisions", "adr", "decisions")


def scan(spark: SparkSession, directory: str) -> DataFrame:
    """(path, content, mtime) of all ``.md`` files below a directory, but for templates, readmes and pruned directories.

    A missing directory is an error.  Files are listed and read by the executors.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(directory)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(directory)
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    inside = F.substring_index("path", directory.rstrip("/"), -1)
    pruned = F.arrays_overlap(F.split(inside, "/"), F.array(*[F.lit(p) for p in PRUNED]))
    kept = raw.where(~pruned & ~base.startswith("template") & (base != "readme.md"))
    return kept.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), (F.unix_micros("modificationTime") / 1000.0).alias("mtime"))


def read_records(spark: SparkSession, directory: str, base_dir: str = "") -> DataFrame:
    """Parsed records of a directory, with their order by path as ``doc_ord``."""
    parsed = records.parse(scan(spark, directory), "path", "content", "mtime", base_dir)
    return parsed.withColumnRenamed("parsed_id", "id").withColumn("doc_ord", F.xxhash64("file_path"))


def discover_directories(configured: list[str] | None = None, root: str = ".", environ: dict | None = None) -> list[str]:
    """Configured directories, else those of ``ADR_DIRS``, else the defaults that exist."""
    if configured:
        return configured
    named = [p.strip() for p in (environ if environ is not None else os.environ).get("ADR_DIRS", "").split(",") if p.strip()]
    return named or [d for d in (os.path.join(root, p) for p in DEFAULT_DIRS) if os.path.isdir(d)]


SNAPSHOT_CHUNK = "chunkId string, docId string, sectionType string, text string, embedding array<float>"
SNAPSHOT_DOCUMENT = (
    "id string, filePath string, relativePath string, contentHash string, mtime double, "
    "metadata struct<id: string, title: string, status: string, date: string, deciders: array<string>, technicalStory: string, supersedes: array<string>, supersededBy: array<string>, "
    "extends: array<string>, amends: array<string>, dependsOn: array<string>, requiredBy: array<string>, category: string>, "
    "sections struct<context: string, decision: string, decisionDrivers: string, consideredOptions: string, consequences: string, diagrams: array<string>>, "
    "rawContent string, summaryText string, inlineReferences array<string>, entities array<string>"
)


def read_json_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of a JSON snapshot {version, createdAt, documents: {id: ...}, chunks: [...]}, for exchange with other tools."""
    whole = spark.read.schema(f"version string, createdAt string, documents map<string, struct<{_struct(SNAPSHOT_DOCUMENT)}>>, chunks array<struct<{_struct(SNAPSHOT_CHUNK)}>>").json(path, multiLine=True)
    return whole.select(F.explode(F.map_values("documents")).alias("d")).select("d.*"), whole.select(F.explode("chunks").alias("c")).select("c.*")


def _struct(ddl: str) -> str:
    """``a string, b struct<..>`` as the inside of a struct type."""
    out, depth, field = [], 0, ""
    for ch in ddl + ",":
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            name, kind = field.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            field = ""
        else:
            field += ch
    return ", ".join(out)


def load_config(start: str = ".", environ: dict | None = None) -> dict:
    """The first readable configuration from a directory up to the root, under the environment's settings.

    Broken files are passed over.  Names: ``.lodestone.json``, ``lodestone.config.json``.
    """
    env, here, found = environ if environ is not None else os.environ, os.path.abspath(start), {}
    while True:
        for name in (".lodestone.json", "lodestone.config.json"):
            try:
                with open(os.path.join(here, name), encoding="utf-8") as f:
                    found = json.load(f)
                break
            except (OSError, ValueError):
                continue
        if found or os.path.dirname(here) == here:
            break
        here = os.path.dirname(here)
    overlay = {"directories": env.get("ADR_DIRS"), "index_url": env.get("ADR_INDEX_URL"), "token": env.get("ADR_INDEX_TOKEN")}
    return found | {k: v for k, v in overlay.items() if v}
