"""A store of parsed records and chunks as Parquet tables: upsert, delete, incremental index, embedding memo."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



class EmbeddingProvider(Protocol):
    """Turns texts into vectors; made once per Python worker."""

    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of lower-case words, normalised: a stand-in where no model is at hand."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), self.dimensions), np.float32)
        for r, t in enumerate(texts):
            for w in re.findall(r"[a-z0-9]+", t.lower()):
                h = zlib.crc32(w.encode())
                out[r, h % self.dimensions] += 1.0 if h >> 16 & 1 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(norm > 0, out / np.where(norm > 0, norm, 1), out)


def embed(texts: DataFrame, make: Callable[[], EmbeddingProvider], column: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(text_hash, embedding) of texts that ``known`` has no vector for; equal texts are embedded once, blank ones not at all."""
    trimmed = texts.select(F.trim(column).alias("t")).where(F.length("t") > 0).select(F.sha2("t", 256).alias("text_hash"), "t").dropDuplicates(["text_hash"])
    fresh = trimmed if known is None else trimmed.join(known.select("text_hash"), "text_hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for pdf in batches:
            yield pd.DataFrame({"text_hash": pdf["text_hash"], "embedding": list(provider.embed(pdf["t"].tolist()))})

    return fresh.mapInPandas(run, "text_hash string, embedding array<float>")


class Store:
    """Versioned tables under a folder; the latest manifest names the versions that count, so neither a reader nor a crash ever meets half a write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> dict:
        """The manifest of the latest version; each is made whole by a rename, and none is ever replaced."""
        root = self._path(self.root)
        names = [f.getPath().getName() for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        versions = [n for n in names if n.startswith("manifest-") and n.endswith(".json")]
        if not versions:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/{max(versions)}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame | None:
        at = self._manifest().get(table)
        return self.spark.read.parquet(f"{self.root}/{at}") if at else None

    def write(self, **tables: DataFrame) -> None:
        """Write new versions and then switch to all of them at once; older versions stay for readers that hold them."""
        version = f"{time.time_ns():020d}"
        before = self._manifest()
        manifest = before | {"created_at": time.time()}
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{name}-{version}")
            manifest[name] = f"{name}-{version}"
        new = self._path(f"{self.root}/new-{version}.json")
        out = self._fs.create(new, False)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        self._fs.rename(new, self._path(f"{self.root}/manifest-{version}.json"))

    def vacuum(self) -> int:
        """Remove the versions of tables and manifests that the latest manifest doesn't name; returns how many."""
        held = self._manifest()
        keep = {v for v in held.values() if isinstance(v, str)}
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        latest = max((n for n in names if n.startswith("manifest-")), default="")
        stale = [n for n in names if n != latest and n not in keep and ("-" in n) and n.split("-")[-1].removesuffix(".json").isdigit()]
        for n in stale:
            self._fs.delete(self._path(f"{self.root}/{n}"), True)
        return len(stale)

    def upsert(self, table: str, rows: DataFrame, key: list[str]) -> None:
        """Replace the rows whose key occurs in ``rows``, add the others.  Of rows with one key all are kept: pass one each."""
        old = self.read(table)
        self.write(**{table: rows if old is None else old.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)})

    def delete(self, table: str, keys: DataFrame, key: list[str]) -> None:
        old = self.read(table)
        if old is not None:
            self.write(**{table: old.join(keys.select(*key).distinct(), key, "left_anti")})


def index(store: Store, records: DataFrame, chunks: Callable[[DataFrame], DataFrame], make: Callable[[], EmbeddingProvider], key: str = "id", force: bool = False) -> dict[str, int]:
    """Bring the store up to ``records``: parse results in, changed ones embedded, vanished ones removed.

    Unchanged means the same id and content hash.  Counts of what was done are returned.
    """
    old = store.read("documents")
    changed = records if force or old is None else records.join(old.select(key, "content_hash"), [key, "content_hash"], "left_anti")
    gone = old.join(records.select(key), key, "left_anti").select(key) if old is not None else None
    made = chunks(changed)
    known = store.read("embeddings")
    fresh = embed(made, make, known=known)
    memo = fresh if known is None else known.unionByName(fresh)
    store.write(embeddings=memo)
    vectors = store.read("embeddings")
    with_vectors = made.withColumn("text_hash", F.sha2(F.trim("text"), 256)).join(vectors, "text_hash", "left").drop("text_hash")
    stale = changed.select(F.col(key).alias("doc_id")) if gone is None else changed.select(F.col(key).alias("doc_id")).unionByName(gone.select(F.col(key).alias("doc_id")))
    old_chunks = store.read("chunks")
    kept = None if old is None else old.join(stale.select(F.col("doc_id").alias(key)), key, "left_anti")
    kept_chunks = None if old_chunks is None else old_chunks.join(stale, "doc_id", "left_anti")
    counts = {"total": records.count(), "indexed": changed.count(), "removed": gone.count() if gone is not None else 0}
    store.write(documents=changed if kept is None else kept.unionByName(changed, allowMissingColumns=True), chunks=with_vectors if kept_chunks is None else kept_chunks.unionByName(with_vectors, allowMissingColumns=True))
    return counts | {"skipped": counts["total"] - counts["indexed"], "chunks": store.read("chunks").count()}


def draft_text(title: str, context: str, decision: str) -> str:
    return f"ADR: {title}\nContext: {context}\nDecision: {decision}"


