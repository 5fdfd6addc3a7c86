"""One object for a corpus of records: index, search, overlap, graph, vocabulary and changesets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import bm25, changeset, graph, overlap, records, search, store, vocabulary
from lodestone.session import materialize
from lodestone.sources import files, remote


class Corpus:
    """A store with its search index, vocabulary and graph; every method takes and returns DataFrames.

    ``make`` makes the embedding provider in each worker.  Records of a single
    repository get the repository name ``repo``.
    """

    def __init__(self, spark: SparkSession, root: str, make: Callable[[], store.EmbeddingProvider] = store.HashingEmbedder, repo: str = "local"):
        self.spark, self.store, self.make, self.repo = spark, store.Store(spark, root), make, repo
        self._index: bm25.Index | None = None

    def index_directory(self, directory: str, force: bool = False) -> dict[str, int]:
        """Parse a directory and bring the store up to it."""
        self._index = None
        return store.index(self.store, files.read_records(self.spark, directory), lambda r: records.chunks(r, "id"), self.make, force=force)

    def load_snapshot(self, url_or_path: str, cache_dir: str, token: str | None = None) -> bool:
        """Replace the store by a JSON snapshot; True if it came from the cache."""
        path, cached = remote.fetch_snapshot(url_or_path, cache_dir, token)
        docs, chunks = files.read_json_snapshot(self.spark, path)
        m, sec = "metadata", "sections"
        named = docs.select(
            "id", F.col("filePath").alias("file_path"), F.col("relativePath").alias("relative_path"), F.col("contentHash").alias("content_hash"), "mtime",
            F.struct(*[F.col(f"{m}.{a}").alias(b) for a, b in (("id", "id"), ("title", "title"), ("status", "status"), ("date", "date"), ("deciders", "deciders"), ("technicalStory", "technical_story"), ("supersedes", "supersedes"), ("supersededBy", "superseded_by"), ("extends", "extends"), ("amends", "amends"), ("dependsOn", "depends_on"), ("requiredBy", "required_by"), ("category", "category"))]).alias(m),
            F.struct(*[F.col(f"{sec}.{a}").alias(b) for a, b in (("context", "context"), ("decisionDrivers", "decision_drivers"), ("consideredOptions", "considered_options"), ("decision", "decision"), ("consequences", "consequences"), ("diagrams", "diagrams"))]).alias(sec),
            F.col("rawContent").alias("raw_content"), F.col("summaryText").alias("summary_text"), F.col("inlineReferences").alias("inline_references"), "entities", F.xxhash64("filePath").alias("doc_ord"),
        )
        self.store.write(documents=named, chunks=chunks.select(F.col("chunkId").alias("chunk_id"), F.col("docId").alias("doc_id"), F.col("sectionType").alias("section_type"), "text", "embedding"))
        self._index = None
        return cached

    @property
    def documents(self) -> DataFrame:
        held = self.store.read("documents")
        if held is None:
            raise LookupError("the store is empty: index a directory or load a snapshot first")
        return held

    @property
    def chunks(self) -> DataFrame:
        self.documents  # noqa: B018 - raises if there is no store yet
        return self.store.read("chunks")

    def lexical_index(self) -> bm25.Index:
        if self._index is None:
            self._index = bm25.stored(bm25.build(self.chunks, section="section_type"))
        return self._index

    def search(self, queries: DataFrame, k: int = 5, threshold: float = 0.35, mode: str = "hybrid", statuses: list[str] | None = None, section: str | None = None, weight: float = search.SPARSE_WEIGHT) -> DataFrame:
        """Search for many queries (query_id, text) at once; mode is dense, sparse or hybrid."""
        if mode not in ("dense", "sparse", "hybrid"):
            raise ValueError(f"unknown mode {mode}")
        corpus = self.chunks if section is None else self.chunks.where(F.col("section_type") == section)
        docs = corpus.select("chunk_id", "doc_id").join(self.documents.select(F.col("id").alias("doc_id"), records.status_word(F.col("metadata.status")).alias("status")), "doc_id")
        terms = bm25.query_terms(queries)
        if mode == "sparse":
            return search.sparse_search(bm25.score(self.lexical_index(), terms, section=section), docs, k, threshold, statuses)
        vectors = store.embed(queries, self.make)
        asked = queries.withColumn("text_hash", F.sha2(F.trim("text"), 256)).join(vectors, "text_hash")
        dense = search.dense_scores(asked, corpus)
        if mode == "dense":
            return search.dense_search(dense, docs, k, threshold, statuses)
        return search.hybrid_search(dense, bm25.score(self.lexical_index(), terms, section=section), docs, k, threshold, weight, statuses)

    def check_overlap(self, drafts: DataFrame, rules: overlap.Thresholds = overlap.Thresholds()) -> DataFrame:
        """Verdicts for drafts (draft_id, title, context, decision)."""
        parts = {"summary": F.concat(F.lit("ADR: "), "title", F.lit("\nContext: "), "context", F.lit("\nDecision: "), "decision"), "context": F.col("context"), "decision": F.col("decision")}
        long = drafts.select("draft_id", F.explode(F.array(*[F.struct(F.lit(k).alias("section_type"), F.coalesce(v, F.lit("")).alias("text")) for k, v in parts.items()])).alias("p")).select("draft_id", "p.*")
        vectors = store.embed(long, self.make)
        asked = long.withColumn("text_hash", F.sha2(F.trim("text"), 256)).join(vectors, "text_hash").select("draft_id", "section_type", "embedding")
        from lodestone.functions import text as T

        mine = drafts.select("draft_id", T.entities(F.concat_ws(" ", "title", "context", "decision")).alias("entities"))
        theirs = self.documents.select(F.col("id").alias("doc_id"), "entities")
        named = self.documents.select(F.col("id").alias("doc_id"), F.concat(F.lit("ADR "), "id", F.lit(": "), F.coalesce("metadata.title", F.lit(""))).alias("text"))
        named = named.join(self.chunks.select("doc_id").distinct(), "doc_id", "left_semi")
        titles = overlap.title_similarities(drafts.select("draft_id", F.when(F.trim("title") != "", F.concat(F.lit("ADR: "), "title")).otherwise(F.coalesce(parts["summary"], F.lit(""))).alias("text")), named, self.make, rules.title[1])
        near = overlap.similarities(asked, self.chunks, rules.admit)
        return overlap.verdicts(overlap.with_evidence(near, titles, mine, theirs, asked, self.chunks, rules.admit), rules)

    def get(self, id_or_path: str) -> DataFrame:
        return records.lookup(self.documents, id_or_path)

    def list(self, status: str | None = None) -> DataFrame:
        return records.catalog(self.documents, status)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of the stored records."""
        parsed = self.documents.withColumns({"repo": F.lit(self.repo), "revision": F.lit(1), "is_deleted": F.lit(False)})
        current = graph.current(parsed)
        return materialize(graph.nodes(current), "nodes"), materialize(graph.edges(current), "edges")

    def _starts(self, record_id: str) -> DataFrame:
        return self.spark.createDataFrame([(self.repo, record_id)], "repo string, id string")

    def lineage(self, record_id: str) -> DataFrame:
        return graph.lineage(self._starts(record_id), self.graph()[1])

    def impact(self, record_id: str) -> DataFrame:
        return graph.impact(self._starts(record_id), self.graph()[1])

    def dependencies(self, record_id: str) -> DataFrame:
        node, edge = self.graph()
        return graph.dependencies(self._starts(record_id), edge, node)

    def validate(self) -> DataFrame:
        node, edge = self.graph()
        return graph.issues(edge, node)

    def cycles(self) -> DataFrame:
        return graph.cycles(self.graph()[1])

    def mermaid(self) -> DataFrame:
        node, edge = self.graph()
        return graph.diagram(node, edge)

    def vocabulary(self) -> DataFrame:
        return vocabulary.harvest(self.documents, ["id"])

    def align(self, diffs: DataFrame, k: int = 8, threshold: float = 0.32) -> DataFrame:
        """Records that changesets (diff_id, diff) meet."""
        rows = materialize(changeset.files(diffs), "files")
        deps, keys = changeset.dependencies(rows), changeset.keywords(rows)
        asked = changeset.queries(diffs, rows, deps, keys)
        hits = self.search(asked, 10, threshold).join(asked.select("query_id", "diff_id"), "query_id")
        hits = hits.select("diff_id", "doc_id", F.col("blended").alias("score"), F.array().cast("array<string>").alias("terms"))
        docs = self.documents.select(F.col("id").alias("doc_id"), records.status_word(F.col("metadata.status")).alias("status"), F.concat_ws(" ", "metadata.title", "sections.context", "sections.decision").alias("text"))
        return changeset.align(hits, rows, deps, docs, k)
