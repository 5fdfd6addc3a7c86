"""Overlap of drafts with records: four similarities, shared entities, and a verdict per pair and draft."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import search, store


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the default rules; they suit one embedding model and are set anew for another."""

    title: tuple[float, float] = (0.78, 0.72)
    overall: tuple[float, float] = (0.75, 0.70)
    context: tuple[float, float] = (0.60, 0.55)
    decision: float = 0.55
    divergent: float = 0.52
    title_support: tuple[float, float, float] = (0.55, 0.40, 0.45)
    extension: float = 0.52
    admit: float = 0.5


PARTS = ("summary", "context", "decision")
#: Drafts of a group and documents of a bucket: what one task compares.
GROUP_DRAFTS, BUCKET_DOCUMENTS = 8192, 16_384


def _draft_rows(drafts: DataFrame) -> DataFrame:
    """(draft_id, summary, context, decision): vectors of each draft; a section that it lacks is its summary."""
    pivot = drafts.where(F.col("section_type").isin(*PARTS)).groupBy("draft_id").agg(*[F.max(F.when(F.col("section_type") == p, F.col("embedding"))).alias(p) for p in PARTS])
    return pivot.select("draft_id", *[F.coalesce(p, "summary").alias(p) for p in PARTS])


def _stack(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision of a list column, and which rows have a finite one; unlike lengths count as none."""
    column = column.combine_chunks()
    offsets, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    size = int(sizes[valid].max()) if valid.any() else 0
    ok = valid & (sizes == size) & (size > 0)
    out = np.zeros((len(column), max(1, size)))
    rows = np.flatnonzero(ok)
    if len(rows):
        out[rows] = column.values.to_numpy(zero_copy_only=False)[offsets[rows][:, None] + np.arange(size)]
    finite = np.isfinite(out).all(1)
    out[~finite] = 0
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1), ok & finite


_NEAR = "draft_id string, doc_id string, overall double, context double, decision double"


def similarities(drafts: DataFrame, chunks: DataFrame, admit: float = Thresholds.admit) -> DataFrame:
    """(draft_id, doc_id, overall, context, decision) of the pairs in which one of the three reaches ``admit``.

    ``drafts`` is (draft_id, section_type, embedding), ``chunks`` (chunk_id, doc_id,
    section_type, embedding).  Overall is the best of the draft's summary with any chunk;
    a document without a context or decision chunk is compared by its summary, a draft
    without that section by its own summary.  Missing similarities are 0.

    Groups of drafts meet buckets of documents, each pair of them in one task of bounded
    size; a document's chunks are reduced to three numbers before anything is returned.
    """
    asked = _draft_rows(drafts)
    n_groups = max(1, -(-asked.count() // GROUP_DRAFTS))
    n_buckets = max(1, -(-chunks.select("doc_id").distinct().count() // BUCKET_DOCUMENTS))
    group, bucket = (lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), (lambda n: F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(group("draft_id", n_groups).alias("g"), F.explode(bucket(n_buckets)).alias("b"), "draft_id", *PARTS)
    right = chunks.where(F.col("embedding").isNotNull()).select(F.explode(bucket(n_groups)).alias("g"), group("doc_id", n_buckets).alias("b"), "doc_id", "section_type", "embedding")

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.sort_by("doc_id").combine_chunks()
        x, usable = _stack(theirs["embedding"])
        theirs, x = theirs.filter(pa.array(usable)), x[usable]
        docs = theirs["doc_id"].combine_chunks().dictionary_encode() if len(theirs) else pa.array([], pa.string()).dictionary_encode()
        code, section = docs.indices.to_numpy(), np.array(theirs["section_type"].to_pylist(), object)
        names, n = docs.dictionary, len(docs.dictionary)
        vectors = [_stack(mine[p]) for p in PARTS]
        a, c, out = [], [], []
        step = max(1, 4_000_000 // max(1, len(x)))
        for lo in range(0, len(mine) if n else 0, step):
            best = []
            for part, (q, has) in zip(PARTS, vectors):
                q, has = q[lo : lo + step], has[lo : lo + step]
                if q.shape[1] != x.shape[1]:
                    best.append(np.zeros((len(q), n)))
                    continue
                s = np.clip(q @ x.T, -1, 1)
                value = np.full((len(q), n), -np.inf)
                for kind in (None,) if part == "summary" else ("summary", part):  # the section itself, where there is one, over the summary
                    rows = np.flatnonzero(section == kind) if kind else np.arange(len(x))
                    if len(rows):
                        first = np.flatnonzero(np.concatenate([[True], code[rows][1:] != code[rows][:-1]]))
                        value[:, code[rows][first]] = np.maximum.reduceat(s[:, rows], first, axis=1)
                best.append(np.where(has[:, None] & np.isfinite(value), value, 0.0))
            at, doc = np.nonzero(np.max(best, axis=0) >= admit - 1e-6)
            a.append(at + lo)
            c.append(doc)
            out.append(np.stack([v[at, doc] for v in best]))
        at, doc = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (a, c))
        values = np.concatenate(out, axis=1) if out else np.zeros((3, 0))
        return pa.table({"draft_id": mine["draft_id"].combine_chunks().take(pa.array(at)) if len(mine) else pa.array([], pa.string()), "doc_id": names.take(pa.array(doc)), **{k: pa.array(v) for k, v in zip(("overall", "context", "decision"), values)}}).cast(pa.schema([("draft_id", pa.string()), ("doc_id", pa.string()), *((k, pa.float64()) for k in ("overall", "context", "decision"))]))

    return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(run, _NEAR)


def pair_similarities(pairs: DataFrame, drafts: DataFrame, chunks: DataFrame) -> DataFrame:
    """As `similarities`, for given pairs (draft_id, doc_id), whatever their values."""
    asked = pairs.select("draft_id", "doc_id").distinct().join(_draft_rows(drafts), "draft_id")
    met = asked.join(chunks.select("doc_id", "section_type", "embedding"), "doc_id").withColumn("k", F.explode(F.array(*[F.lit(p) for p in PARTS])))
    vector = F.when(F.col("k") == "summary", F.col("summary")).when(F.col("k") == "context", F.col("context")).otherwise(F.col("decision"))
    fit = vector.isNotNull() & F.col("embedding").isNotNull() & (F.size(vector) == F.size("embedding"))
    value = F.when(fit, search.cosine(F.when(fit, vector), F.when(fit, F.col("embedding"))))
    scored = met.select("draft_id", "doc_id", "k", "section_type", value.alias("v"))
    of = lambda k, section=None: F.max(F.when((F.col("k") == k) & (F.col("section_type") == section if section else F.lit(True)), F.col("v")))
    out = scored.groupBy("draft_id", "doc_id").agg(of("summary").alias("overall"), *[F.coalesce(of(k, k), of(k, "summary")).alias(k) for k in PARTS[1:]])
    return out.fillna(0.0, ["overall", "context", "decision"])


def title_similarities(drafts: DataFrame, documents: DataFrame, make: Callable[[], store.EmbeddingProvider], least: float = Thresholds().title[1]) -> DataFrame:
    """(draft_id, doc_id, title): similarities of drafts' titles (draft_id, text) and documents' titles (doc_id, text).

    Only those of at least ``least``: a smaller one changes no verdict.
    """
    hashed = lambda df: df.withColumn("text_hash", F.sha2(F.trim("text"), 256))
    vectors = store.embed(drafts.select("text").unionByName(documents.select("text")), make)
    asked, against = (hashed(df).join(vectors, "text_hash").drop("text", "text_hash") for df in (drafts, documents))
    return search.dense_scores(asked, against, "draft_id", "doc_id", least=least).select(F.col("query_id").alias("draft_id"), F.col("chunk_id").alias("doc_id"), F.col("similarity").alias("title"))


def shared_words(drafts: DataFrame, documents: DataFrame, least: float = Thresholds.title[1]) -> DataFrame:
    """(draft_id, doc_id, title): as `title_similarities`, by the words that two titles share instead of by vectors.

    The cosine of the sets of lower-case words.  A pair of at least ``least`` shares one
    of its rarest words: with n words in a title, one of the first n - ceil(least^2 n) + 1
    by frequency.  Only these meet, each distinct title once.  Titles without a word
    have no similarity.
    """
    word_list = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1))
    both = drafts.select("text").unionByName(documents.select("text")).distinct().withColumn("words", word_list).where(F.size("words") > 0)
    counts = both.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    ranked = both.select("text", F.explode("words").alias("word")).join(counts, "word").groupBy("text").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("w"))
    prefix = F.slice("w", F.lit(1), F.size("w") - F.ceil(F.lit(least * least - 1e-9) * F.size("w")).cast("int") + 1)
    rare = ranked.select("text", F.transform("w", lambda x: x["word"]).alias("words"), F.explode(prefix).alias("p")).select("text", "words", F.col("p.word").alias("word"))
    mine = rare.join(drafts.select("text").distinct(), "text", "left_semi").select("word", F.col("text").alias("mine"), F.col("words").alias("a"))
    theirs = rare.join(documents.select("text").distinct(), "text", "left_semi").select("word", F.col("text").alias("theirs"), F.col("words").alias("b"))
    value = F.size(F.array_intersect("a", "b")) / F.sqrt(F.size("a") * F.size("b").cast("double"))
    met = mine.join(theirs, "word").select("mine", "theirs", value.alias("title")).where(F.col("title") >= least).distinct()
    return drafts.select("draft_id", F.col("text").alias("mine")).join(met, "mine").join(documents.select("doc_id", F.col("text").alias("theirs")), "theirs").select("draft_id", "doc_id", "title")


def with_evidence(near: DataFrame, titles: DataFrame, mine: DataFrame, theirs: DataFrame, drafts: DataFrame, chunks: DataFrame, admit: float = Thresholds().admit) -> DataFrame:
    """Adds ``title`` and ``shared`` to pairs that can be admitted; pairs that only the titles bring come along with their similarities.

    ``mine`` is (draft_id, entities), ``theirs`` (doc_id, entities); ``drafts`` and
    ``chunks`` are those of `similarities`.
    """
    only_titles = pair_similarities(titles.join(near, ["draft_id", "doc_id"], "left_anti"), drafts, chunks)
    pairs = near.unionByName(only_titles).join(titles, ["draft_id", "doc_id"], "left").fillna(0.0, ["title"])
    pairs = pairs.where((F.greatest("overall", "context", "decision") >= admit) | (F.col("title") > 0))
    pairs = pairs.join(mine.select("draft_id", F.col("entities").alias("_mine")), "draft_id", "left").join(theirs.select("doc_id", F.col("entities").alias("_theirs")), "doc_id", "left")
    shared = F.size(F.array_intersect(F.coalesce("_mine", F.array().cast("array<string>")), F.coalesce("_theirs", F.array().cast("array<string>"))))
    return pairs.select(*near.columns, "title", shared.alias("shared"))


def verdicts(pairs: DataFrame, rules: Thresholds = Thresholds()) -> DataFrame:
    """Adds ``verdict`` to pairs with overall, context, decision, title and shared (number of shared entities)."""
    shared = F.coalesce("shared", F.lit(0))
    o, c, d, t = (F.coalesce(x, F.lit(0.0)) for x in ("overall", "context", "decision", "title"))
    high_title = (t >= rules.title[0]) | ((t >= rules.title[1]) & (shared >= 1))
    high_overall = (o >= rules.overall[0]) | ((o >= rules.overall[1]) & (shared >= 2))
    high_context = (c >= rules.context[0]) | ((c >= rules.context[1]) & (shared >= 1))
    high_decision = d >= rules.decision
    so, sc, sd = rules.title_support
    duplicate = (high_title & ((o >= so) | (c >= sc) | (d >= sd))) | high_overall | (high_context & high_decision)
    verdict = (
        F.when(duplicate, "DUPLICATE_RISK")
        .when(high_context & (d < rules.divergent), "CONFLICT_RISK")
        .when((o >= rules.extension) | high_context | high_decision | high_title, "EXTENSION_CANDIDATE")
        .otherwise("NOVEL")
    )
    admitted = (o >= rules.admit) | (c >= rules.admit) | (d >= rules.admit) | high_title
    return pairs.withColumn("verdict", verdict).where(admitted)


def draft_verdicts(judged: DataFrame, k: int = 5) -> DataFrame:
    """(draft_id, verdict, confidence, matches): each draft's gravest verdict among its k closest documents."""
    top = search.top_k(judged, "draft_id", [F.desc("overall"), F.asc("doc_id")], k)
    grave = F.max(F.when(F.col("verdict") == "DUPLICATE_RISK", 3).when(F.col("verdict") == "CONFLICT_RISK", 2).when(F.col("verdict") == "EXTENSION_CANDIDATE", 1).otherwise(0))
    names = F.array(*[F.lit(v) for v in ("NOVEL", "EXTENSION_CANDIDATE", "CONFLICT_RISK", "DUPLICATE_RISK")])
    return top.groupBy("draft_id").agg(F.element_at(names, grave + 1).alias("verdict"), F.max("overall").alias("confidence"), F.count(F.lit(1)).alias("matches"))
