"""Dense, sparse and hybrid search for many queries at once, and ranking without a single task.

Result sets are cut to k per query by window ranks after a grid of score cells has
bounded how many rows a task sees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import round_half_up
from lodestone.session import salted_join

RRF_K = 60
SPARSE_WEIGHT = 0.30
#: Query vectors of a block: what is broadcast at once, whatever their number.
BLOCK = 4096
#: Cells of a score range; a task ranks one query's rows of one cell.
CELLS = 1024


def cosine(a: F.Column, b: F.Column) -> F.Column:
    """Cosine of two arrays in double precision, clamped to [-1, 1]; 0 for a zero norm, an error for unlike lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms))).otherwise(F.lit(0.0))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def row_number_by_cells(df: DataFrame, key: str, score: str, tie: str, low: float, high: float, out: str) -> DataFrame:
    """``row_number`` over (score descending, tie) per key, without gathering a key in one task.

    Rows are counted per cell of the score range first; a row's number is the count of
    the cells above it plus its number inside its cell.  Scores outside the range fall
    into its end cells.
    """
    width = (high - low) / CELLS
    cell = F.least(F.greatest(F.floor((F.col(score) - low) / width), F.lit(0)), F.lit(CELLS - 1)).cast("int")
    celled = df.withColumn("_cell", cell)
    counts = celled.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    above = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy(F.desc("_cell")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy(key, "_cell").orderBy(F.desc(score), tie))
    numbered = celled.withColumn("_in", inside).join(counts.select(key, "_cell", above.alias("_above")), [key, "_cell"])
    return numbered.withColumn(out, (F.col("_above") + F.col("_in")).cast("bigint")).drop("_cell", "_in", "_above")


def top_k(df: DataFrame, key: str, order: list[F.Column], k: int) -> DataFrame:
    """The first k rows per key.  Spark keeps k per key and task before the shuffle (window group limit)."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def dense_scores(queries: DataFrame, corpus: DataFrame, query: str = "query_id", key: str = "chunk_id", column: str = "embedding", least: float | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, chunk_id, similarity) of all queries against all rows, or those of at least ``least``.

    Queries go in blocks of at most ``BLOCK`` vectors, each broadcast to one pass over
    the corpus in which every Arrow batch is one matrix product.  ``carry`` names columns
    of the corpus that come along, which saves a join of all pairs.  Rows whose vector is
    null, of another length or not finite have no similarity; a zero vector has 0.
    """
    spark = corpus.sparkSession
    held = queries.where(F.col(column).isNotNull()).select(query, column)
    kinds = f"query_id {queries.schema[query].dataType.simpleString()}, chunk_id {corpus.schema[key].dataType.simpleString()}, similarity double"
    kinds += "".join(f", `{c}` {corpus.schema[c].dataType.simpleString()}" for c in carry)
    names_out = ["query_id", "chunk_id", "similarity", *carry]
    n = held.count()
    blocks = max(1, -(-n // BLOCK))
    out = None
    for block in range(blocks):
        part = held.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == block).toArrow().combine_chunks()
        ids, vectors = part[query].combine_chunks() if len(part) else pa.array([], part.schema.field(query).type), part[column].to_pylist()
        size = max(map(len, vectors), default=0)
        ok = [i for i, v in enumerate(vectors) if len(v) == size and size]
        held_block = spark.sparkContext.broadcast((ids.take(pa.array(ok, pa.int64())), _unit(np.array([vectors[i] for i in ok], np.float64).reshape(len(ok), size)), size))

        def run(batches: Iterator[pa.RecordBatch], held_block=held_block) -> Iterator[pa.RecordBatch]:
            names, q, size = held_block.value
            for b in batches:
                column_ = b.column(1)
                offsets = column_.offsets.to_numpy()
                rows = np.flatnonzero((np.diff(offsets) == size) & column_.is_valid().to_numpy(zero_copy_only=False))
                flat = column_.values.to_numpy(zero_copy_only=False)
                x = flat[offsets[rows][:, None] + np.arange(size)].astype(np.float64) if len(rows) and size else np.zeros((0, size))
                good = np.isfinite(x).all(1) if len(x) else np.zeros(0, bool)
                rows, x = rows[good], x[good]
                for lo in range(0, len(rows), 2048):
                    s = np.clip(q @ _unit(x[lo : lo + 2048]).T, -1, 1)
                    a, c = np.nonzero(s >= least) if least is not None else np.indices(s.shape).reshape(2, -1)
                    at = pa.array(rows[lo + c])
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), b.column(0).take(at), pa.array(s[a, c]), *(b.column(2 + i).take(at) for i in range(len(carry)))], names_out)

        found = corpus.select(key, column, *carry).mapInArrow(run, kinds)
        out = found if out is None else out.unionByName(found)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.where(norm > 0, x / np.where(norm > 0, norm, 1.0), 0.0)


def dense_search(scores: DataFrame, docs: DataFrame, k: int = 5, threshold: float = 0.35, statuses: list[str] | None = None) -> DataFrame:
    """Best chunk per document, then the k best documents per query.

    ``docs`` is (chunk_id, doc_id, status); chunks without a row there are dropped.
    """
    kept = docs if statuses is None else docs.where(F.lower("status").isin(statuses))
    hits = scores.where(F.col("similarity") >= threshold).join(kept, "chunk_id")
    best = hits.groupBy("query_id", "doc_id").agg(F.min_by(F.struct("chunk_id", "similarity"), F.struct(-F.col("similarity"), F.col("chunk_id"))).alias("b"))
    top = top_k(best.select("query_id", "doc_id", "b.chunk_id", "b.similarity"), "query_id", [F.desc("similarity"), F.asc("doc_id")], k)
    return top.withColumn("similarity", round_half_up(F.col("similarity"), 3))


def sparse_search(scores: DataFrame, docs: DataFrame, k: int = 5, threshold: float = 0.0, statuses: list[str] | None = None) -> DataFrame:
    """BM25 scores divided by the query's best, best chunk per document, k documents per query.

    The first 3k chunks are taken before the status filter, so fewer than k documents can remain.
    """
    first = top_k(scores, "query_id", [F.desc("score"), F.asc("chunk_id")], 3 * k)
    most = first.groupBy("query_id").agg(F.max("score").alias("most"))
    kept = docs if statuses is None else docs.where(F.lower("status").isin(statuses))
    hits = first.join(most, "query_id").withColumn("relative", F.col("score") / F.col("most")).where(F.col("relative") >= threshold).join(kept.select("chunk_id"), "chunk_id", "left_semi")
    best = hits.groupBy("query_id", "doc_id").agg(F.min_by(F.struct("chunk_id", "relative"), F.struct(-F.col("relative"), F.col("chunk_id"))).alias("b"))
    rows = best.select("query_id", "doc_id", "b.chunk_id", "b.relative")
    return top_k(rows, "query_id", [F.desc("relative"), F.asc("doc_id")], k).withColumn("relative", round_half_up(F.col("relative"), 3))


def hybrid_search(
    dense: DataFrame, sparse: DataFrame, docs: DataFrame, k: int = 5, threshold: float = 0.35, weight: float = SPARSE_WEIGHT, statuses: list[str] | None = None, most_sparse: float = 1000.0
) -> DataFrame:
    """Reciprocal rank fusion of dense and sparse ranks, with a blended score for the threshold.

    Dense ranks are among chunks that pass the status filter, sparse ranks among all.
    The blend is max(d, (1 - w) d + w s) for a positive cosine d, else s, where s is the
    BM25 score over the query's best.  Results are ordered by the fused ranks, so the
    shown blend need not fall from row to row.
    """
    kept = docs if statuses is None else docs.where(F.lower("status").isin(statuses))
    d = row_number_by_cells(dense.join(kept, "chunk_id").select("query_id", "chunk_id", "similarity"), "query_id", "similarity", "chunk_id", -1.0, 1.0, "dense_rank")
    peak = sparse.groupBy("query_id").agg(F.max("score").alias("most"))
    relative = salted_join(sparse.select("query_id", "chunk_id", "score"), peak, ["query_id"], on="chunk_id").withColumn("relative", F.col("score") / F.col("most"))
    s = row_number_by_cells(relative.select("query_id", "chunk_id", "relative"), "query_id", "relative", "chunk_id", 0.0, 1.0, "sparse_rank")
    both = d.join(s, ["query_id", "chunk_id"], "full").join(kept.select("chunk_id", "doc_id"), "chunk_id")
    return fused(both, k, threshold, weight)


def fused(both: DataFrame, k: int, threshold: float, weight: float) -> DataFrame:
    """The k best documents per query of (query_id, chunk_id, doc_id, similarity, dense_rank, relative, sparse_rank)."""
    similarity, rel = F.coalesce("similarity", F.lit(0.0)), F.coalesce("relative", F.lit(0.0))
    score = F.coalesce(1.0 / (RRF_K + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(1.0 / (RRF_K + F.col("sparse_rank")), F.lit(0.0))
    blend = F.when(similarity > 0, F.greatest(similarity, (1 - weight) * similarity + weight * rel)).otherwise(rel)
    scored = both.select("query_id", "chunk_id", "doc_id", score.alias("fused"), blend.alias("blended")).where(F.col("blended") >= threshold)
    best = scored.groupBy("query_id", "doc_id").agg(F.min_by(F.struct("chunk_id", "fused", "blended"), F.struct(-F.col("fused"), -F.col("blended"), F.col("chunk_id"))).alias("b"))
    rows = best.select("query_id", "doc_id", "b.chunk_id", "b.fused", "b.blended")
    return top_k(rows, "query_id", [F.desc("fused"), F.desc("blended"), F.asc("doc_id")], k)
