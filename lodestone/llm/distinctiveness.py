"""How distinctive a term is per record: graph-of-words weight times collection rarity.

Per chunk the terms form a graph: two terms are joined if they stand within
``WINDOW`` tokens of each other.  A term's weight is its number of distinct
neighbours, damped by the chunk's length; rarity is ``ln((N + 1) / df)`` over the
counting entries of all chunks.  Document frequencies need no Python; the graph is
built in Arrow batches with array operations, never per token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import hot_key_join, materialize

#: Tokens within a window are neighbours of each other.
WINDOW = 4
#: Entries that a task of the joins by chunk holds, about.
TASK_ROWS = 10_000
#: Length damping of the weight (TW-IDF uses a small value, as degrees grow slowly).
SLOPE = 0.003


def counting_entries(entries: DataFrame) -> DataFrame:
    """The entry that counts for each chunk: the one indexed last, as (chunk_id, terms, tfs).

    Ties go to the greater tokenizer version and token length.  Terms are lower-cased
    and their counts added; null counts are 0.  A null map has no terms; a chunk whose
    last entry is null gives none.  Null chunk ids are dropped: no record to score for.
    """
    order = F.struct("indexed_at", "tokenizer_version", "token_length")
    last = entries.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.max_by("term_counts", order).alias("m"))
    lower = F.transform(F.map_entries("m"), lambda e: F.struct(F.lower(e["key"]).alias("k"), F.coalesce(e["value"], F.lit(0)).cast("bigint").alias("v")))
    terms = F.array_distinct(F.transform(F.col("e"), lambda x: x["k"]))
    summed = F.transform(F.col("terms"), lambda t: F.aggregate(F.filter("e", lambda x: x["k"] == t), F.lit(0).cast("bigint"), lambda a, x: a + x["v"]))
    plain = F.transform(F.col("e"), lambda x: x["v"])
    return (
        last.where(F.col("m").isNotNull())
        .select("chunk_id", lower.alias("e"))
        .select("chunk_id", "e", terms.alias("terms"))
        .select("chunk_id", "terms", F.when(F.size("terms") == F.size("e"), plain).otherwise(summed).alias("tfs"))
    )


def document_frequencies(counted: DataFrame) -> DataFrame:
    """(term, df): in how many chunks a term occurs; partial sums before the shuffle."""
    return counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def window_degrees(texts: pa.Array, terms: pa.ListArray, window: int = WINDOW) -> pa.ListArray:
    """Distinct neighbours of each term in its chunk's text, in the order of ``terms``.

    Tokens are runs of ``[a-z0-9_-]`` of the lower-cased text that are terms of the
    chunk.  Without any such token (no text) the terms in their stored order are the
    sequence.  A term without neighbours has degree 1, so that it keeps a weight.
    """
    n = len(terms)
    offsets = terms.offsets.to_numpy().astype(np.int64)
    term_row = np.repeat(np.arange(n), np.diff(offsets))
    flat_terms = terms.values.slice(offsets[0], offsets[-1] - offsets[0])
    words = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), r"[^a-z0-9_-]+")
    word_row = pc.list_parent_indices(words).to_numpy()
    tokens = pc.ascii_trim(pc.list_flatten(words), "-_")
    both = pa.concat_arrays([flat_terms.cast(pa.string()), tokens.cast(pa.string())]).dictionary_encode()
    codes = both.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    v = len(both.dictionary) + 1
    term_key = term_row * v + codes[: len(flat_terms)]
    order = np.argsort(term_key, kind="stable")
    sorted_key = term_key[order]
    token_key = word_row * v + codes[len(flat_terms) :]
    at = np.searchsorted(sorted_key, token_key)
    hit = (at < len(sorted_key)) & (sorted_key[np.minimum(at, len(sorted_key) - 1)] == token_key) if len(sorted_key) else np.zeros(len(token_key), bool)
    nodes, rows = order[at[hit]] if hit.any() else np.zeros(0, np.int64), word_row[hit]
    bare = np.ones(n, bool)
    bare[rows] = False
    if bare.any():
        own = np.flatnonzero(bare[term_row])
        nodes, rows = np.concatenate([nodes, own]), np.concatenate([rows, term_row[own]])
    size = max(1, len(term_key))
    edges = [np.zeros(0, np.int64)]
    for gap in range(1, window):
        a, b, same = nodes[:-gap], nodes[gap:], rows[:-gap] == rows[gap:]
        same &= a != b
        a, b = a[same], b[same]
        edges.append(np.minimum(a, b) * size + np.maximum(a, b))
    edge = np.unique(np.concatenate(edges))
    degree = np.bincount(edge // size, minlength=len(term_key)) + np.bincount(edge % size, minlength=len(term_key))
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(np.maximum(degree[: len(term_key)], 1).astype(np.int32)))


def _with_degrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        terms = b.column("terms")
        yield pa.RecordBatch.from_arrays([b.column("chunk_id"), terms, b.column("tfs"), window_degrees(b.column("text"), terms)], ["chunk_id", "terms", "tfs", "degrees"])


def score_terms(entries: DataFrame, chunks: DataFrame, min_tf: int = 0, df_range: tuple[int, int] | None = None) -> DataFrame:
    """Every term of every chunk: (chunk_id, term, tf, degree, df, score).

    With ``min_tf`` and ``df_range`` only the terms counted so often in the chunk and
    found in so many chunks; they have the same scores, but what can't be among them is
    left out before graphs are built and before anything is joined.

    Texts come from ``chunks`` (repeated rows collapse).  A chunk without a row there
    uses the stored order of its terms.  Empty maps give no rows; empty tables an
    empty result; other columns of the inputs are ignored.
    """
    # tasks by the number of rows, not by the session's setting: a task's share doesn't grow with the table
    tasks = max(entries.sparkSession.sparkContext.defaultParallelism, -(-entries.count() // TASK_ROWS))
    counted = materialize(counting_entries(entries.repartition(tasks, "chunk_id")).withColumn("most", F.array_max("tfs")), "counted")  # read for frequencies, totals and graphs
    texts = chunks.where(F.col("chunk_id").isNotNull()).select("chunk_id", "text").repartition(tasks, "chunk_id").groupBy("chunk_id").agg(F.max("text").alias("text"))
    wanted = counted.where(F.col("most") >= min_tf) if min_tf else counted
    graph = wanted.select("chunk_id", "terms", "tfs").repartition(tasks, "chunk_id").join(texts, "chunk_id", "left").mapInArrow(_with_degrees, "chunk_id string, terms array<string>, tfs array<bigint>, degrees array<int>")
    df = document_frequencies(counted)
    totals = counted.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("avg_len"))
    long = graph.select("chunk_id", F.size("terms").alias("len"), F.explode(F.arrays_zip("terms", "tfs", "degrees")).alias("t"))
    rows = long.select("chunk_id", "len", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"), F.col("t.degrees").alias("degree")).where(F.col("tf") >= min_tf)
    weight = F.col("degree") / (1 - SLOPE + SLOPE * F.col("len") / F.col("avg_len"))
    rare = df if df_range is None else df.where(F.col("df").between(*df_range))
    # terms of few chunks can't be hot
    joined = rows.join(rare, "term") if df_range and df_range[1] <= 1000 else hot_key_join(rows, rare, "term", "df", "chunk_id")
    return (
        joined.crossJoin(totals)  # one row
        .select("chunk_id", "term", "tf", "degree", "df", (weight * F.log((F.col("n") + 1) / F.col("df"))).alias("score"))
    )


def distinctive_terms(entries: DataFrame, chunks: DataFrame, min_tf: int = 4, min_df: int = 2, max_df: int = 6) -> DataFrame:
    """Terms frequent in their chunk and in only a few chunks of the collection, with their scores."""
    return score_terms(entries, chunks, min_tf, (min_df, max_df))


def vocabulary_spread(terms: DataFrame) -> DataFrame:
    """How widely each harvested term is spread: (term, n_shards, doc_count, rarity).

    Terms are trimmed and lower-cased.  Of a shard's rows for a term the one harvested
    last counts (ties: the greater count); null counts are 0.  ``rarity`` is
    ``ln(1 + S / s)`` of S shards in all and s with a positive count, null where no
    shard has one.  Null or blank terms are dropped.
    """
    term = F.lower(F.trim("term"))
    last = (
        terms.where(F.trim("term") != "")
        .groupBy("shard_id", term.alias("term"))
        .agg(F.max_by(F.coalesce("doc_count", F.lit(0)), F.struct("harvested_at", F.coalesce("doc_count", F.lit(0)))).alias("n"))
    )
    shards = terms.agg(F.countDistinct("shard_id").alias("shards"))
    with_count = F.count(F.when(F.col("n") > 0, 1))
    return (
        last.groupBy("term")
        .agg(with_count.alias("n_shards"), F.sum("n").alias("doc_count"))
        .crossJoin(shards)  # one row
        .select("term", "n_shards", "doc_count", F.when(F.col("n_shards") > 0, F.round(F.log(1 + F.col("shards") / F.col("n_shards")), 6)).alias("rarity"))
    )
