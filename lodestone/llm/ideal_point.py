"""One ranking from several differently-scaled scores: ideal-point ranking per query.

Scores are winsorised at per-query quantiles, divided by their vector norm, and
weighted; a candidate's closeness is its distance to the worst point over the sum
of its distances to the best and the worst.  No step gathers a query's candidates
in one task: quantiles, norms and extremes are aggregates with partial sums, they
come back by a salted join, and ranks are cumulative counts over a fixed grid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.session import materialize, salted_join, spread

SCORES = ("dense_score", "sparse_score", "blended_score")
#: Quantiles at which scores are winsorised, and the accuracy of their estimate.
TAILS = (0.01, 0.99)
ACCURACY = 10_000
#: Cells of the closeness grid that ranks are counted over.
GRID = 4096


def distinct_candidates(evaluations: DataFrame, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """One row per (query_id, chunk_id); repeated rows have equal scores, of unequal ones the greatest counts.

    NaN is taken for null.  Rows without a query or chunk are dropped: nothing to rank.
    """
    clean = [F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double")).alias(s) for s in scores]
    keyed = evaluations.where(F.col("query_id").isNotNull() & F.col("chunk_id").isNotNull()).select("query_id", "chunk_id", *clean)
    return keyed.groupBy("query_id", "chunk_id").agg(*[F.max(s).alias(s) for s in scores])


def closeness(candidates: DataFrame, weights: dict[str, float] | None = None, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """``candidates`` with their closeness in [0, 1], higher is better.

    A null score counts as the lower winsor bound of its query, a score that is null
    throughout as 0.  Where best and worst point coincide (one candidate, or all
    equal) closeness is 0.5.  It has nine digits, so that ranks don't depend on the order
    in which sums were made.  Infinite scores end at the winsor bounds, or at the
    greatest double where the bound itself is infinite.
    """
    weights = weights or {s: 1.0 / len(scores) for s in scores}
    top = 1e150
    finite = {s: F.least(F.greatest(F.col(s), F.lit(-top)), F.lit(top)) for s in scores}
    bounds = candidates.groupBy("query_id").agg(*[F.percentile_approx(finite[s], list(TAILS), ACCURACY).alias(f"q_{s}") for s in scores])
    low = lambda s: F.coalesce(F.col(f"q_{s}")[0], F.lit(0.0))
    high = lambda s: F.coalesce(F.col(f"q_{s}")[1], F.lit(0.0))
    clipped = [F.least(F.greatest(F.coalesce(finite[s], low(s)), low(s)), high(s)).alias(f"x_{s}") for s in scores]
    wins = salted_join(candidates, bounds, ["query_id"], on="chunk_id").select("query_id", "chunk_id", *scores, *clipped)
    peaks = wins.groupBy("query_id").agg(
        *[F.max(F.abs(f"x_{s}")).alias(f"p_{s}") for s in scores],
        *[F.min(f"x_{s}").alias(f"lo_{s}") for s in scores],
        *[F.max(f"x_{s}").alias(f"hi_{s}") for s in scores],
        *[F.sum(F.col(f"x_{s}") * F.col(f"x_{s}")).alias(f"ss_{s}") for s in scores],
    )
    norm = lambda s: F.when(F.col(f"ss_{s}") > 0, F.sqrt(f"ss_{s}")).otherwise(F.lit(1.0))
    scaled = lambda c, s: F.col(c) / norm(s) * weights[s]
    to = lambda edge: F.sqrt(sum((F.pow(scaled(f"x_{s}", s) - scaled(f"{edge}_{s}", s), 2) for s in scores), F.lit(0.0)))
    near, far = to("hi"), to("lo")
    value = F.when(near + far > 0, far / (near + far)).otherwise(F.lit(0.5))
    return salted_join(wins, peaks, ["query_id"], on="chunk_id").select("query_id", "chunk_id", *scores, F.round(value, 9).alias("closeness"))


def rank(scored: DataFrame) -> DataFrame:
    """Adds ``rank``: 1 plus the number of the query's candidates that are strictly closer; ties share it.

    Candidates are first counted per distinct value; those counts are summed over the
    grid's cells and, inside a cell, over its values.
    """
    cell = F.floor(F.col("closeness") * GRID).cast("int")
    counts = scored.groupBy("query_id", "closeness").agg(F.count(F.lit(1)).alias("n")).withColumn("cell", cell)
    cells = counts.groupBy("query_id", "cell").agg(F.sum("n").alias("cell_n"))
    above = F.coalesce(F.sum("cell_n").over(W.partitionBy("query_id").orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("query_id", "cell").orderBy(F.desc("closeness")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("inside", inside).join(cells.select("query_id", "cell", above.alias("above")), ["query_id", "cell"])
    values = ranks.select("query_id", "closeness", (F.col("above") + F.col("inside") + 1).alias("rank"))
    return scored.join(values, ["query_id", "closeness"]).select(*scored.columns, "rank")


def ideal_point_ranking(evaluations: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Every candidate of every query: (query_id, chunk_id, the scores, closeness, rank)."""
    return rank(closeness(distinct_candidates(evaluations), weights))


def _beats(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``a`` is strictly higher than ``b`` in at least two scores; null is lower than any value."""
    return (np.nan_to_num(a, nan=-np.inf, neginf=-1.7e308) > np.nan_to_num(b, nan=-np.inf, neginf=-1.7e308)).sum(axis=-1) >= 2


def _survivor(x: np.ndarray) -> int:
    """Fold in the given order: who doesn't beat the next candidate gives way to it."""
    held, i = 0, 1
    while i < len(x):
        lost = ~_beats(x[held], x[i:])
        if not lost.any():
            break
        held = i + int(lost.argmax())
        i = held + 1
    return held


_OUT = "query_id bigint, chunk_id string, closeness double, dense_score double, sparse_score double, blended_score double"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """At most one candidate per query and partition that may still beat all others."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        both = (pdf if held is None else pd.concat([held, pdf])).sort_values(["query_id", "closeness", "chunk_id"], ascending=[True, False, True], kind="stable", ignore_index=True)
        if not len(both):
            continue
        x, query = both[list(SCORES)].to_numpy(float), both["query_id"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        ends = np.append(first[1:], len(both))
        keep = [lo + _survivor(x[lo:hi]) for lo, hi in zip(first, ends)]
        held = both.iloc[keep]
    if held is not None:
        yield held[["query_id", "chunk_id", "closeness", *SCORES]]


def undisputed(ranked: DataFrame) -> DataFrame:
    """The candidate of each query that beats every other in at least two of three scores, if there is one.

    Every partition folds its part of the ranking to one survivor per query, best
    closeness first; the few survivors of a query are folded again; one pass over the
    ranking then checks each survivor exactly.  Nobody who beats all others can be
    lost in a fold, so the result doesn't depend on the partitioning.
    """
    part = materialize(ranked.select("query_id", "chunk_id", "closeness", *SCORES), "ranking")  # ranked once, read by the fold and by the check
    tasks = max(8, part.sparkSession.sparkContext.defaultParallelism)
    last = spread(part).mapInPandas(_fold, _OUT).repartition(tasks, "query_id").mapInPandas(_fold, _OUT)
    rival = last.select("query_id", F.col("chunk_id").alias("best"), *[F.col(s).alias(f"b_{s}") for s in SCORES])
    higher = lambda s: F.when(F.col(f"b_{s}").isNotNull() & (F.col(s).isNull() | (F.col(f"b_{s}") > F.col(s))), 1).otherwise(0)
    won = (F.col("chunk_id") == F.col("best")) | (sum((higher(s) for s in SCORES), F.lit(0)) >= 2)
    checked = salted_join(part, rival, ["query_id"], how="inner", on="chunk_id")
    return checked.groupBy("query_id", "best").agg(F.min(won.cast("int")).alias("ok")).where("ok = 1").select("query_id", F.col("best").alias("chunk_id"))
