"""Mixing sources to target weights by pivotal dependent rounding.

Every text of a source should be used ``f`` times, where ``f`` is the source's target
tokens over its tokens.  All texts get ``floor(f)`` copies; the fraction is rounded so
that the source's token total is kept: two texts with fractional probabilities move
token mass between each other, in a random direction, until one is 0 or 1.  Each
bucket of texts leaves at most one fractional text; those go up a tree of buckets
until one per source is left, which alone is rounded by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import tokens
from lodestone.session import materialize

#: Texts per bucket at the tree's lowest level, and buckets that one node of the next level takes.
LEAF_ROWS, FAN_IN = 50_000, 256
SEED = 20_240_601


def normal_source(column: str = "source") -> F.Column:
    """A source's name without regard to letter case, outer blanks and ``-`` for ``_``."""
    return F.regexp_replace(F.lower(F.trim(F.col(column))), r"[-\s]+", "_")


def sized_texts(documents: DataFrame, targets: DataFrame, vocabulary: str = tokens.DEFAULT_VOCABULARY) -> DataFrame:
    """Distinct usable texts of the target sources: (doc_id, source, n_tokens).

    Null, empty and blank texts are not used.  Equal texts count once, for the smallest
    doc_id (ties: the smaller source), whatever sources they came from, so none passes
    its cap by being copied.  Texts are compared by SHA-256, which is what is shuffled.
    """
    named = targets.select(F.col("source").alias("_s"), normal_source().alias("_n"))
    rows = documents.withColumn("_n", normal_source()).where(F.trim(F.regexp_replace("text", r"\s+", "")) != "")
    rows = rows.join(named, "_n").select("doc_id", F.col("_s").alias("source"), F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    sized = tokens.count_tokens(rows, ["doc_id", "source", "digest"], vocabulary)
    one = sized.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("r"))
    return one.select("r.*").where("n_tokens > 0")


def pivot(w: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Round ``p`` pairwise, keeping ``sum(w * p)``; at most one place stays fractional."""
    draw = np.random.default_rng(seed).random(len(p))
    p = p.copy()
    held: int | None = None
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if held is None:
            held = i
            continue
        a, b = held, i
        up = min((1 - p[a]) * w[a], p[b] * w[b])  # mass that can move from b to a
        down = min(p[a] * w[a], (1 - p[b]) * w[b])
        move = up if draw[i] * (up + down) < down else -down
        p[a] += move / w[a]
        p[b] -= move / w[b]
        for k in (a, b):
            if abs(p[k]) < 1e-9 or abs(p[k] - 1) < 1e-9:
                p[k] = round(p[k])
        held = a if 0.0 < p[a] < 1.0 else b if 0.0 < p[b] < 1.0 else None
    return p


_NODE = "source string, bucket int, doc_id bigint, n_tokens bigint, p double"


def _rounder(level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        # long texts first: what stays open at the end is short, and so is the error
        group = group.sort_values(["n_tokens", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        name = f"{SEED}|{level}|{group['source'].iat[0]}|{group['bucket'].iat[0]}"
        seed = int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big")
        group["p"] = pivot(group["n_tokens"].to_numpy(float), group["p"].to_numpy(float), seed)
        return group[["source", "bucket", "doc_id", "n_tokens", "p"]]

    return run


def round_copies(texts: DataFrame, n: int) -> DataFrame:
    """Round ``p`` of (source, doc_id, n_tokens, p) to 0 or 1 by a tree of buckets; ``n`` is its number of rows.

    A node takes at most about ``LEAF_ROWS`` texts or ``FAN_IN`` residues of any source, however
    large the source.  Seeds come from level, source and bucket, so retries repeat the result.
    """
    buckets = max(1, -(-n // LEAF_ROWS))
    level = 0
    nodes = texts.select("source", F.pmod(F.xxhash64("doc_id", "source"), F.lit(buckets)).cast("int").alias("bucket"), "doc_id", "n_tokens", "p")
    done: list[DataFrame] = []
    while True:
        rounded = materialize(nodes.groupBy("source", "bucket").applyInPandas(_rounder(level), _NODE), "mix")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(rounded.where(~open_))
        if buckets == 1:
            coin = F.pmod(F.xxhash64("source", "doc_id", F.lit(SEED)), F.lit(1_000_000_007)) / 1_000_000_007.0
            done.append(rounded.where(open_).withColumn("p", F.when(coin < F.col("p"), 1.0).otherwise(0.0)))
            break
        buckets = -(-buckets // FAN_IN)
        level += 1
        nodes = rounded.where(open_).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("int"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("source", "doc_id", "n_tokens", F.col("p").cast("int").alias("extra"))


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, vocabulary: str = tokens.DEFAULT_VOCABULARY) -> DataFrame:
    """The mixture: (doc_id, source, n_tokens, copies), copies at least 1 and at most the source's cap.

    Without ``total_tokens`` the mixture is the largest one in which no source passes its
    cap; a larger wish is lowered to that.  Targets with a null or non-positive share, and
    repeated target rows, are left out.  A source with a share but no text at all can't
    take part: the others keep their shares relative to each other.  Null caps are 1.
    """
    targets = targets.where("target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    texts = materialize(sized_texts(documents, targets, vocabulary), "sizes")
    totals = texts.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.count(F.lit(1)).alias("n"))
    plan = totals.join(targets, "source").collect()  # one row per source of the target table
    if not plan:
        return texts.select("doc_id", "source", "n_tokens", F.lit(0).alias("copies")).limit(0)
    shares = sum(r["target_share"] for r in plan)
    most = min(r["cap"] * r["have"] * shares / r["target_share"] for r in plan)
    total = min(most, total_tokens) if total_tokens else most
    rates = [(r["source"], min(float(r["cap"]), total * r["target_share"] / shares / r["have"])) for r in plan]
    f = F.create_map(*[x for s, v in rates for x in (F.lit(s), F.lit(v))])[F.col("source")]
    wanted = texts.withColumn("f", f).withColumn("base", F.floor("f").cast("int")).withColumn("p", F.col("f") - F.floor("f"))
    # a rate that is whole but for rounding errors is whole
    p = F.when(F.col("p") < 1e-9, 0.0).when(F.col("p") > 1 - 1e-9, 1.0).otherwise(F.col("p"))
    wanted = wanted.select("source", "doc_id", "n_tokens", "base", p.alias("p"))
    rounded = round_copies(wanted, sum(r["n"] for r in plan))
    base = F.create_map(*[x for s, v in rates for x in (F.lit(s), F.lit(int(np.floor(v))))])[F.col("source")]
    return rounded.select("doc_id", "source", "n_tokens", (base + F.col("extra")).cast("int").alias("copies")).where("copies > 0")


def mixture_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target and actual share, tokens, texts used, and the greatest number of copies."""
    by = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("copies").alias("most_copies"))
    total = by.agg(F.sum("tokens").alias("total"))
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share")
    return wanted.join(by, "source", "left").crossJoin(total).select("source", "target_share", share, "max_repeats", zero("most_copies"), zero("texts"), zero("tokens"))
