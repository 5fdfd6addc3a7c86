"""References to records that do not exist: missing, deleted or late targets.

Targets are judged once per distinct (repo, target) key, so a key that a third of
all references name costs one row in that join.  Its verdict then goes back to the
references in two ways: the most-named keys (at most ``HEAVY_KEYS`` of them, hence
a fixed size) by broadcast, all others by a shuffle join on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys are broadcast; a row of them is under 200 bytes.
HEAVY_KEYS = 1000
#: References of one key from which it counts as heavy.
HEAVY_AT = 5000
FIELDS = ("depends_on", "superseded_by", "required_by")


def padded_number(value: F.Column) -> F.Column:
    """The first number in a text, without needless zeros, padded to at least four digits; null without digits."""
    digits = F.regexp_replace(F.regexp_extract(value, r"([0-9]+)", 1), r"^0+(?=[0-9])", "")
    return F.when(digits == "", None).when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0"))


def record_arrivals(parsed: DataFrame) -> DataFrame:
    """One row per record and number: whether it is live, when it first arrived, its current lists.

    Columns: repo, id, number, is_live, first_seen (earliest ``ingested_at`` of any
    row), current_seen (earliest of the highest revision's rows), the three lists.
    A null ``ingested_at`` counts only if no other is known.
    """
    seen = F.col("ingested_at").cast("timestamp")
    earliest_first = -F.unix_micros(seen)
    lists = [F.col(f"metadata.{f}").alias(f) for f in FIELDS]
    newest = F.max(F.struct("revision", earliest_first.alias("age"), (F.col("is_deleted") == F.lit(False)).alias("live"), *lists)).alias("c")
    return (
        parsed.groupBy("repo", "id")
        .agg(newest, F.min(seen).alias("first_seen"))
        .select(
            "repo", "id", padded_number(F.col("id")).alias("number"), F.coalesce(F.col("c.live"), F.lit(False)).alias("is_live"),
            "first_seen", F.timestamp_micros(-F.col("c.age")).alias("current_seen"), *[F.col(f"c.{f}").alias(f) for f in FIELDS],
        )
    )


def references(records: DataFrame) -> DataFrame:
    """Distinct references of live records: (repo, id, field, target_id, period, current_seen).

    Values without digits and nulls are no references.  A record has one row here,
    so repeats are removed inside its own lists and no shuffle is needed.
    """
    named = [F.struct(F.lit(f).alias("field"), F.array_distinct(F.filter(F.transform(F.col(f), padded_number), lambda v: v.isNotNull())).alias("targets")) for f in FIELDS]
    return (
        records.where("is_live")
        .select("repo", "id", "current_seen", F.explode(F.array(*named)).alias("n"))
        .select("repo", "id", "current_seen", F.date_format("current_seen", "yyyy-MM").alias("period"), F.col("n.field").alias("field"), F.explode("n.targets").alias("target_id"))
    )


def judged_references(parsed: DataFrame) -> DataFrame:
    """Every reference with its kind: ``missing``, ``deleted``, ``late`` or ``ok``.

    Missing: the repo has no row of that number.  Deleted: it has, but no live one.
    Late: the target's first row arrived after the first row of the source's
    current revision.  Null times are never late.  A record without a repo belongs
    to the repo null.  Empty input gives an empty result; extra columns are ignored.
    """
    records = record_arrivals(parsed)
    refs = references(records)
    key = [F.coalesce("repo", F.lit("\u0000")).alias("_repo"), "target_id"]
    named = refs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    known = (
        records.where(F.col("number").isNotNull())
        .groupBy(F.coalesce("repo", F.lit("\u0000")).alias("_repo"), F.col("number").alias("target_id"))
        .agg(F.max(F.col("is_live").cast("int")).alias("live"), F.min("first_seen").alias("target_seen"))
    )
    verdicts = named.join(known, ["_repo", "target_id"], "left")
    heavy = verdicts.where(F.col("n") >= HEAVY_AT).orderBy(F.desc("n"), "_repo", "target_id").limit(HEAVY_KEYS)
    keyed = refs.withColumn("_repo", F.coalesce("repo", F.lit("\u0000")))
    by_broadcast = keyed.join(F.broadcast(heavy), ["_repo", "target_id"])
    light = keyed.join(F.broadcast(heavy.select("_repo", "target_id")), ["_repo", "target_id"], "left_anti")
    by_shuffle = light.join(verdicts, ["_repo", "target_id"])
    kind = F.when(F.col("live").isNull(), "missing").when(F.col("live") == 0, "deleted").when(F.col("target_seen") > F.col("current_seen"), "late").otherwise("ok")
    return by_broadcast.unionByName(by_shuffle).select("repo", "id", "field", "target_id", kind.alias("kind"), "period")


def orphan_references(parsed: DataFrame) -> DataFrame:
    """The references that are missing, deleted or late: (repo, id, field, target_id, kind, period)."""
    return judged_references(parsed).where("kind <> 'ok'")


def orphan_report(parsed: DataFrame) -> DataFrame:
    """Counts per field and month of the source's ``ingested_at``: references, missing, deleted, late."""
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k)
    return judged_references(parsed).groupBy("field", "period").agg(F.count(F.lit(1)).alias("n_references"), count("missing"), count("deleted"), count("late"))
