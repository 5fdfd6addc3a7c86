"""Processing only new or changed records, and the work-item ledger behind it.

Two layers:

* **Record level** (`record_states`, `pending_records`): a pure DataFrame program
  that turns what earlier runs stored into ledger states and returns the records
  whose content is not covered by a done state.
* **Work-item level** (`WorkLedger`): the pending records are cut into hash buckets,
  and a bucket is what a worker leases.  States are pending, leased and done; an
  expired lease returns to pending; every lease takes a higher fencing token; a
  stale token can't commit; outputs go to the paths of their attempt, so a retry
  never doubles rows.  All that the ledger knows stands in the names and times of
  empty files, each made by one atomic create: no crash leaves half an entry.
  There is one per lease, never one per record.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["repo", "id"]


def normalized_hash(column: str) -> F.Column:
    """A content hash in lower case without blanks and algorithm prefix (``SHA256:AB..`` gives ``ab..``)."""
    return F.regexp_replace(F.lower(F.trim(F.col(column))), r"^[a-z0-9_-]+[:=]", "")


def current_records(parsed: DataFrame) -> DataFrame:
    """One row per record: its highest revision, as (repo, id, is_live, content_hash, mtime).

    The hash is computed before the shuffle, so texts never leave the scan.  A null
    hash is the SHA-256 of ``raw_content``; a row with neither has a null hash.  A
    null ``is_deleted`` is not live; a null revision is lower than any other.
    Copies of a revision are equal, so whichever wins is the same.
    """
    fingerprint = F.coalesce(normalized_hash("content_hash"), F.sha2(F.col("raw_content"), 256))
    newest = F.max(F.struct(F.col("revision"), (F.col("is_deleted") == F.lit(False)).alias("live"), fingerprint.alias("hash"), F.col("mtime")))
    return (
        parsed.groupBy(*KEY)
        .agg(newest.alias("c"))
        .select(*KEY, F.coalesce(F.col("c.live"), F.lit(False)).alias("is_live"), F.col("c.hash").alias("content_hash"), F.col("c.mtime").alias("mtime"))
    )


def record_states(index_state: DataFrame, index_runs: DataFrame) -> DataFrame:
    """Ledger view of what earlier runs stored: (repo, id, token, content_hash, state).

    The run is the fencing token.  Rows of a succeeded run are ``done``; those of a
    run that failed, was aborted or is unknown are leases that have run out, i.e.
    ``pending`` again, and say nothing about the record.  Of the done rows the one
    with the highest token decides (ties: latest ``indexed_at``, then the greater
    hash).  Repeated rows collapse.
    """
    runs = index_runs.groupBy("run_id").agg(F.max((F.lower(F.trim(F.col("status"))) == "succeeded").cast("int")).alias("ok"))
    rows = index_state.select(*KEY, F.col("run_id"), "indexed_at", normalized_hash("content_hash").alias("hash")).join(runs, "run_id", "left")
    done = F.max(F.when(F.col("ok") == 1, F.struct("run_id", "indexed_at", "hash"))).alias("d")
    return (
        rows.groupBy(*KEY)
        .agg(done)
        .select(*KEY, F.col("d.run_id").alias("token"), F.col("d.hash").alias("content_hash"), F.when(F.col("d").isNull(), "pending").otherwise("done").alias("state"))
    )


def pending_records(parsed: DataFrame, index_state: DataFrame, index_runs: DataFrame) -> DataFrame:
    """Live records the next run must process: (repo, id, content_hash, reason, prior_token).

    ``reason`` is ``new`` (no done state) or ``changed`` (its hash differs from the
    current one).  ``mtime`` takes no part.  Records with a null key match nothing
    earlier and come out as new.  Empty tables give an empty result or all live
    records.  Further columns of the inputs are ignored.
    """
    live = current_records(parsed).where("is_live").select(*KEY, "content_hash")
    done = record_states(index_state, index_runs).where("state = 'done'").select(*KEY, F.col("token").alias("prior_token"), F.col("content_hash").alias("done_hash"))
    both = live.join(done, KEY, "left")
    return both.where(F.col("prior_token").isNull() | ~F.col("content_hash").eqNullSafe(F.col("done_hash"))).select(
        *KEY, "content_hash", F.when(F.col("prior_token").isNull(), "new").otherwise("changed").alias("reason"), "prior_token"
    )


def removed_records(parsed: DataFrame, index_state: DataFrame, index_runs: DataFrame) -> DataFrame:
    """Records with a done state that are no longer live: what the next run must take out of the index."""
    live = current_records(parsed).where("is_live").select(*KEY)
    return record_states(index_state, index_runs).where("state = 'done'").select(*KEY, "token").join(live, KEY, "left_anti")


class StaleToken(RuntimeError):
    """A writer's lease was taken over by one with a higher fencing token."""


@dataclass(frozen=True)
class Lease:
    run: str
    bucket: int
    token: int
    owner: str
    expires_at: float


class WorkLedger:
    """Leases over the hash buckets of one run, kept as empty files in a shared folder.

    ``root/run=R/plan`` holds the pending records with their bucket.  The file
    ``leases/B-T`` is the lease of bucket B with token T; only one worker can create it,
    and it runs out ``ttl_s`` after its modification time, so all workers of a run use
    the same ``ttl_s``.  ``done/B-T-A`` says that attempt A of that lease has written all
    its output to ``output/attempt=A/bucket=B``.  Of several the highest token counts, of
    one token's the smallest attempt.  A reader takes only outputs that a done file
    names, so what a dead or late writer left is invisible, and nothing is skipped or
    repeated.  The store must create files exclusively, as HDFS and local disks do.
    """

    def __init__(self, spark: SparkSession, root: str, run: str, ttl_s: float = 3600.0, clock: Callable[[], float] = time.time):
        self.spark, self.base, self.run, self.ttl, self.clock = spark, f"{root.rstrip('/')}/run={run}", run, ttl_s, clock
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.base}/{name}"))

    def _files(self, folder: str) -> dict[str, float]:
        """Names in a folder with their modification times in seconds."""
        path = self._path(f"{self.base}/{folder}")
        return {f.getPath().getName(): f.getModificationTime() / 1000 for f in self._fs.listStatus(path)} if self._fs.exists(path) else {}

    def _create(self, name: str) -> bool:
        """Atomic create of an empty file; False if it is there already."""
        try:
            self._fs.create(self._path(f"{self.base}/{name}"), False).close()
        except Exception:  # noqa: BLE001 - whatever the store raises for an existing file
            if self._exists(name):
                return False
            raise
        return True

    def plan(self, pending: DataFrame, rows_per_bucket: int = 100_000) -> int:
        """Write the run's records once, bucketed by a hash of the key; a repeated call keeps the first plan.

        The records are found once: they are written as they come, counted, and cut into buckets.
        """
        if not self._exists("plan/_SUCCESS"):
            pending.write.mode("overwrite").parquet(f"{self.base}/pending")
            found = self.spark.read.schema(pending.schema).parquet(f"{self.base}/pending")
            n = max(1, -(-found.count() // rows_per_bucket))
            bucket = F.pmod(F.xxhash64(*KEY), F.lit(n)).cast("int")
            found.withColumn("bucket", bucket).repartition(n, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/plan")
            self._fs.delete(self._path(f"{self.base}/pending"), True)
        return len(self.buckets())

    def buckets(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self._files("plan") if n.startswith("bucket="))

    def _leases(self) -> dict[int, tuple[int, float]]:
        """Bucket to its latest token and when that runs out."""
        latest: dict[int, tuple[int, float]] = {}
        for name, at in self._files("leases").items():
            if not name.startswith("."):
                bucket, token = map(int, name.split("-"))
                latest[bucket] = max((token, at + self.ttl), latest.get(bucket, (0, 0.0)))
        return latest

    def _done(self) -> dict[int, tuple[int, str]]:
        """Bucket to the token and attempt that count."""
        best: dict[int, tuple[int, str]] = {}
        for name in sorted(self._files("done"), reverse=True):
            if not name.startswith("."):
                bucket, token, attempt = name.split("-")
                if int(token) >= best.get(int(bucket), (0, ""))[0]:
                    best[int(bucket)] = (int(token), attempt)
        return best

    def states(self) -> dict[int, str]:
        """Bucket to pending, leased or done at this moment: three listings, whatever the number of buckets."""
        done, leases, now = self._done(), self._leases(), self.clock()
        return {b: "done" if b in done else "leased" if leases.get(b, (0, 0.0))[1] > now else "pending" for b in self.buckets()}

    def lease(self, owner: str) -> Lease | None:
        """Take one pending bucket, or None.  The token is one above the bucket's last."""
        return next(iter(self.lease_some(owner, 1)), None)

    def lease_some(self, owner: str, most: int) -> list[Lease]:
        """Take up to ``most`` pending buckets; workers begin at different ones, so they seldom race for the same."""
        if most < 1:
            raise ValueError("most must be at least 1")
        latest, out = self._leases(), []
        free = [b for b, state in self.states().items() if state == "pending"]
        begin = sum(owner.encode()) % len(free) if free else 0
        for bucket in free[begin:] + free[:begin]:
            token = latest.get(bucket, (0, 0.0))[0] + 1
            if self._create(f"leases/{bucket}-{token}"):
                out.append(Lease(self.run, bucket, token, owner, self.clock() + self.ttl))
                if len(out) == most:
                    break
        return out

    def records(self, *leases: Lease) -> DataFrame:
        """The records of leased buckets, with their ``bucket``."""
        return self.spark.read.option("basePath", f"{self.base}/plan").parquet(*[f"{self.base}/plan/bucket={x.bucket}" for x in leases])

    def commit(self, leases: Lease | list[Lease], output: DataFrame) -> None:
        """Write the output of leases and mark their buckets done.

        ``output`` has the column ``bucket`` if there are several leases.  Buckets that
        were overtaken by a higher token aren't committed and raise :class:`StaleToken`
        after the others are.
        """
        held = [leases] if isinstance(leases, Lease) else list(leases)
        if all(self._stale(self._leases(), x) for x in held):
            raise StaleToken(f"buckets {[x.bucket for x in held]}: other tokens are later")
        attempt = uuid.uuid4().hex
        rows = output.withColumn("bucket", F.lit(held[0].bucket)) if len(held) == 1 else output
        rows.write.partitionBy("bucket").parquet(f"{self.base}/output/attempt={attempt}")
        latest, late = self._leases(), []
        for x in held:
            if self._stale(latest, x):
                late.append(x.bucket)
            else:
                self._create(f"done/{x.bucket}-{x.token}-{attempt}")
        if late:
            raise StaleToken(f"buckets {late} were overtaken while writing")

    @staticmethod
    def _stale(latest: dict[int, tuple[int, float]], lease: Lease) -> bool:
        return latest.get(lease.bucket, (0, 0.0))[0] != lease.token

    def results(self) -> DataFrame | None:
        """The committed outputs only."""
        paths = [f"{self.base}/output/attempt={a}/bucket={b}" for b, (_, a) in self._done().items()]
        paths = [p for p in paths if self._fs.exists(self._path(p))]  # a bucket whose output is empty has no folder
        return self.spark.read.option("basePath", f"{self.base}/output").parquet(*paths).drop("attempt", "bucket") if paths else None

    def finished(self) -> bool:
        return set(self.buckets()) <= set(self._done())


def run_pending(parsed: DataFrame, index_state: DataFrame, index_runs: DataFrame, root: str, run: str, process: Callable[[DataFrame], DataFrame] = lambda rows: rows, owner: str = "driver", at_once: int = 64) -> DataFrame:
    """Run ``process`` over the pending records through the ledger and return the committed output.

    A call that follows a crash goes on where the last one ended: buckets that are done
    stay so, those whose lease has run out are taken again.  Up to ``at_once`` buckets
    are processed as one job.  ``process`` keeps the column ``bucket``.
    """
    pending = pending_records(parsed, index_state, index_runs)
    ledger = WorkLedger(parsed.sparkSession, root, run)
    ledger.plan(pending)
    while leases := ledger.lease_some(owner, at_once):
        ledger.commit(leases, process(ledger.records(*leases)))
    if not ledger.finished():
        raise RuntimeError("some buckets are leased by other workers")
    out = ledger.results()
    return process(pending.limit(0).withColumn("bucket", F.lit(0))).drop("bucket") if out is None else out
