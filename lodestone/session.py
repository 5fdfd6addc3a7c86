"""Session defaults, shared scratch space and skew-aware join helpers.

Everything that cuts lineage goes through :func:`materialize`: a Parquet table in
the shared folder that the session names in ``spark.checkpoint.dir``.  Unlike a
local checkpoint it outlives the executors that wrote it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` overrides single settings (dots as ``__``)."""
    builder = SparkSession.builder.master(master).appName("lodestone")
    builder = builder.config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**DEFAULT_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is ``spark.checkpoint.dir`` of the session.  Only a ``local`` master may go
    without: there a temporary folder is made and set as the checkpoint folder.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{scratch_root(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salts: int = 32, on: str | None = None) -> DataFrame:
    """Join a table of few rows per key to one where a key may hold a third of all rows.

    ``small`` must be unique per key.  It is repeated ``salts`` times and ``big`` is
    spread over the salts by a hash of ``on`` (default: all its columns), so no task
    gets more than about a ``salts``-th of a hot key.  Neither side is broadcast by
    hint; adaptive execution may still choose it from the measured size.
    """
    by = [F.col(on)] if on else [F.col(f"`{c}`") for c, kind in big.dtypes if not kind.startswith("map")]
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


#: Keys that `hot_key_join` spreads; their list is broadcast and has at most this many rows.
HOT_KEYS = 1000


def hot_key_join(big: DataFrame, small: DataFrame, key: str, weight: str, on: str, salts: int = 32) -> DataFrame:
    """Inner join of many rows per key to one row per key, where some keys are very frequent.

    Only the ``HOT_KEYS`` keys with the greatest ``weight`` (their number of rows in
    ``big``) are salted: their few rows of ``small`` are repeated ``salts`` times and
    their rows of ``big`` spread by a hash of ``on``.  All other keys join as they are.
    """
    hot = small.orderBy(F.desc(weight), key).limit(HOT_KEYS).select(F.col(key), F.lit(True).alias("_hot"))
    left = big.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(on), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    spread = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = small.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(spread)).drop("_hot")
    return left.join(right, [key, "_salt"]).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer partitions than there are; larger inputs stay as they are."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
