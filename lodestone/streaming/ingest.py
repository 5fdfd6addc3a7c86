"""Streaming ingest: deliveries of records that arrive as files are merged into the store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.store import Store


def newest(batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one of greatest ``order``; copies collapse."""
    rest = [c for c in batch.columns if c not in key]
    return batch.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def merge_batch(store: Store, batch: DataFrame, key: list[str], order: list[str], table: str = "documents") -> None:
    """Upsert a batch's newest rows, unless the store holds a row of the same or a greater order: late rows change nothing."""
    rows = newest(batch, key, order)
    held = store.read(table)
    if held is not None:
        mark = held.select(*key, F.struct(*order).alias("_held"))
        rows = rows.join(mark, key, "left").where(F.col("_held").isNull() | (F.struct(*order) > F.col("_held"))).drop("_held")
    store.upsert(table, rows, key)


def ingest(spark: SparkSession, source: str, schema, store: Store, checkpoint: str, key: list[str], order: list[str], table: str = "documents", **trigger) -> StreamingQuery:
    """Follow a folder of Parquet deliveries.  The checkpoint makes batches repeatable and `merge_batch` makes repeats harmless."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: merge_batch(store, df, key, order, table)).trigger(**(trigger or {"availableNow": True})).start()
