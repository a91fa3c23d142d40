"""Streams of points into a collection: micro-batches are upserted, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointsmith.sources.catalog import Catalog


def stream_upserts(stream: DataFrame, catalog: Catalog, name: str, checkpoint: str, order_col: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Upsert every micro-batch into the collection, each exactly once.

    The batch's number is kept in the catalog entry that makes its rows the collection's version, so rows and number are
    committed together: a batch that Spark replays after a crash is either not in yet, or passed over.
    """

    def write(batch: DataFrame, number: int) -> None:
        if number > catalog.last_batch(name, checkpoint):
            catalog.upsert(name, batch, order_col, (checkpoint, number))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def write_counts(counts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Finished windows, appended to a Parquet table as their watermark passes; nothing is gathered on the driver."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_counts(counts: DataFrame, path: str, checkpoint: str, keys: list[str], trigger: dict | None = None) -> StreamingQuery:
    """All windows, open ones too: each micro-batch's changed rows become a folder of the table, by batch number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_latest(spark, path: str, keys: list[str]) -> DataFrame:
    """The last state of each key that latest_counts has written."""
    rows = spark.read.parquet(path)
    own = [c for c in rows.columns if c not in (*keys, "batch", "part")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*own), "batch").alias("x"))
    return last.select(*keys, "x.*")


def windowed_counts(stream: DataFrame, time_col: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, key, n): tumbling counts with a watermark; state is bounded by keys times open windows."""
    grouped = stream.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), F.col(key))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
