"""Streaming ingestion: keyed dedupe across restarts, ledgers, limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None, format: str = "json") -> DataFrame:
    """New files of a folder; ``files_per_batch`` bounds a batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(format).load(path)


def first_per_key(stream: DataFrame, key: Column, known: DataFrame | None = None, within: tuple[str, str] | None = None) -> DataFrame:
    """Rows of keys not seen before, in this stream or in ``known`` (column ``_key``).

    State holds every key; ``within`` (time column, delay) bounds it, at the
    price that a key may come again after the delay.
    """
    out = stream.withColumn("_key", key).filter("_key is not null and _key <> ''")
    if known is not None:
        out = out.join(known.select("_key"), "_key", "left_anti")
    if within:
        return out.withWatermark(*within).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
    return out.dropDuplicates(["_key"]).drop("_key")


def append(stream: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:
    """Append what is there now, exactly once over restarts."""
    w = stream.writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint)
    return w.outputMode("append").trigger(availableNow=True).start()


class _Full(Exception):
    """Ends a batch without committing it."""


def until(
    stream: DataFrame,
    checkpoint: str,
    limit: int,
    handle: Callable[[DataFrame], DataFrame],
    sink: Callable[[DataFrame, int], None],
) -> int:
    """Handle batches (``handle`` gives the successful rows) until ``limit`` are stored in all, over restarts; the number stored.

    ``sink`` gets the rows and the batch's number, and must overwrite what it stored of that batch: the batch in which
    the limit falls is not committed, so a restart with a larger limit runs it again and no row is lost.  The
    numbers of stored rows lie beside the checkpoint, one record per batch.
    """
    spark = stream.sparkSession
    ledger = f"{checkpoint}-stored"

    def stored(before: int | None = None) -> int:
        at = spark._jvm.org.apache.hadoop.fs.Path(ledger)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return 0
        rows = spark.read.schema("n long, batch long").json(ledger)
        rows = rows if before is None else rows.filter(F.col("batch") < before)
        return rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    full = False

    def batch(df: DataFrame, number: int) -> None:
        nonlocal full
        room = limit - stored(before=number)
        if room <= 0:
            full = True
            raise _Full
        good = handle(df).persist()
        found = good.count()
        sink(good.limit(room), number)
        good.unpersist()
        spark.createDataFrame([(min(found, room),)], "n long").coalesce(1).write.mode("overwrite").json(f"{ledger}/batch={number}")
        if found > room:
            full = True
            raise _Full

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    except StreamingQueryException:
        if not full:
            raise
    return stored()


def ledger_keys(spark: SparkSession, path: str, schema: str = "value string") -> DataFrame:
    """The keys of a ledger as ``_key``."""
    return spark.read.schema(schema).text(path).select(F.element_at(F.split("value", "\t"), 1).alias("_key")).distinct()
