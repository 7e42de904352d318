"""Structured Streaming counterparts of the watcher, and windows over events as an extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import review
from tessera.sources import append
from tessera.sources.store import Store


def watch(spark: SparkSession, path: str, schema, sink: Callable[[DataFrame, int], None], checkpoint: str, per_trigger: int = 50):
    """Each file once, in batches of at most ``per_trigger`` files; the checkpoint is the ledger. Ends when all is read."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def every(spark: SparkSession, step: int, action: Callable[[], None], state: str) -> Callable[[DataFrame, int], None]:
    """A sink that calls ``action`` whenever another ``step`` rows have come. The count of each batch is a file of its own in ``state``, written again if the batch is, so a
    batch that is run twice counts once."""
    kind = "batch long, n long"

    def sink(batch: DataFrame, k: int) -> None:
        n = batch.count()
        spark.createDataFrame([(k, n)], kind).coalesce(1).write.mode("overwrite").parquet(f"{state}/at={k:09d}")
        total = spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(state).where(F.col("batch") <= k).agg(F.sum("n")).first()[0]
        if total // step > (total - n) // step:
            action()

    return sink


def upserting(spark: SparkSession, folder: str, empty: DataFrame) -> tuple[Callable[[DataFrame, int], None], Callable[[], DataFrame]]:
    """A sink that lays each batch over the log (K01), and the log as it stands. The log is a ``Store``: a batch writes its own rows, a batch that is run twice replaces itself, and
    buckets are compacted as they fill."""
    schema = empty.drop(*review.HUMAN).schema
    log = Store(spark, folder, schema, review.KEY, {c: (t, {"boolean": False, "string": ""}[t]) for c, t in review.HUMAN.items()})

    def sink(batch: DataFrame, k: int) -> None:
        log.put(k, batch)
        log.compact()

    return sink, log.read


def logging(folder: str, kind: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends an event for each row to an audit log, marked with its batch, so what a repeated batch adds can be told apart."""
    return lambda batch, k: append(batch.select(F.current_timestamp().alias("at"), F.lit(kind).alias("kind"), F.lit(k).alias("batch"), F.to_json(F.struct(*batch.columns)).alias("payload")), folder)


def windowed(stream: DataFrame, at: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts by event-time window; works on streams and on tables alike."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def once(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
