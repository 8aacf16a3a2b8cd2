"""Structured Streaming jobs; each gives what its batch operator gives on the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from notelake.operators.access_log import ingest
from notelake.sources.notes import shared_folder
from notelake.streaming.state import STORE


def deliver_to(rows: DataFrame, at: str | None, job: Callable[[DataFrame], DataFrame], mode: str, root: str, work: Callable[[DataFrame, int], None], deliveries: int = 3, checkpoint: str | None = None) -> DataFrame:
    """Lands ``rows`` in several deliveries, in order of ``at``, and runs the stream after each on what is new; ``work`` gets each micro-batch.

    State, watermark and checkpoint carry over from one run to the next, as when a job is restarted. A delivery keeps the
    partitions of ``rows``; without ``at`` rows are dealt by hash. State is kept in RocksDB, under ``root`` or at ``checkpoint``.
    Returns the stream, for its schema.
    """
    spark = rows.sparkSession
    if at is None:
        turn = F.pmod(F.xxhash64(*rows.columns), F.lit(deliveries))
    else:
        ends = rows.agg(F.unix_micros(F.min(at).cast("timestamp")), F.unix_micros(F.max(at).cast("timestamp"))).first()
        low, high = ends[0] or 0, ends[1] or 0
        since = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")) - low, F.lit(0))
        turn = F.least(F.floor(since * deliveries / (high - low + 1)), F.lit(deliveries - 1))
    landed = rows.withColumn("__turn", turn)
    rows.where(F.lit(False)).write.parquet(f"{root}/in")  # a stream needs the folder to be there
    stream = job(spark.readStream.schema(rows.schema).parquet(f"{root}/in"))
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{root}/checkpoint").foreachBatch(work).trigger(availableNow=True)
    before = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        for i in range(deliveries):
            landed.where(F.col("__turn") == i).drop("__turn").write.mode("append").parquet(f"{root}/in")
            writer.start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return stream


def deliver(rows: DataFrame, at: str | None, job: Callable[[DataFrame], DataFrame], mode: str, name: str, deliveries: int = 3, checkpoint: str | None = None) -> DataFrame:
    """What a stream wrote over several deliveries (``deliver_to``), with the number of the micro-batch in ``batch``."""
    spark = rows.sparkSession
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{root}/out/part={n}")

    stream = deliver_to(rows, at, job, mode, root, keep, deliveries, checkpoint)
    return spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{root}/out")


def newest(out: DataFrame, keys: list[str]) -> DataFrame:
    """The last row per key of a stream in update mode."""
    rest = [c for c in out.columns if c not in (*keys, "batch", "part")]
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__last"))
    return last.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def log_ingest(events: DataFrame) -> DataFrame:
    """The access log's kept rows, appended."""
    return ingest(events)


def denial_caps(events: DataFrame, most: int, late: str = "10 minutes") -> DataFrame:
    """Denials kept and suppressed per caller and minute, once a minute is closed by the watermark."""
    denied = events.where(~F.col("allowed")).withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    n = denied.groupBy("caller", F.window("at", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return n.select("caller", F.col("w.start").alias("minute"), F.least("n", F.lit(most)).cast("long").alias("kept"), F.greatest(F.col("n") - most, F.lit(0)).cast("long").alias("suppressed"))


def breadth_alerts(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute", least: int = 15, late: str = "10 minutes") -> DataFrame:
    """Callers that read about ``least`` distinct documents and more in a sliding window."""
    reads = events.where("allowed").withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    n = reads.groupBy("caller", F.window("at", window, slide).alias("w")).agg(F.approx_count_distinct("path").alias("n"))
    return n.where(F.col("n") >= least).select("caller", F.col("w.start").alias("start"), "n")


def windowed_metrics(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and outcome."""
    e = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    out = e.groupBy(F.window("at", window).alias("w"), "allowed").agg(F.count("*").alias("n"), F.sum("value").alias("value_sum"))
    return out.select(F.col("w.start").alias("start"), "allowed", "n", "value_sum")


def coalesced_edits(edits: DataFrame, quiet: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """One row per burst of edits to a path: its first and last time, number, and last content."""
    e = edits.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    s = e.groupBy("path", F.session_window("at", quiet).alias("w")).agg(F.count("*").alias("n"), F.max("at").alias("last"), F.max_by("content", F.struct("at", "seq")).alias("content"))
    return s.select("path", F.col("w.start").alias("first"), "last", "n", "content")


def connector_upserts(pages: DataFrame, late: str = "1 day") -> DataFrame:
    """Each version of a document once, however often a page delivers it."""
    p = pages.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return p.dropDuplicatesWithinWatermark(["connector", "external_id", "hash"])


def on_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts ``work`` for each micro-batch; the caller stops the returned query."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work).start()
