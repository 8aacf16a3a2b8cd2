"""Exact deduplication by a stateful stream.

A narrow table of digests (SHA-256 of the normalised text, id, content locator) is landed
in the shared folder and streamed through a keyed aggregation. Its state, kept on disk by
RocksDB, holds per digest the row that stays (smallest id, then locator) and the group's
size, and never expires. With a ``checkpoint`` of the caller's, state and landed digests
stay there: a later run streams the digests of new documents only and still knows every
text of the runs before. Each micro-batch writes the keys it changed; the last row per
digest is the state's end.

Digest hits are checked on full bytes. Only texts under a digest that several rows have are
read again, those of earlier runs through the locator that the state holds, and grouped by
digest and whole normalised text. Copies are combined before the shuffle, so a group of
copies on a third of all rows leaves one row per task. Should one digest cover two texts,
these are kept apart.

The locator is the file and the row's place in it, so the documents must be read from
files. Texts are equal when identical after each run of ASCII white space becomes a space.

Defined cases: a null text counts as empty; a null id comes after every other id; rows that
repeat an id with the same text are told apart by locator, so one of them stays; an empty
table gives an empty result; other columns are ignored; documents that an earlier run on
the same checkpoint has seen must not be given again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.llm.common import drop_written, joined_hot, located, new_path, spaced, whole_text, written

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # many small stores: no disk reserved ahead of what they hold
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}
#: Digests with several rows, of 32 bytes each, up to which they are broadcast to the scan of their texts.
BROADCAST_HITS = 100_000
#: A digest of more than one in so many rows is joined by broadcast; there are fewer than so many of them.
HOT_DIGESTS = 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(spaced(text), " {2,}", " ")


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _keeper() -> Column:
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row")


def keyed_state(spark: SparkSession, root: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """(digest, keeper, group_size) after streaming the tables below ``root``/digests that the state there has not seen."""
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    out = f"{root}/keys"
    try:
        reader = spark.readStream.schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        landed = reader.parquet(f"{root}/digests/*")
        state = landed.groupBy("digest").agg(F.min(_keeper()).alias("keeper"), F.count("*").alias("group_size"))

        def keep(changed: DataFrame, batch: int) -> None:
            changed.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/part={batch}")

        run = (
            state.writeStream.outputMode("update")
            .foreachBatch(keep)
            .option("checkpointLocation", f"{root}/state")
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changes = spark.read.schema(T.StructType([*state.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    newest = changes.groupBy("digest").agg(F.max_by(F.struct("keeper", "group_size"), "batch").alias("s"))
    return newest.select("digest", "s.keeper", "s.group_size")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return located(docs).select(
        F.col(id_col).alias("id"),
        normalised(whole_text(docs, text_col)).alias("norm"),
        F.col("__file").alias("file"),
        F.col("__row").alias("row"),
    )


def _earlier_texts(docs: DataFrame, hits: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(norm) of keepers that lie in files of earlier runs, fetched by their locators."""
    own = located(docs).select(F.col("__file").alias("file")).distinct()
    older = hits.select("keeper.file", "keeper.row").join(own, "file", "left_anti")
    files = [r["file"] for r in older.select("file").distinct().collect()]  # at most a row per file of earlier runs
    if not files:
        return _texts(docs, id_col, text_col).where(F.lit(False))
    then = docs.sparkSession.read.schema(docs.schema).parquet(*files)
    return _texts(then, id_col, text_col).join(older.distinct(), ["file", "row"], "left_semi").select("id", "norm", "file", "row")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    files_per_batch: int | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """id, keep_id, group_size, kept, digest (binary) and the locator __file, __row; a row per document.

    ``checkpoint``: a folder that keeps the state for later runs, over Parquet documents of the same
    schema; keep_id and group_size then cover the runs before.
    """
    spark = docs.sparkSession
    rows = _texts(docs, id_col, text_col)
    root = (checkpoint or new_path(spark, "exact")).rstrip("/")
    path = f"{root}/digests/{uuid.uuid4().hex}"
    narrow = rows.select("id", digest_of(F.col("norm")).alias("digest"), "file", "row")
    narrow.write.parquet(path)
    landed = spark.read.schema(narrow.schema).parquet(path)
    if landed.isEmpty():
        none = landed.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", "file", "row")
        return none.withColumnsRenamed({"id": id_col, "file": "__file", "row": "__row"})
    state = written(keyed_state(spark, root, landed.schema, files_per_batch), "state")
    hits = written(state.where("group_size > 1").select("digest", "keeper"), "hits")
    digests = hits.select("digest")
    digests = F.broadcast(digests) if hits.count() <= BROADCAST_HITS else digests.hint("merge")
    again = rows.withColumn("digest", digest_of(F.col("norm"))).join(digests, "digest", "left_semi")
    older = _earlier_texts(docs, hits, id_col, text_col) if checkpoint else rows.where(F.lit(False))
    older = older.withColumn("digest", digest_of(F.col("norm"))).select(*again.columns)
    # a row for each different text under a digest, after map-side combination of copies
    texts = again.unionByName(older).groupBy("digest", "norm").agg(F.lit(1).alias("one"))
    broken = written(texts.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "broken")
    drop_written(hits)
    n = landed.count()
    hot = landed.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") * HOT_DIGESTS > n)
    joined = joined_hot(landed, state, ["digest"], hot)
    if not broken.isEmpty():
        twice = rows.withColumn("digest", digest_of(F.col("norm"))).join(broken, "digest", "left_semi")
        apart = twice.groupBy("digest", "norm").agg(F.min(_keeper()).alias("keeper"), F.count("*").alias("group_size"))
        split = twice.join(apart, ["digest", "norm"]).drop("norm")
        joined = joined.join(broken, "digest", "left_anti").unionByName(split)
    keeps = (F.col("file") == F.col("keeper.file")) & (F.col("row") == F.col("keeper.row"))
    return joined.select(
        F.col("id").alias(id_col),
        F.col("keeper.id").alias("keep_id"),
        "group_size",
        keeps.alias("kept"),
        "digest",
        F.col("file").alias("__file"),
        F.col("row").alias("__row"),
    )
