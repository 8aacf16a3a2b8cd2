"""Sources and sinks of notes: trees of files, conversations, chat exports, snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Folders that never hold notes.
RESERVED = (".git", ".trash", ".history", "node_modules")


def note_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("md", "markdown", "mdown", "txt")) -> DataFrame:
    """(path, body, mtime) of the files below ``root``; hidden and reserved folders are skipped."""
    files = (
        spark.read.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}")
        .load(root)
    )
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.col("_metadata.file_path"), rf"^file:(//)?\Q{base}\E/", "")
    found = files.select(rel.alias("path"), F.col("value").alias("body"), F.unix_timestamp("_metadata.file_modification_time").alias("mtime"))
    hidden = F.exists(F.split("path", "/"), lambda s: s.startswith(".") | s.isin(*RESERVED))
    return found.where(~hidden)


def session_notes(turns: DataFrame) -> DataFrame:
    """One note per conversation, turns in order."""
    said = F.concat(F.lit("**"), F.col("role"), F.lit("**: "), F.col("text"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", said.alias("said"))))
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.array_join(F.transform(ordered, lambda t: t["said"]), "\n\n").alias("body")
    ).select(F.concat(F.lit("sessions/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), "turns", "body")


def chat_documents(messages: DataFrame) -> DataFrame:
    """A document per thread, and per channel and day for loose messages; system notices and blanks dropped."""
    rows = messages.where("role <> 'system' and trim(text) <> ''")
    part = F.coalesce("thread", F.date_format("ts", "yyyy-MM-dd"))
    said = F.struct("ts", "role", "text")
    grouped = rows.groupBy("channel", part.alias("part")).agg(
        F.count("*").alias("messages"), F.sort_array(F.collect_list(said)).alias("m"), F.max("ts").alias("updated")
    )
    body = F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")
    return grouped.select(F.concat_ws("/", "channel", "part").alias("external_id"), "messages", body.alias("body"), "updated")


def user_statements(turns: DataFrame, most: int = 19_000) -> DataFrame:
    """What users said, trimmed, non-empty, in order."""
    said = turns.where((F.col("role") == "user") & (F.trim("text") != ""))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return said.select("conv_id", "turn", at.alias("ordinal"), F.left(F.trim("text"), F.lit(most)).alias("statement"))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only in local mode a temporary folder may stand in for it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="notelake-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Rows in one Arrow batch of texts at most.
BATCH_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Bounds the rows per Arrow batch for this session, so that a Python worker holds few whole texts at a time whatever a task reads.

    The setting stays: frames are evaluated after the operator that made them has returned.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read more than once from there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_kept(df: DataFrame) -> None:
    """Deletes the folder of a table from ``kept`` that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(conf).delete(folder, True)


def export_snapshot(df: DataFrame, path: str, partition: str | None = None, fmt: str = "parquet") -> None:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).format(fmt).save(path)


def import_snapshot(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def round_trip(df: DataFrame, partition: str, fmt: str = "parquet") -> DataFrame:
    """Writes a snapshot to the shared folder and reads it back."""
    path = f"{shared_folder(df.sparkSession)}/snapshot-{uuid.uuid4().hex}"
    export_snapshot(df, path, partition, fmt)
    return import_snapshot(df.sparkSession, path, df.schema, fmt)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An evaluation set or result; an empty one is an error."""
    rows = spark.read.schema(schema).json(path)
    if rows.isEmpty():
        raise ValueError(f"{path} holds no rows")
    return rows


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def document_hash(title: Column, body: Column, url: Column, author: Column, meta: Column) -> Column:
    """SHA-256 over a document's fields and its metadata sorted by key."""
    pairs = F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.sha2(F.concat_ws("\x01", title, body, url, author, F.array_join(pairs, "\x02")), 256)
