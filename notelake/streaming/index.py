"""An index that follows edits: each batch re-reads the notes that changed and adds what is different.

The index is a folder of tables partitioned by batch: ``notes`` (path, hash, content, deleted), ``links``, ``postings`` and
``frequencies`` (term, change). A batch writes its own partitions only, from the state before it, so that a batch run again after a failure
writes the same once more. What is current is read as: the newest batch of a path; links and postings of that batch; frequencies summed up. No table is
rewritten; ``compact`` turns what is current into a new folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.text import tokens
from notelake.operators import extract
from notelake.streaming.jobs import coalesced_edits, deliver_to

TABLES = {
    "notes": "path string, hash string, content string, deleted boolean",
    "links": "path string, target string, alias string, pos long",
    "postings": "path string, term string, tf long",
    "frequencies": "term string, change long",
}


def _table(spark: SparkSession, root: str, name: str, below: int | None = None) -> DataFrame:
    """One table with its ``batch``; of the batches before ``below``, where it is given."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    schema = f"{TABLES[name]}, batch int"
    found = spark.read.schema(schema).parquet(f"{root}/{name}") if there else spark.createDataFrame([], schema)
    return found if below is None else found.where(F.col("batch") < below)


def _newest(spark: SparkSession, root: str, below: int | None = None) -> DataFrame:
    """(path, hash, deleted, batch) of the newest batch of each path; contents are not read."""
    rows = _table(spark, root, "notes", below).groupBy("path").agg(F.max_by(F.struct("hash", "deleted", "batch"), "batch").alias("n"))
    return rows.select("path", "n.*")


def merge(root: str, edits: DataFrame, batch: int) -> None:
    """Adds a batch of edits (path, content, last): the last content of each path, null for a deleted note."""
    spark = edits.sparkSession
    last = edits.groupBy("path").agg(F.max_by(F.struct("content"), "last").alias("e")).select("path", "e.content")
    before = _newest(spark, root, batch).select("path", F.col("hash").alias("old"), F.col("deleted").alias("gone"), F.col("batch").alias("of"))
    hashed = last.withColumn("hash", F.sha2(F.col("content"), 256)).join(before, "path", "left")
    known = F.col("of").isNotNull() & ~F.coalesce("gone", F.lit(False))
    differs = F.when(F.col("hash").isNull(), known).otherwise(~known | (F.col("hash") != F.col("old")))
    changed = hashed.where(differs).select("path", "hash", "content", F.col("hash").isNull().alias("deleted"), F.when(known, F.col("of")).alias("of"))
    changed.drop("of").write.mode("overwrite").parquet(f"{root}/notes/batch={batch}")
    new = spark.read.schema(TABLES["notes"]).parquet(f"{root}/notes/batch={batch}")
    alive = new.where("not deleted").select("path", F.col("content").alias("body"))
    links = extract.links(alive).select(F.col("src").alias("path"), "target", "alias", F.col("pos").cast("long").alias("pos"))
    links.write.mode("overwrite").parquet(f"{root}/links/batch={batch}")
    said = alive.select("path", F.explode(tokens(F.col("body"))).alias("term")).groupBy("path", "term").agg(F.count("*").alias("tf"))
    said.write.mode("overwrite").parquet(f"{root}/postings/batch={batch}")
    added = spark.read.schema(TABLES["postings"]).parquet(f"{root}/postings/batch={batch}").select("term", F.lit(1).alias("change"))
    # what the changed notes said before, from the batch that wrote them
    was = new.select("path").join(before.where(~F.coalesce("gone", F.lit(False))), "path").select("path", F.col("of").alias("batch"))
    dropped = _table(spark, root, "postings", batch).join(was, ["path", "batch"], "left_semi").select("term", F.lit(-1).alias("change"))
    change = added.unionByName(dropped).groupBy("term").agg(F.sum("change").alias("change")).where("change <> 0")
    change.write.mode("overwrite").parquet(f"{root}/frequencies/batch={batch}")


def current(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """notes (path, hash, content), links (path, target, alias, pos), postings (path, term, tf), frequencies (term, df)."""
    newest = _newest(spark, root).where("not deleted").select("path", "batch")
    own = {name: _table(spark, root, name).join(newest, ["path", "batch"], "left_semi") for name in ("notes", "links", "postings")}
    df = _table(spark, root, "frequencies").groupBy("term").agg(F.sum("change").alias("df")).where("df > 0")
    return {"notes": own["notes"].select("path", "hash", "content"), "links": own["links"].drop("batch"), "postings": own["postings"].drop("batch"), "frequencies": df}


def compact(spark: SparkSession, root: str, to: str) -> None:
    """Writes what is current to the folder ``to`` as one batch, the newest one."""
    at = _table(spark, root, "notes").agg(F.max("batch")).first()[0] or 0
    now = current(spark, root)
    now["notes"].withColumn("deleted", F.lit(False)).write.parquet(f"{to}/notes/batch={at}")
    now["links"].write.parquet(f"{to}/links/batch={at}")
    now["postings"].write.parquet(f"{to}/postings/batch={at}")
    now["frequencies"].select("term", F.col("df").alias("change")).write.parquet(f"{to}/frequencies/batch={at}")


def follow(edits: DataFrame, root: str, quiet: str = "10 minutes", late: str = "1 hour", deliveries: int = 3, then: Callable[[int], None] | None = None) -> None:
    """Edits (path, at, seq, content) land in deliveries; each burst, once it is over, goes into the index at ``root``/index."""

    def work(batch: DataFrame, n: int) -> None:
        merge(f"{root}/index", batch, n)
        if then:
            then(n)

    deliver_to(edits, "at", lambda s: coalesced_edits(s, quiet, late), "append", root, work, deliveries)
