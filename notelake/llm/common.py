"""Shared helpers: the folder all executors see, written tables, exact ranks without one big window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: ASCII white space, as a character class body for Java and DuckDB regular expressions.
WHITE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only in local mode, as in tests, a temporary folder may stand in for it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="notelake-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/notelake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the folder of a table from ``written`` that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(conf).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in one Arrow batch of texts at most.
BATCH_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Bounds the rows per Arrow batch for this session, so that a Python worker holds few whole texts at a time.

    The setting stays: frames are evaluated after the operator that made them has returned.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def whole_text(df: DataFrame, text_col: str = "text") -> Column:
    """The text column as a string, null as empty."""
    return F.coalesce(df[text_col].cast(T.StringType()), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space, as an array."""
    return F.filter(F.split(spaced(text), " "), lambda w: w != "")


def spaced(text: Column) -> Column:
    """``text`` with every ASCII white space character made a plain space."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def numbered(df: DataFrame, group: list[str], cell: list[Column], order: list[Column], out: str) -> DataFrame:
    """Adds ``out``: the row's position from 0 within its group, by (cell, order).

    ``cell`` splits a group into many parts that follow each other, so that no window holds
    a whole group: rows are numbered within their part, and the parts' sizes, one row per
    part, are summed up before it. The result is the same as one window over the group.
    """
    names = [f"__cell{i}" for i in range(len(cell))]
    parted = df.withColumns(dict(zip(names, cell)))
    inner = Window.partitionBy(*group, *names)
    sizes = parted.groupBy(*group, *names).agg(F.count("*").alias("__size"))
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    on = None
    right = starts.select(*[F.col(c).alias(f"__r_{c}") for c in (*group, *names)], "__start")
    for c in (*group, *names):
        equal = parted[c].eqNullSafe(right[f"__r_{c}"])
        on = equal if on is None else on & equal
    return (
        parted.withColumn("__at", F.row_number().over(inner.orderBy(*order)) - 1)
        .join(right, on)
        .withColumn(out, (F.col("__start") + F.col("__at")).cast("long"))
        .drop("__at", "__start", *names, *[f"__r_{c}" for c in (*group, *names)])
    )


def joined_hot(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Left join of ``left`` with ``right``, a row per ``keys``, where a few keys hold many rows of ``left``.

    ``hot`` names these keys; the caller states what bounds their number. Their rows of ``right``
    are broadcast, so rows of a hot key stay where they are; only the others are shuffled.
    """
    few = F.broadcast(hot.select(*keys))
    at_hot = left.join(few, keys, "left_semi").join(F.broadcast(right.join(few, keys, "left_semi")), keys, "left")
    return at_hot.unionByName(left.join(few, keys, "left_anti").join(right.hint("merge"), keys, "left"))


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with __file and __row, where each row's content lies; ``docs`` has to be read from files.

    The pair is unique and stays the same whenever the files are read again.
    """
    return docs.withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
