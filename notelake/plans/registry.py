"""Where queries register themselves with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the function under its name; ``sql`` computes the same rows in DuckDB."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


#: Bytes from which, and up to which, a table is dealt to all cores: below one split it is read by one task, whatever
#: it costs per row. What a query then shuffles is less than one split; larger tables are read as they lie.
DEALT = (256 << 10, 128 << 20)


#: Bytes of a table for one task, where a row costs so much that a split takes too long.
COSTLY = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str, costly: bool = False) -> DataFrame:
    """The table; with ``costly`` its rows are dealt to as many tasks as ``COSTLY`` says, however large it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if costly and size >= DEALT[0]:
        return df.repartition(max(spark.sparkContext.defaultParallelism, -(-size // COSTLY)))
    return df.repartition(spark.sparkContext.defaultParallelism) if DEALT[0] <= size < DEALT[1] else df
