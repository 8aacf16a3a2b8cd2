"""Exact positions without one window over all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, group: list[str], cell: list[Column], order: list[Column], out: str) -> DataFrame:
    """Adds ``out``: the row's position from 0 within its group, by (cell, order).

    Cells cut a group into parts that follow each other. Rows are numbered within their part;
    the parts' sizes, one row each, are summed up before it.
    """
    names = [f"__cell{i}" for i in range(len(cell))]
    parted = df.withColumns(dict(zip(names, cell)))
    keys = [*group, *names]
    sizes = parted.groupBy(*keys).agg(F.count("*").alias("__size"))
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"__r{k}") for k in keys], F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    same = reduce(lambda a, b: a & b, (parted[k].eqNullSafe(starts[f"__r{k}"]) for k in keys))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return (
        parted.withColumn("__at", at)
        .join(starts, same)
        .withColumn(out, (F.col("__start") + F.col("__at")).cast("long"))
        .drop("__at", "__start", *names, *[f"__r{k}" for k in keys])
    )
