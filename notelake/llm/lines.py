"""Removal of lines that many sites share.

A line's spread is the number of distinct sites it occurs on. HyperLogLog sketches of the
sites, one per line hash, are built by map-side partial aggregation and merged in the
shuffle, so a line on every page is one sketch per task. Lines whose estimate is clearly
above or below ``min_sites`` are decided by it; those within the sketch's error band are
counted exactly, which only moves distinct (line, site) pairs of such lines.

Lines are compared without leading and trailing ASCII white space, by MD5; blank lines are
never boilerplate. Every occurrence of a boilerplate line goes, the other lines stay as
they are.

Documents meet their boilerplate lines by file and row, so they must be read from files.

Defined cases: a null text has no lines and stays null; a null site is a site; ids do not
matter, they may be null or repeated; an empty table gives an empty result; columns named
n_lines and n_removed are replaced, other columns than the text pass through, unless they
start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import located, spaced, written

#: Sites from which a line is boilerplate; log2 of a sketch's buckets; error band in standard errors.
MIN_SITES, LG_K, BAND = 10, 12, 6.0
#: Boilerplate lines, of 16 bytes each, up to which they are broadcast.
BROADCAST_LINES = 100_000


def line_key(line: Column) -> Column:
    """MD5 of a trimmed line as 16 bytes; null for a blank line."""
    bare = F.trim(spaced(line))
    return F.when(bare != "", F.unhex(F.md5(bare)))


def _keys(docs: DataFrame, site_col: str, text_col: str) -> DataFrame:
    keys = F.array_distinct(F.transform(F.split(docs[text_col], "\n"), line_key))
    return located(docs).select(
        "__file",
        "__row",
        F.coalesce(docs[site_col].cast("string"), F.lit("")).alias("site"),
        F.explode(keys).alias("line"),
    ).where("line is not null")


def boilerplate(keys: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(line) for each line hash of ``keys`` (site, line) on at least ``min_sites`` sites."""
    width = max(2.0, BAND * 1.04 / (1 << lg_k) ** 0.5 * min_sites)
    estimated = keys.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))
    estimated = written(estimated.where(F.col("sites") >= min_sites - width), "spread")
    near = estimated.where(F.col("sites") <= min_sites + width).select("line")
    exact = (
        keys.select("site", "line")
        .join(near, "line", "left_semi")
        .distinct()
        .groupBy("line")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_sites)
    )
    return estimated.where(F.col("sites") > min_sites + width).select("line").unionByName(exact.select("line"))


def remove_boilerplate(
    docs: DataFrame,
    site_col: str = "source",
    text_col: str = "text",
    min_sites: int = MIN_SITES,
    lg_k: int = LG_K,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``, plus n_lines and n_removed."""
    keys = _keys(docs, site_col, text_col)
    common = written(boilerplate(keys, min_sites, lg_k), "boilerplate")
    few = common.count() <= BROADCAST_LINES
    met = keys.join(F.broadcast(common) if few else common.hint("merge"), "line")
    hit = met.groupBy("__file", "__row").agg(F.collect_set("line").alias("__gone"))
    lines = F.split(F.col(text_col), "\n")
    rows = located(docs).join(hit.hint("merge"), ["__file", "__row"], "left").select(*docs.columns, "__gone")
    kept = F.when(F.col("__gone").isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("__gone"), line_key(x)), F.lit(False)))
    )
    worded = lambda a: F.size(F.filter(a, lambda x: F.trim(spaced(x)) != ""))
    return (
        rows.withColumn("__kept", kept)
        .withColumn("n_lines", F.coalesce(worded(lines), F.lit(0)).cast("long"))
        .withColumn("n_removed", F.coalesce(F.size(lines) - F.size("__kept"), F.lit(0)).cast("long"))
        .withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join("__kept", "\n")))
        .drop("__kept", "__gone")
    )
