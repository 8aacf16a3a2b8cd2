"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies, usually a fraction, that
each of its documents should have. The whole part is certain. The fractional parts are
settled by the pivotal method with mass counted in words: two documents at a time, words
move from one to the other, the direction drawn so that neither's expectation changes,
until one of the two is integral. Every pair keeps the source's words exact, so all that
is lost in the end is the last document's fraction.

A source is split into blocks by a hash of id and text; each block leaves one undecided
document at most, and a reduction tree combines those of ``FAN_IN`` blocks at a time, level
by level, until one is left per source. It is rounded to the nearer side, and the words this
is off by go to the document of the source whose size comes closest; these two documents of
a source are the only ones whose expectation is not kept. Blocks, order and draws depend on
ids, texts and the seed, so reruns agree wherever the rows lie; only rows with a null id are
also told apart by their place in the file.

Defined cases: a null text has size 0, and documents of size 0 take no part in the words but
get copies by their own draw; a null source is a source of its own, last; ids may be of any
type, null or repeated (rows are told apart by locator, so documents must be read from
files); rows that repeat both id and text share a block; where every size is 0 all targets
are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.llm.common import joined_hot, located, spaced, whole_text, written

#: Most copies of a document, the weights that sources take in turn, rows per block, blocks combined at a time.
MAX_COPIES, WEIGHTS, BLOCK_ROWS, FAN_IN = 3, (1.0, 2.0, 3.0), 2_000, 16
#: A source with more than one in so many rows is joined by broadcast; there are fewer than so many of them.
HOT_SOURCES = 256


def word_count(text):
    """Runs of characters other than ASCII white space, counted without building them."""
    bare = F.trim(F.regexp_replace(spaced(text), " {2,}", " "))
    return F.when(bare == "", F.lit(0)).otherwise(
        F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1
    ).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target), a row per source: shares by weight, none above ``cap`` times its size.

    Sources are sorted by cap * size / weight; a prefix of that order is capped, and the
    rest share what the prefix leaves. The table has a row per source, so its windows are small.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = totals.withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int"))
    )
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(cap * F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(cap * F.sum("source_size").over(before), F.lit(0))) / F.sum(
        "weight"
    ).over(onward)
    leveled = weighted.withColumn("level", level)
    open_ = F.col("level") * F.col("weight") <= cap * F.col("source_size")
    # the first source that its share fits in sets the level for all after it
    shared = leveled.withColumn("shared", F.first(F.when(open_, F.col("level")), True).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)))
    return shared.select(
        "source",
        "source_size",
        "source_rows",
        F.when(F.col("shared").isNull(), (cap * F.col("source_size")).cast("double"))
        .otherwise(F.least(F.col("shared") * F.col("weight"), (cap * F.col("source_size")).cast("double")))
        .alias("target"),
    )


def settle(share: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Pivotal rounding of the shares (0 to 1) of documents of these sizes.

    Returns the shares, all 0 or 1 but one at most, and that one's position or -1.
    """
    p, s, draws = share.tolist(), size.tolist(), rng.random(len(share)).tolist()
    i = -1
    for j, pj in enumerate(p):
        if pj <= 1e-12 or pj >= 1 - 1e-12:
            p[j] = round(pj)
            continue
        if i < 0:
            i = j
            continue
        pi, si, sj = p[i], s[i], s[j]
        i_up, j_down = si * (1 - pi), sj * pj
        i_down, j_up = si * pi, sj * (1 - pj)
        rise, fall = min(i_up, j_down), min(i_down, j_up)
        if draws[j] * (rise + fall) < fall:
            first, second = (1.0, 0.0) if i_up == j_down else (1.0, pj - i_up / sj) if i_up < j_down else (pi + j_down / si, 0.0)
        else:
            first, second = (0.0, 1.0) if i_down == j_up else (0.0, pj + i_down / sj) if i_down < j_up else (pi - j_up / si, 1.0)
        p[i], p[j] = first, second
        if 1e-12 < second < 1 - 1e-12:
            p[i] = round(first)
            i = j
        elif not 1e-12 < first < 1 - 1e-12:
            p[i], p[j] = round(first), round(second)
            i = -1
        else:
            p[j] = round(second)
    return np.array(p), i


def _level(rows: DataFrame, seed: int, level: int) -> DataFrame:
    """One level of the tree: settles each (source, block) and marks what is left as undecided."""

    def block(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "at", "file", "row"], ascending=[False, True, True, True], kind="stable")
        draw = int(group["draw"].iloc[0]) & 0xFFFFFFFFFFFFFFFF
        rng = np.random.default_rng([seed, level, draw, int(group["block"].iloc[0])])
        share, left = settle(group["share"].to_numpy(), group["size"].to_numpy(dtype=np.float64), rng)
        undecided = np.zeros(len(group), dtype=bool)
        if left >= 0:
            undecided[left] = True
        return group.assign(share=share, undecided=undecided)

    return rows.groupBy("draw", "source", "block").applyInPandas(block, rows.schema)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[float, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    block_rows: int = BLOCK_ROWS,
    seed: int = 7,
) -> DataFrame:
    """id, source, size, source_size, target, copies and the locator __file, __row; a row per document."""
    text = whole_text(docs, text_col)
    named, said = F.xxhash64(F.lit(seed), docs[id_col]), F.xxhash64(text)
    sized = written(
        located(docs).select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source_key"),
            word_count(text).alias("size"),
            F.when(docs[id_col].isNull(), F.xxhash64(named, said, F.col("__row"))).otherwise(F.xxhash64(named, said)).alias("at"),
            F.col("__file").alias("file"),
            F.col("__row").alias("row"),
        ),
        "sizes",
    )
    targets = written(source_targets(sized, weights, max_copies), "targets")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    blocks = F.ceil(F.col("source_rows") / block_rows)
    keyed = targets.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    hot = keyed.where(F.col("source_rows") * HOT_SOURCES > sized.count())
    rows = (
        joined_hot(sized, keyed, ["source_key"], hot)
        .withColumn("wanted", wanted)
        .withColumn("whole", F.floor(F.col("wanted") + 1e-12).cast("int"))
        .withColumn("share", F.greatest(F.col("wanted") - F.col("whole"), F.lit(0.0)))
        .withColumn("draw", F.xxhash64("source"))
        .withColumn("block", F.pmod("at", blocks).cast("long"))
        .withColumn("undecided", F.lit(True))
        .drop("wanted", "source_rows")
    )
    # documents of size 0 carry no mass; each is drawn by its own hash
    lone = rows.where("size = 0").withColumn(
        "share", ((F.pmod(F.xxhash64("at", F.lit(1)), F.lit(1 << 30)) / (1 << 30)) < F.col("share")).cast("double")
    ).withColumn("undecided", F.lit(False))
    level = written(_level(rows.where("size > 0"), seed, 0), "level")
    decided = [lone, level.where("not undecided")]
    left = level.where("undecided")
    depth = 1
    while (left.agg(F.max("block")).first()[0] or 0) > 0:
        level = written(_level(left.withColumn("block", F.floor(F.col("block") / FAN_IN).cast("long")), seed, depth), "level")
        decided.append(level.where("not undecided"))
        left = level.where("undecided")
        depth += 1
    # one document per source at most is left
    final = left.withColumn("off", (F.round("share") - F.col("share")) * F.col("size")).withColumn("share", F.round("share"))
    settled = decided[0]
    for d in decided[1:]:
        settled = settled.unionByName(d)
    settled = settled.withColumn("off", F.lit(0.0)).unionByName(final)
    settled = settled.withColumn("copies", (F.col("whole") + F.col("share").cast("int")).cast("int"))
    off = final.select("source_key", F.col("off").alias("to_settle"))
    settled, off = written(settled, "settled"), written(off, "off")
    able = F.when(F.col("to_settle") < 0, F.col("copies") < max_copies).otherwise(F.col("copies") > 0)
    gap = F.abs(F.col("size") - F.abs("to_settle"))
    moved = (
        joined_hot(settled.where("size > 0"), off, ["source_key"], hot)
        .where(able & (gap < F.abs("to_settle")))
        .groupBy("source_key")
        .agg(F.min(F.struct(gap.alias("gap"), "at", "file", "row", F.signum("to_settle").alias("sign"))).alias("m"))
        .select(
            F.col("m.file").alias("m_file"), F.col("m.row").alias("m_row"), (-F.col("m.sign")).cast("int").alias("change")
        )
    )
    return (
        settled.join(moved, (settled["file"] == moved["m_file"]) & (settled["row"] == moved["m_row"]), "left")
        .select(
            F.col("id").alias(id_col),
            "source",
            "size",
            "source_size",
            "target",
            (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies"),
            F.col("file").alias("__file"),
            F.col("row").alias("__row"),
        )
    )
