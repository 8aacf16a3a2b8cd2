"""What a reader is told first: the briefing, and what a vault holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Notes of the pinned and onboarding sections; tags of the leaderboard; days of recent changes.
SECTION, TOP_TAGS, RECENT_DAYS = 10, 5, 7
#: Before the agent's name where a fact was retracted and nothing replaced it.
RETRACTED = "retracted:"


def briefing(notes: DataFrame, tags: DataFrame, facts: DataFrame, now: Column, n: int = 5, onboarding: str = "onboarding", memory: str = "memory/") -> DataFrame:
    """(section, place, key, title): pinned notes, notes tagged ``onboarding``, the newest notes under ``memory``, the newest live facts, and how many
    beliefs were changed and retracted in the last seven days.

    ``notes``: (path, title, private, pinned, updated); ``tags``: (note, tag); ``facts``: (id, text, stamp, expires, superseded_by, superseded_at). A note stands in the
    first of its sections only, private ones in none; sections are cut before that, so one may be shorter. Each section is a top-k, so nothing is sorted whole.
    """
    open_ = notes.where(~F.col("private"))
    newest = [F.desc_nulls_last("updated"), F.col("path")]
    tagged = open_.join(tags.where(F.col("tag") == onboarding).select(F.col("note").alias("path")).distinct(), "path", "left_semi")
    parts = [("pinned", open_.where("pinned"), SECTION), ("onboarding", tagged, SECTION), ("recent_memories", open_.where(F.startswith("path", F.lit(memory))), n)]
    rows = None
    for i, (name, of, most) in enumerate(parts):
        top = of.orderBy(*newest).limit(most).select(F.lit(i).alias("i"), F.lit(name).alias("section"), "path", "title", "updated")
        rows = top if rows is None else rows.unionByName(top)
    # at most 25 rows from here on
    once = rows.withColumn("again", F.row_number().over(Window.partitionBy("path").orderBy("i"))).where("again = 1")
    place = F.row_number().over(Window.partitionBy("section").orderBy(*newest))
    told = once.withColumn("place", place).select("section", "place", F.col("path").alias("key"), "title")
    live = facts.where(F.col("superseded_by").isNull() & (F.col("expires").isNull() | (F.col("expires") > now)))
    order = [F.desc_nulls_last("stamp"), F.col("id")]
    latest = live.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    latest = latest.select(F.lit("recent_facts").alias("section"), "place", F.col("id").alias("key"), F.col("text").alias("title"))
    week = facts.where((F.col("superseded_at") > now - F.make_dt_interval(F.lit(RECENT_DAYS))) & (F.col("superseded_at") <= now))
    gone = F.startswith("superseded_by", F.lit(RETRACTED))
    counts = week.agg(F.count_if(~gone).alias("changed"), F.count_if(gone).alias("retracted"))
    pairs = F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(c).alias("key"), F.col(c).cast("string").alias("title")) for i, c in enumerate(("changed", "retracted"))])
    changes = counts.select(F.explode(pairs).alias("p")).select(F.lit("belief_changes").alias("section"), "p.*")
    return told.unionByName(latest).unionByName(changes)


def vault_stats(notes: DataFrame, tags: DataFrame) -> DataFrame:
    """(kind, name, n): notes and tags in all, the tags on most notes, and the words of the notes of each day.

    ``notes``: (path, body, updated); ``tags``: (note, tag).
    """
    on = tags.groupBy("tag").agg(F.count_distinct("note").alias("n"))
    words = F.size(F.filter(F.split(F.coalesce("body", F.lit("")), r"\s+"), lambda w: w != ""))
    totals = [notes.agg(F.count("*").alias("n")).select(F.lit("notes").alias("name"), "n"), on.agg(F.count("*").alias("n")).select(F.lit("tags").alias("name"), "n")]
    top = on.orderBy(F.desc("n"), "tag").limit(TOP_TAGS).select(F.lit("tag").alias("kind"), F.col("tag").alias("name"), "n")
    days = notes.where("updated is not null").groupBy(F.date_format("updated", "yyyy-MM-dd").alias("name")).agg(F.sum(words).alias("n"))
    total = totals[0].unionByName(totals[1]).select(F.lit("total").alias("kind"), "name", "n")
    return total.unionByName(top).unionByName(days.select(F.lit("words").alias("kind"), "name", "n"))
