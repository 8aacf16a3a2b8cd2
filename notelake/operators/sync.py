"""Incremental ingest, peer sync, histories and merges as joins of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: File types whose two sides can be merged.
MERGEABLE = r"\.(md|markdown|txt)$"


#: Atoms and tombstones that one task merges, about.
MERGED_ATOMS = 1_000_000


def sync_status(old: DataFrame, new: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(path, status): added, removed, unchanged (same mtime within a millisecond, else same hash), updated."""
    o = old.select("path", F.col("mtime").alias("old_mtime"), F.col("hash").alias("old_hash"), F.lit(1).alias("in_old"))
    n = new.select("path", F.col("mtime").alias("new_mtime"), F.col("hash").alias("new_hash"), F.lit(1).alias("in_new"))
    same = (F.abs(F.col("old_mtime") - F.col("new_mtime")) < tolerance) | (F.col("old_hash") == F.col("new_hash"))
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(same, "unchanged").otherwise("updated")
    return o.join(n, "path", "full").select("path", status.alias("status"))


def refresh(derived: DataFrame, fresh: DataFrame, status: DataFrame, key: str = "path") -> DataFrame:
    """Derived rows after a sync: those of unchanged paths stay, those of added and updated ones come from ``fresh``."""
    kept = derived.join(status.where("status = 'unchanged'").select(F.col("path").alias(key)), key, "left_semi")
    return kept.unionByName(fresh.join(status.where("status in ('added', 'updated')").select(F.col("path").alias(key)), key, "left_semi"))


def upsert_plan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(connector, external_id, path, hash, action): create, update or unchanged; blank bodies are skipped; a known path stays.

    ``docs``: connector, external_id, title, body, hash, folder. ``known``: connector, external_id, path, hash.
    """
    k = known.select("connector", "external_id", F.col("path").alias("old_path"), F.col("hash").alias("old_hash"))
    stem = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), F.lit("-"))
    fresh = F.concat(F.col("folder"), F.lit("/"), stem, F.lit("-"), F.left(F.sha2("external_id", 256), F.lit(6)), F.lit(".md"))
    action = F.when(F.col("old_hash").isNull(), "create").when(F.col("old_hash") == F.col("hash"), "unchanged").otherwise("update")
    rows = docs.where(F.trim("body") != "").join(k, ["connector", "external_id"], "left")
    return rows.select("connector", "external_id", F.coalesce("old_path", fresh).alias("path"), "hash", action.alias("action"))


def reap(known: DataFrame, docs: DataFrame, seen: DataFrame, complete: DataFrame) -> DataFrame:
    """Known documents that a complete page no longer names; a connector without one loses nothing."""
    named = docs.select("connector", "external_id").unionByName(seen.select("connector", "external_id"))
    whole = complete.where("complete").select("connector")
    return known.join(whole, "connector", "left_semi").join(named, ["connector", "external_id"], "left_anti")


def route(docs: DataFrame, routes: DataFrame, field: str, prefix: str) -> DataFrame:
    """Adds folder: the route of the field's value, whatever its case, else prefix/slug of the value."""
    r = routes.select(F.lower("name").alias("__name"), "folder")
    slug = F.trim(F.regexp_replace(F.lower(field), "[^a-z0-9]+", "-"), F.lit("-"))
    rows = docs.join(r, F.lower(field) == F.col("__name"), "left")
    fallback = F.when(slug != "", F.concat(F.lit(prefix + "/"), slug)).otherwise(F.lit(prefix))
    return rows.withColumn("folder", F.coalesce("folder", fallback)).drop("__name")


def cursors(docs: DataFrame) -> DataFrame:
    return docs.groupBy("connector").agg(F.max("updated").alias("cursor"))


def due(runs: DataFrame, now: Column) -> DataFrame:
    """Connectors whose last run is at least their interval ago, or that never ran."""
    late = F.col("last_run").isNull() | (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_run").cast("timestamp")) >= F.col("interval_s"))
    return runs.where(late)


def version_history(edits: DataFrame, keep: int = 25) -> DataFrame:
    """(path, at, hash, version): snapshots that differ from the one before, the newest ``keep`` per path, newest first."""
    w = Window.partitionBy("path").orderBy("at", "seq")
    changed = edits.withColumn("before", F.lag("hash").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("hash")))
    version = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("at"), F.desc("seq")))
    return changed.withColumn("version", version).where(F.col("version") <= keep).drop("before")


def manifest_diff(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, action): in_sync, merge (both differ, mergeable), push or pull by newer mtime or absence."""
    a = ours.select("path", F.col("hash").alias("a_hash"), F.col("mtime").alias("a_mtime"))
    b = theirs.select("path", F.col("hash").alias("b_hash"), F.col("mtime").alias("b_mtime"))
    action = (
        F.when(F.col("b_hash").isNull(), "push")
        .when(F.col("a_hash").isNull(), "pull")
        .when(F.col("a_hash") == F.col("b_hash"), "in_sync")
        .when(F.col("path").rlike(MERGEABLE), "merge")
        .when(F.col("a_mtime") >= F.col("b_mtime"), "push")
        .otherwise("pull")
    )
    return a.join(b, "path", "full").select("path", action.alias("action"))


def apply_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, status, final_path, hash) for changes (path, base_hash, hash, deleted) against the current hashes.

    ok and deleted need the base hash to match; a change on another base becomes a conflict copy; a
    deletion on another base keeps the file.
    """
    c = current.select("path", F.col("hash").alias("now_hash"))
    status = (
        F.when(F.col("now_hash").isNull() & F.col("deleted"), "gone")
        .when(F.col("now_hash").isNull(), "created")
        .when(F.col("now_hash") == F.col("base_hash"), F.when(F.col("deleted"), "deleted").otherwise("ok"))
        .when(F.col("deleted"), "conflict-keep")
        .when(F.col("now_hash") == F.col("hash"), "ok")
        .otherwise("conflict")
    )
    rows = changes.join(c, "path", "left").withColumn("status", status)
    nth = F.row_number().over(Window.partitionBy("path", "status").orderBy("hash"))
    stem, end = F.regexp_replace("path", r"\.md$", ""), F.lit(".md")
    copy = F.concat(stem, F.lit(".conflict"), F.when(nth > 1, F.concat(F.lit("-"), nth.cast("string"))).otherwise(F.lit("")), end)
    return rows.select("path", "status", F.when(F.col("status") == "conflict", copy).otherwise(F.col("path")).alias("final_path"), "hash")


def crdt_merge(atoms: DataFrame, tombs: DataFrame) -> DataFrame:
    """(doc, text, atoms): the union of all replicas' atoms less all tombstones, in (key, site, clock) order.

    Any order and repetition of replicas gives the same text.
    """
    # a document's atoms and tombstones come to one task once, and tasks stay small however many atoms there are
    held = atoms.select("doc", "site", "clock", F.struct("key", "ch").alias("atom"), F.lit(False).alias("dead"))
    gone = tombs.select("doc", "site", "clock", F.lit(None).cast(held.schema["atom"].dataType).alias("atom"), F.lit(True).alias("dead"))
    parts = max(atoms.sparkSession.sparkContext.defaultParallelism, -(-(atoms.count() + tombs.count()) // MERGED_ATOMS))
    met = held.unionByName(gone).repartition(parts, "doc").groupBy("doc", "site", "clock")
    alive = met.agg(F.max("dead").alias("dead"), F.first("atom", ignorenulls=True).alias("atom")).where("not dead")
    ordered = F.sort_array(F.collect_list(F.struct("atom.key", "site", "clock", "atom.ch")))
    return alive.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda a: a["ch"]), "").alias("text"), F.count("*").alias("atoms"))


def rename_tag(body: Column, old: str, new: str) -> Column:
    """Inline ``#old`` as a whole tag, and the name in the frontmatter's tag list."""
    inline = F.regexp_replace(body, rf"(^|\s)#{old}(?=$|[^\w/-])", f"$1#{new}")
    return F.regexp_replace(inline, rf"(?m)^(tags: \[(?:[^\]]*, )?){old}((?:, [^\]]*)?\])$", f"$1{new}$2")


def set_fact(body: Column, key: str, value: Column) -> Column:
    """The first ``key:: …`` line gets the value; without one it is added at the end."""
    has = body.rlike(rf"(?m)^{key}:: .*$")
    head = F.regexp_extract(body, rf"(?s)\A(.*?)(?:\A|(?<=\n)){key}:: ", 1)
    tail = F.regexp_extract(body, rf"(?s)(?:\A|\n){key}:: [^\n]*(.*)\z", 1)
    return F.when(has, F.concat(head, F.lit(f"{key}:: "), value, tail)).otherwise(F.concat(F.regexp_replace(body, r"\n+\z", ""), F.lit(f"\n{key}:: "), value, F.lit("\n")))


def link_first_mention(text: Column, name: Column) -> Column:
    """The first occurrence of a name, whatever its case, in double brackets."""
    at = F.instr(F.lower(text), F.lower(name))
    found = F.substring(text, at, F.length(name))
    linked = F.concat(F.substring(text, F.lit(1), at - 1), F.lit("[["), found, F.lit("]]"), F.substring(text, at + F.length(name), F.length(text)))
    return F.when(at > 0, linked).otherwise(text)


def rename_notes(tables: dict[str, DataFrame], moves: DataFrame) -> dict[str, DataFrame]:
    """Every table with its path columns (path, note, src, dst) moved along (old, new)."""
    out = {}
    for name, df in tables.items():
        for c in [c for c in ("path", "note", "src", "dst") if c in df.columns]:
            m = moves.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
            df = df.join(m, df[c] == m["__old"], "left").withColumn(c, F.coalesce("__new", c)).drop("__old", "__new")
        out[name] = df
    return out


def restore(trash: DataFrame, current: DataFrame) -> DataFrame:
    """(id, path): trashed notes back at their path, or at ``path-1``, ``-2`` … where it is taken."""
    taken = current.select("path", F.lit(1).alias("taken"))
    nth = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("deleted_at"), "id")) - 1
    rows = trash.join(taken, "path", "left").withColumn("n", nth + F.coalesce("taken", F.lit(0)))
    moved = F.concat(F.regexp_replace("path", r"\.md$", ""), F.lit("-"), F.col("n").cast("string"), F.lit(".md"))
    return rows.select("id", F.when(F.col("n") > 0, moved).otherwise(F.col("path")).alias("path"))


def daily_notes(captures: DataFrame) -> DataFrame:
    """(path, links, body): a day's note lists its captures in order of time."""
    line = F.struct("at", "id", F.concat(F.lit("- [["), "path", F.lit("]]")).alias("l"))
    return captures.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("links"), F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["l"]), "\n").alias("body")
    ).select(F.concat(F.lit("daily/"), "day", F.lit(".md")).alias("path"), "links", "body")


def timeline(feeds: dict[str, DataFrame], kinds: list[str] | None, n: int) -> DataFrame:
    """(kind, at, subject): the newest ``n`` entries of several feeds."""
    parts = None
    for kind, feed in feeds.items():
        if kinds and kind not in kinds:
            continue
        one = feed.select(F.lit(kind).alias("kind"), "at", "subject")
        parts = one if parts is None else parts.unionByName(one)
    return parts.orderBy(F.desc("at"), "kind", "subject").limit(n)


def streaks(days: DataFrame, by: str) -> DataFrame:
    """(by, first, last, length): runs of consecutive days, by gaps and islands."""
    n = F.row_number().over(Window.partitionBy(by).orderBy("day"))
    islands = days.select(by, "day").distinct().withColumn("island", F.date_sub("day", n))
    return islands.groupBy(by, "island").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("length")).drop("island")


def calendar(days: DataFrame, first: str, weeks: int = 12) -> DataFrame:
    """(day, n): every day of ``weeks`` weeks with its count, absent days as 0."""
    spark = days.sparkSession
    span = spark.range(weeks * 7).select(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")).alias("day"))
    return span.join(days.groupBy("day").agg(F.count("*").alias("n")), "day", "left").na.fill(0, ["n"])
