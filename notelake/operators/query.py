"""Validated queries over notes and over the blocks inside notes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_LIMIT = 200
#: Columns that every note can be sorted by; properties of notes are named in ``Spec.sortable``.
NOTE_SORTS = ("path", "title", "created", "updated", "mtime")
OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "contains", "exists", "missing")
FORMULAS = ("days_since", "days_until", "year", "month", "date", "upper", "lower", "length", "default", "concat")
BLOCK_FILTERS = ("kind", "section", "level", "checked", "text", "tag", "path", "linked_to")
NOTE_FILTERS = ("tag", "path", "text", "linked_to", "pinned", "where")


@dataclass(frozen=True)
class Spec:
    """What to look for. Filters that make no sense for the source are an error, not ignored."""

    source: str = "notes"
    filters: dict = field(default_factory=dict)
    sort: str = "path"
    descending: bool = False
    limit: int = 50
    columns: Sequence[str] = ("path", "title")
    formulas: dict[str, tuple] = field(default_factory=dict)
    group: str | None = None
    sortable: Sequence[str] = ()

    def __post_init__(self):
        allowed = {"notes": NOTE_FILTERS, "blocks": BLOCK_FILTERS}.get(self.source)
        if allowed is None:
            raise ValueError(f"unknown source {self.source}")
        unknown = set(self.filters) - set(allowed)
        if unknown:
            raise ValueError(f"{', '.join(sorted(unknown))}: no filter of {self.source}")
        if not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError(f"limit must lie between 1 and {MAX_LIMIT}")
        if self.source == "notes" and self.sort not in (*NOTE_SORTS, *self.sortable):
            raise ValueError(f"cannot sort by {self.sort}")
        for key, op, _ in self.filters.get("where", ()):
            if op not in OPERATORS or not key:
                raise ValueError(f"unknown predicate {key} {op}")
        for name, (function, *_) in self.formulas.items():
            if function not in FORMULAS:
                raise ValueError(f"{name}: unknown function {function}")


def property_predicate(value: Column, op: str, operand=None) -> Column:
    """Of a property's text. Numbers compare as numbers where the operand is one; a missing value only
    fits ``!=`` and ``missing``; text compares without case."""
    if op == "exists":
        return F.coalesce(value, F.lit("")) != ""
    if op == "missing":
        return F.coalesce(value, F.lit("")) == ""
    if op == "contains":
        return F.coalesce(F.contains(F.lower(value), F.lit(str(operand).lower())), F.lit(False))
    try:
        right, left = F.lit(float(operand)), value.try_cast("double")
    except (TypeError, ValueError):
        right, left = F.lit(str(operand).lower()), F.lower(value)
    compared = {
        "=": left == right,
        "!=": (left != right) | left.isNull(),
        ">": left > right,
        ">=": left >= right,
        "<": left < right,
        "<=": left <= right,
    }[op]
    return F.coalesce(compared, F.lit(False))


def properties(names: Sequence[str], map_col: str = "fm") -> list[Column]:
    """Frontmatter keys as columns; lists come comma-joined, without brackets."""
    return [F.regexp_replace(F.element_at(map_col, F.lit(n)), r"^\[|\]$", "").alias(n) for n in names]


def formula(function: str, *args: Column, now: Column) -> Column:
    """A computed column; input that does not fit gives null. ``now`` is a parameter, never the clock."""
    first = args[0]
    hours = lambda a, b: (F.unix_seconds(a.cast("timestamp")) - F.unix_seconds(b.cast("timestamp"))) / 3600
    days = lambda h: F.when(h >= 0, F.floor(h / 24)).otherwise(F.ceil(h / 24)).cast("int")
    made = {
        "days_since": lambda: days(hours(now, first)),
        "days_until": lambda: days(hours(first, now)),
        "year": lambda: F.year(first),
        "month": lambda: F.month(first),
        "date": lambda: F.date_format(first, "yyyy-MM-dd"),
        "upper": lambda: F.upper(first),
        "lower": lambda: F.lower(first),
        "length": lambda: F.char_length(first),
        "default": lambda: F.coalesce(F.nullif(F.trim(first), F.lit("")), args[1]),
        "concat": lambda: F.concat(*[F.coalesce(a.cast("string"), F.lit("")) for a in args]),
    }
    return made[function]()


def query_notes(notes: DataFrame, tags: DataFrame, links: DataFrame, spec: Spec, now: Column | None = None) -> DataFrame:
    """Notes that fit every filter, sorted (ties by path) and limited, with the asked columns and formulas."""
    f, rows = spec.filters, notes
    if "tag" in f:
        rows = rows.join(tags.where(F.lower("tag") == f["tag"].lower()).select(F.col("note").alias("path")), "path", "left_semi")
    if "path" in f:
        rows = rows.where(F.startswith("path", F.lit(f["path"])))
    if "text" in f:
        rows = rows.where(F.contains(F.lower("body"), F.lit(f["text"].lower())))
    if "linked_to" in f:
        rows = rows.join(links.where(F.lower("target") == f["linked_to"].lower()).select(F.col("src").alias("path")), "path", "left_semi")
    if "pinned" in f:
        rows = rows.where(F.col("pinned") == f["pinned"])
    for key, op, operand in f.get("where", ()):
        rows = rows.where(property_predicate(F.element_at("fm", F.lit(key)), op, operand))
    for name, (function, *args) in spec.formulas.items():
        rows = rows.withColumn(name, formula(function, *[F.col(a) if a in rows.columns else F.lit(a) for a in args], now=now))
    by = F.desc_nulls_last(spec.sort) if spec.descending else F.asc_nulls_last(spec.sort)
    return rows.orderBy(by, "path").limit(spec.limit).select(*spec.columns, *spec.formulas)


def query_blocks(blocks: DataFrame, notes: DataFrame, tags: DataFrame, links: DataFrame, spec: Spec) -> DataFrame:
    """Blocks that fit every filter in (note, line) order, with their note's title."""
    f, rows = spec.filters, blocks
    for name, column in (("kind", "kind"), ("level", "level"), ("checked", "checked")):
        if name in f:
            rows = rows.where(F.col(column) == f[name])
    if "section" in f:
        rows = rows.where(F.lower("parent") == f["section"].lower())
    if "text" in f:
        rows = rows.where(F.contains(F.lower("text"), F.lit(f["text"].lower())))
    if "path" in f:
        rows = rows.where(F.startswith("note", F.lit(f["path"])))
    if "tag" in f:
        rows = rows.join(tags.where(F.lower("tag") == f["tag"].lower()).select("note"), "note", "left_semi")
    if "linked_to" in f:
        rows = rows.join(links.where(F.lower("target") == f["linked_to"].lower()).select(F.col("src").alias("note")), "note", "left_semi")
    titles = notes.select(F.col("path").alias("note"), "title")
    return rows.join(titles, "note", "left").orderBy("note", "line").limit(spec.limit)


def group_rows(rows: DataFrame, by: str, order: Sequence[str], item: str) -> DataFrame:
    """(bucket, n, items, place): a bucket per value in order of arrival, the empty one last."""
    seen = rows.select(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("bucket"), F.struct(*order).alias("at"), F.col(item).alias("item"))
    grouped = seen.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("at").alias("first"), F.sort_array(F.collect_list(F.struct("at", "item"))).alias("l")
    )
    place = F.row_number().over(Window.orderBy(F.col("bucket") == "", "first"))  # a row per bucket
    return grouped.select("bucket", "n", F.transform("l", lambda x: x["item"]).alias("items"), place.alias("place"))


# -- visibility

def visible_to(rows: DataFrame, principals: DataFrame, space: str = "space", readers: str | None = None, private: str = "private", untrusted: str | None = None) -> DataFrame:
    """Each row once per principal that may read it.

    ``principals``: user, spaces (null = all, empty = none), include_private, trusted_only. A row's
    reader list, where it has one, narrows access. All are equi-joins whose pairs are results: rows with a
    reader list meet the readers on it, others the principals of their space, or those of all spaces by what they may read.
    """
    flags = F.struct(F.col(private).alias("private"), (F.col(untrusted) if untrusted else F.lit(False)).alias("untrusted"))
    r = rows.withColumn("__flags", flags)
    p = principals.select(
        F.col("user").alias("__user"), F.array_distinct("spaces").alias("__spaces"), F.col("include_private").alias("__all"), F.col("trusted_only").alias("__trusted")
    )
    named = F.size(readers) > 0 if readers else F.lit(False)
    fits = (F.col("__all") | ~F.col("__flags.private")) & (~F.col("__trusted") | ~F.col("__flags.untrusted"))
    columns = [*rows.columns, F.col("__user").alias("user")]
    open_ = r.where(~named)
    by_space = open_.join(p.where("__spaces is not null").withColumn("__space", F.explode("__spaces")), F.col(space) == F.col("__space")).where(fits).select(*columns)
    # those of all spaces stand under each pair of flags that they may read
    pairs = F.array(*[F.struct(F.lit(a).alias("private"), F.lit(b).alias("untrusted")) for a in (False, True) for b in (False, True)])
    told = p.where("__spaces is null").withColumn("__key", F.explode(pairs))
    told = told.where((F.col("__all") | ~F.col("__key.private")) & (~F.col("__trusted") | ~F.col("__key.untrusted")))
    seen = by_space.unionByName(open_.join(told, F.col("__flags") == F.col("__key")).select(*columns))
    if not readers:
        return seen
    listed = r.where(named).withColumn("__reader", F.explode(F.array_distinct(readers)))
    inside = F.col("__spaces").isNull() | F.array_contains("__spaces", F.col(space))
    return seen.unionByName(listed.join(p, F.col("__reader") == F.col("__user")).where(inside & fits).select(*columns))


def context_fits(chunks: DataFrame, by: str, text: str, budget: int) -> DataFrame:
    """(by, bytes, fits): whether a principal's whole corpus stays within ``budget`` bytes."""
    total = chunks.groupBy(by).agg(F.sum(F.octet_length(text)).alias("bytes"))
    return total.withColumn("fits", F.col("bytes") <= budget)


def autocomplete(notes: DataFrame, probes: DataFrame, n: int = 10) -> DataFrame:
    """(probe, path, title, rank): titles that hold the probe, those that start with it first.

    A probe meets only titles that share a trigram with it, not every title; probes are at least three long.
    """
    low = F.lower("title")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))
    titled = notes.select("path", "title", F.explode(grams).alias("gram"))
    asked = probes.select("probe", F.left(F.lower("probe"), F.lit(3)).alias("gram"))
    hits = titled.join(asked, "gram").where(F.contains(low, F.lower("probe")))
    order = Window.partitionBy("probe").orderBy(F.desc(F.startswith(low, F.lower("probe"))), "title", "path")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("probe", "path", "title", "rank")
