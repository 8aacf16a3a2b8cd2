"""Tables out of note bodies: frontmatter, titles, links, tags, facts, blocks, statements, values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.functions.statements import attribute, is_negation, values  # noqa: F401
from notelake.functions.text import content_id, normal, tokens, without_code

LINK = r"\[\[([^\]\[|#^]+)(?:[#^][^\]\[|]*)?(?:\|([^\]\[]+))?\]\]"
HEAD = r"(?s)\A---\n(.*?)\n---\n"


# -- frontmatter, title, body

def frontmatter_text(body: Column) -> Column:
    return F.regexp_extract(body, HEAD, 1)


def bare_body(body: Column) -> Column:
    return F.regexp_replace(body, HEAD, "")


def frontmatter(body: Column) -> Column:
    """Flat ``key: value`` lines as a map; of a repeated key the first stays; lists keep their brackets."""
    lines = F.filter(F.split(frontmatter_text(body), "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    entries = F.transform(
        lines,
        lambda x: F.struct(
            F.regexp_extract(x, r"^([^:]+):", 1).alias("key"), F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)).alias("value")
        ),
    )
    firsts = F.filter(
        F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))),
        lambda e: ~F.exists(F.slice(entries, F.lit(1), e["i"]), lambda o: o["key"] == e["key"]),
    )
    return F.map_from_arrays(F.transform(firsts, lambda e: e["key"]), F.transform(firsts, lambda e: e["value"]))


def list_value(value: Column) -> Column:
    """``[a, b]`` as an array; a bare value as one element; empty as none."""
    inner = F.regexp_replace(value, r"^\[|\]$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")


def derived_title(body: Column, stem: Column) -> Column:
    """Frontmatter title, else the first level-one heading, else the file's stem."""
    named = F.nullif(F.element_at(frontmatter(body), F.lit("title")), F.lit(""))
    heading = F.nullif(F.trim(F.regexp_extract(bare_body(body), r"(?m)^# +(.+)$", 1)), F.lit(""))
    return F.coalesce(named, heading, stem)


# -- links, tags, facts

def links(notes: DataFrame) -> DataFrame:
    """(src, target, alias) outside code; a target counts once per note whatever its case, first alias kept."""
    clean = without_code(F.col("body"))
    found = notes.select(
        F.col("path").alias("src"),
        F.posexplode(
            F.arrays_zip(
                F.regexp_extract_all(clean, F.lit(LINK), F.lit(1)).alias("target"),
                F.regexp_extract_all(clean, F.lit(LINK), F.lit(2)).alias("alias"),
            )
        ),
    ).select("src", "pos", F.trim("col.target").alias("target"), F.trim("col.alias").alias("alias"))
    first = F.min_by(F.struct("target", "alias"), "pos").alias("f")
    kept = found.where("target <> ''").groupBy("src", F.lower("target").alias("k")).agg(first, F.min("pos").alias("pos"))
    return kept.select("src", "f.target", F.nullif("f.alias", F.lit("")).alias("alias"), F.col("pos").cast("int").alias("pos"))


def tags(notes: DataFrame) -> DataFrame:
    """(note, tag): inline tags outside code and headings, and the frontmatter's."""
    text = F.regexp_replace(without_code(bare_body(F.col("body"))), r"(?m)^#+ .*$", "")
    inline = F.regexp_extract_all(text, F.lit(r"(?:^|\s)#([A-Za-z][\w/-]*)"), F.lit(1))
    own = list_value(F.coalesce(F.element_at(frontmatter(F.col("body")), F.lit("tags")), F.lit("")))
    return notes.select(F.col("path").alias("note"), F.explode(F.array_union(own, inline)).alias("tag"))


def body_lines(notes: DataFrame, *keep: str) -> DataFrame:
    """(note, line, text, fenced) for each line of the body below the frontmatter."""
    split = notes.select(
        F.col("path").alias("note"), *keep, F.posexplode(F.split(bare_body(F.col("body")), "\n")).alias("line", "text")
    )
    fence = F.col("text").startswith("```").cast("int")
    above = Window.partitionBy("note").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.sum(fence).over(above)
    return split.withColumn("fenced", (opened % 2 == 1) | (fence == 1))


def facts(notes: DataFrame) -> DataFrame:
    """(note, line, key, value) from ``key:: value`` lines outside fences."""
    pattern = r"^([A-Za-z][\w -]*?)::\s+(.+)$"
    found = body_lines(notes).where(~F.col("fenced") & F.col("text").rlike(pattern))
    return found.select(
        "note",
        "line",
        F.regexp_extract("text", pattern, 1).alias("key"),
        F.trim(F.regexp_extract("text", pattern, 2)).alias("value"),
    )


def blocks(notes: DataFrame) -> DataFrame:
    """(note, line, kind, level, text, checked, parent): headings, items and tasks outside fences."""
    heading, task, item = r"^(#{1,6}) +(.+)$", r"^( *)[-*] \[([ xX])\] +(.+)$", r"^( *)[-*] +(.+)$"
    t = F.col("text")
    kind = F.when(t.rlike(heading), "heading").when(t.rlike(task), "task").when(t.rlike(item), "item")
    rows = body_lines(notes).withColumn("kind", kind).where(~F.col("fenced") & F.col("kind").isNotNull())
    rows = rows.withColumn(
        "level",
        F.when(F.col("kind") == "heading", F.length(F.regexp_extract(t, heading, 1)))
        .otherwise(F.floor(F.length(F.regexp_extract(t, item, 1)) / 2))
        .cast("int"),
    ).withColumn(
        "content",
        F.trim(
            F.when(F.col("kind") == "heading", F.regexp_extract(t, heading, 2))
            .when(F.col("kind") == "task", F.regexp_extract(t, task, 3))
            .otherwise(F.regexp_extract(t, item, 2))
        ),
    )
    above = Window.partitionBy("note").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.last(F.when(F.col("kind") == "heading", F.col("content")), ignorenulls=True).over(above)
    return rows.select(
        "note",
        "line",
        "kind",
        "level",
        F.col("content").alias("text"),
        F.when(F.col("kind") == "task", F.lower(F.regexp_extract(t, task, 2)) == "x").alias("checked"),
        parent.alias("parent"),
    )


def board(blocks_df: DataFrame) -> DataFrame:
    """(note, column, cards): items under each level-two heading."""
    columns = blocks_df.where("kind = 'heading' and level = 2").select("note", F.col("text").alias("column")).distinct()
    cards = blocks_df.where("kind <> 'heading'").groupBy("note", F.col("parent").alias("column")).agg(F.count("*").alias("cards"))
    return columns.join(cards, ["note", "column"], "left").na.fill(0, ["cards"])


# -- html

def html_to_markdown(html: Column) -> Column:
    """Headings to ``#``, list items to ``- ``, scripts, styles and tags gone, blank runs squeezed."""
    out = F.regexp_replace(html, r"(?is)<script\b.*?</script>", "")
    out = F.regexp_replace(out, r"(?is)<style\b.*?</style>", "")
    for n in range(1, 7):
        out = F.regexp_replace(out, f"(?i)<h{n}[^>]*>", "\n" + "#" * n + " ")
    out = F.regexp_replace(out, r"(?i)<li[^>]*>", "\n- ")
    out = F.regexp_replace(out, r"(?i)</(h[1-6]|li|p|div|tr|ul|ol)>|<br[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"), F.lit("\n "))


#: Entities that are resolved; the ampersand comes last so that nothing is resolved twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def readable(html: Column, max_chars: int = 4000) -> Column:
    """Main text of a page: furniture gone, one space between words, cut at ``max_chars``."""
    out = html
    for tag in ("script", "style", "nav", "footer", "header", "form", "noscript", "svg"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.left(F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " ")), F.lit(max_chars))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


# -- entities, statements, attributes

#: Capitalised words that open sentences without naming anything.
STARTERS = ("the", "a", "an", "this", "that", "these", "those", "it", "in", "on", "of", "for", "and", "but", "we", "i", "to", "he", "she")


def entities(text: Column) -> Column:
    """Sorted distinct lower-case names: links, code spans, handles, identifiers, acronyms, capitalised runs."""

    def all_of(pattern: str, group: int = 0) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    runs = all_of(r"[A-Z][a-z]+(?: [A-Z][a-z]+)*")
    named = F.array_union(all_of(r"\[\[([^\]\[|]+)", 1), all_of(r"`([^`\n]+)`", 1))
    named = F.array_union(named, all_of(r"[@#]([A-Za-z][\w-]+)", 1))
    named = F.array_union(named, all_of(r"[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)+"))
    named = F.array_union(named, all_of(r"[A-Z]{2,}[0-9]*"))
    lowered = F.transform(F.array_union(named, runs), lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(lowered, lambda x: (F.length(x) > 1) & ~x.isin(*STARTERS))))


def statements(text: Column) -> Column:
    """Sentences and lines without leading dashes and closing dots; empty ones dropped."""
    parts = F.split(text, r"\n+|[.!?] +")
    clean = F.transform(parts, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), "^- +", ""), r"\.+$", "")))
    return F.filter(clean, lambda x: x != "")


def suggested_tags(docs: DataFrame, id_col: str, text_col: str, n: int = 5, least: int = 4) -> DataFrame:
    """(id, tag, n, rank): the most frequent words of at least ``least`` letters, ties by first place."""
    words = F.regexp_extract_all(F.lower(text_col), F.lit(f"[a-z]{{{least},}}"), F.lit(0))
    counted = (
        docs.select(id_col, F.posexplode(words).alias("pos", "tag"))
        .groupBy(id_col, "tag")
        .agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    )
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "pos"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= n).select(id_col, "tag", "n", "rank")


def first_line_title(text: Column, most: int = 80) -> Column:
    """The first line that has something, without heading marks, cut at ``most`` characters."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.left(F.trim(F.regexp_replace(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), "^#+ *", "")), F.lit(most))


# -- memory bullets

BULLET = r"^- (~~)?\[([^\]]+)\] ([^:]+): (.*?)(~~)?(?: <!--m (.*?)-->)?$"


def parse_bullet(line: Column) -> Column:
    """struct(stamp, agent, text, struck, trailer map, id) of ``- [stamp] agent: text <!--m k=v-->``."""
    trailer = F.regexp_extract(line, BULLET, 6)
    pairs = F.str_to_map(F.when(trailer != "", F.trim(trailer)), F.lit(" "), F.lit("="))
    stamp, agent, text = (F.regexp_extract(line, BULLET, i) for i in (2, 3, 4))
    own = F.element_at(pairs, F.lit("id"))
    parsed = F.struct(
        stamp.alias("stamp"),
        agent.alias("agent"),
        F.trim(text).alias("text"),
        (F.regexp_extract(line, BULLET, 1) != "").alias("struck"),
        pairs.alias("trailer"),
        F.coalesce(own, content_id(stamp, agent, text)).alias("id"),
    )
    return F.when(line.rlike(BULLET), parsed)


def format_bullet(stamp: Column, agent: Column, text: Column, struck: Column, id_: Column) -> Column:
    mark = F.when(struck, F.lit("~~")).otherwise(F.lit(""))
    return F.concat(F.lit("- "), mark, F.lit("["), stamp, F.lit("] "), agent, F.lit(": "), text, mark, F.lit(" <!--m id="), id_, F.lit("-->"))


# -- lines and bookmarks

def dedupe_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, removed): later copies of a non-blank line go; bullets count as equal by agent and normalised text."""
    line = F.col("line")
    bullet = r"^- \[[^\]]+\] ([^:]+): (.*)$"
    key = F.when(
        line.rlike(bullet),
        F.concat(F.lit("b:"), F.regexp_extract(line, bullet, 1), F.lit(":"), normal(F.regexp_extract(line, bullet, 2))),
    ).otherwise(F.concat(F.lit("l:"), F.trim(line)))
    rows = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).withColumn("key", key)
    again = F.row_number().over(Window.partitionBy(id_col, "key").orderBy("pos"))
    rows = rows.withColumn("keep", (F.trim("line") == "") | (again == 1))
    kept = F.sort_array(F.collect_list(F.when(F.col("keep"), F.struct("pos", "line"))))
    return rows.groupBy(id_col).agg(
        F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias(text_col),
        F.count_if(~F.col("keep")).alias("removed"),
    )


def bookmarks(notes: DataFrame) -> DataFrame:
    """(note, label, target) from ``- [label](target)`` lines."""
    pattern = r"^- \[([^\]]+)\]\(([^)]+)\)$"
    rows = body_lines(notes).where(F.col("text").rlike(pattern))
    return rows.select(
        "note", "line", F.regexp_extract("text", pattern, 1).alias("label"), F.regexp_extract("text", pattern, 2).alias("target")
    )


def token_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf)."""
    return docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))

