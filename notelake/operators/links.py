"""Links between notes, tenancy by path prefix, provenance and the entity graph."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.functions.text import normal
from notelake.sources.notes import kept, shared_folder


def link_keys(notes: DataFrame) -> DataFrame:
    """(key, tier, dst): what a link may be called, one winner per key and tier.

    Tiers: title, path with or without its suffix, stem, alias. Of equal titles the last note by
    path wins, of equal other keys the first.
    """
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    bare = F.regexp_replace("path", r"\.md$", "")

    def keyed(column: Column, tier: int) -> DataFrame:
        return notes.select(F.lower(column).alias("key"), F.lit(tier).alias("tier"), F.col("path").alias("dst"))

    alias = F.explode(F.array("alias")) if dict(notes.dtypes).get("alias") == "string" else F.explode("aliases")
    keys = keyed(F.col("title"), 0).unionByName(keyed(F.col("path"), 1)).unionByName(keyed(bare, 1)).unionByName(keyed(stem, 2))
    aliases = notes.select(alias.alias("a"), "path").select(F.lower("a").alias("key"), F.lit(3).alias("tier"), F.col("path").alias("dst"))
    every = keys.unionByName(aliases).where("key <> ''")
    return every.groupBy("key", "tier").agg(F.when(F.col("tier") == 0, F.max("dst")).otherwise(F.min("dst")).alias("dst"))


def resolve(links: DataFrame, notes: DataFrame) -> DataFrame:
    """``links`` with dst, null where no note answers to the target."""
    best = link_keys(notes).groupBy("key").agg(F.min_by("dst", "tier").alias("dst"))
    return links.join(best, F.lower("target") == best["key"], "left").drop("key")


def re_resolve(resolved: DataFrame, fresh: DataFrame, notes: DataFrame, changed: DataFrame) -> DataFrame:
    """All links after some notes changed: only links from a changed note, or to a changed key, are looked up again.

    ``resolved``: links before, with dst; ``fresh``: links of the changed notes; ``changed``: (path, key) of
    every old and new key of a changed note.
    """
    paths = changed.select("path").distinct()
    keys = changed.select("key").distinct()
    stale = resolved.join(paths, resolved["src"] == paths["path"], "left_anti")
    touched = stale.join(keys, F.lower(stale["target"]) == keys["key"], "left_semi")
    same = stale.join(keys, F.lower(stale["target"]) == keys["key"], "left_anti")
    return same.unionByName(resolve(touched.drop("dst").unionByName(fresh), notes))


def backlinks(resolved: DataFrame, notes: DataFrame) -> DataFrame:
    """(dst, src, title) of every linking note, once."""
    titles = notes.select(F.col("path").alias("src"), "title")
    return resolved.where("dst is not null and dst <> src").select("dst", "src").distinct().join(titles, "src").select("dst", "src", "title")


def graph_edges(resolved: DataFrame, visible: DataFrame) -> DataFrame:
    """(src, dst) where both ends are visible."""
    seen = visible.select(F.col("path").alias("p")).distinct()
    edges = resolved.where("dst is not null").select("src", "dst").distinct()
    return edges.join(seen, edges["src"] == seen["p"], "left_semi").join(seen, edges["dst"] == seen["p"], "left_semi")


def dangling(resolved: DataFrame, n: int = 200) -> DataFrame:
    """(target, n): the most wanted targets that no note answers to."""
    wanted = resolved.where("dst is null").groupBy(F.lower("target").alias("target")).agg(F.count("*").alias("n"))
    return wanted.orderBy(F.desc("n"), "target").limit(n)


def mentions(docs: DataFrame, names: DataFrame, linked: DataFrame, least: int = 3) -> DataFrame:
    """(name, doc, line): texts that hold a note's name as whole words without linking to it.

    Names of one word meet the texts' words in an equi-join. A longer name meets a text where the
    rarest of its words among the names' words stands in a line, and is looked up there at its place;
    no name is searched in every text, and texts are read once whatever the lengths of the names.
    ``docs``: (doc, body); ``names``: (name, dst); ``linked``: (doc, dst).
    """
    keyed = names.select("name", "dst", normal(F.col("name")).alias("key")).where(F.length("key") >= least)
    keyed = keyed.withColumn("k", F.split("key", " "))
    lines = docs.select("doc", F.posexplode(F.split("body", "\n")).alias("line", "text")).select("doc", "line", normal(F.col("text")).alias("t"))
    spoken = lines.select("doc", "line", F.explode(F.array_distinct(F.split("t", " "))).alias("word"))
    single = keyed.where("size(k) = 1").select("name", "dst", F.col("key").alias("word"))
    found = spoken.join(single, "word").select("name", "dst", "doc", "line")
    words = keyed.where("size(k) > 1").select("name", "dst", "key", F.explode(F.array_distinct("k")).alias("word"))
    # a name is filed under its word that the fewest lines hold
    held = spoken.join(words.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    filed = words.join(held, "word").groupBy("name", "dst", "key").agg(F.min_by("word", F.struct("n", "word")).alias("word"), F.count("*").alias("known"))
    filed = filed.where(F.col("known") == F.size(F.array_distinct(F.split("key", " ")))).drop("known")
    space = F.lit(" ")
    near = spoken.join(filed, "word").join(lines, ["doc", "line"])
    runs = near.where(F.contains(F.concat(space, "t", space), F.concat(space, "key", space))).select("name", "dst", "doc", "line")
    first = found.unionByName(runs).groupBy("name", "dst", "doc").agg(F.min("line").alias("line")).where("doc <> dst")
    return first.join(linked, ["doc", "dst"], "left_anti").select("name", "doc", "line")


# -- tenancy

def prefixes(path: Column) -> Column:
    """``a/b/c.md`` -> ["", "a/", "a/b/"]."""
    parts = F.split(path, "/")
    upto = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    return F.when(F.size(parts) > 1, F.concat(F.array(F.lit("")), upto)).otherwise(F.array(F.lit("")))


def assign_spaces(paths: DataFrame, spaces: DataFrame, default: str = "commons") -> DataFrame:
    """(path, space): the space with the longest prefix of the path."""
    split = paths.select("path", F.explode(prefixes(F.col("path"))).alias("prefix"))
    best = split.join(spaces, "prefix").groupBy("path").agg(F.max_by("id", F.length("prefix")).alias("space"))
    return paths.select("path").distinct().join(best, "path", "left").withColumn("space", F.coalesce("space", F.lit(default)))


def principals(members: DataFrame, admins: DataFrame) -> DataFrame:
    """(user, spaces): readable spaces, null for admins, who read all."""
    own = members.groupBy("user").agg(F.sort_array(F.collect_set("space")).alias("spaces"))
    flagged = own.join(admins.select("user", F.lit(True).alias("admin")), "user", "full")
    return flagged.select("user", F.when(F.col("admin").isNull(), F.col("spaces")).alias("spaces"))


def map_readers(docs: DataFrame, identities: DataFrame) -> DataFrame:
    """(doc, users, unmapped): outside readers as accounts; a document that nobody known may read is dropped."""
    spread = docs.select("doc", "source", F.explode("readers").alias("external"))
    known = spread.join(identities, ["source", "external"], "left")
    return known.groupBy("doc").agg(
        F.sort_array(F.collect_set("user")).alias("users"), F.count_if(F.col("user").isNull()).alias("unmapped")
    ).where("size(users) > 0")


# -- provenance

URL = r"https?://[^\s\"'<>)\]]+"


def url_key(url: Column) -> Column:
    """A url without query, fragment and closing slash, host lower-cased."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")
    host = F.lower(F.regexp_extract(bare, r"^https?://[^/]*", 0))
    return F.concat(host, F.regexp_replace(bare, r"^https?://[^/]*", ""))


def provenance(targets: DataFrame, bodies: DataFrame) -> DataFrame:
    """(target, named_untrusted, named_trusted, allowed): refused when only untrusted bodies name it.

    ``bodies``: (body, untrusted). Urls are taken out of the bodies once and meet the targets in an equi-join.
    """
    urls = bodies.select(F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(URL), F.lit(0)))).alias("u"), "untrusted")
    named = urls.groupBy(url_key(F.col("u")).alias("k")).agg(
        F.max("untrusted").alias("named_untrusted"), F.max(~F.col("untrusted")).alias("named_trusted")
    )
    rows = targets.join(named, url_key(F.col("target")) == named["k"], "left").na.fill(False, ["named_untrusted", "named_trusted"])
    return rows.select("target", "named_untrusted", "named_trusted", (~F.col("named_untrusted") | F.col("named_trusted")).alias("allowed"))


# -- entity graph

def co_mentions(mentioned: DataFrame) -> DataFrame:
    """(a, b, facts): entity pairs, a < b, with the number of facts that name both."""
    left = mentioned.select("fact", F.col("entity").alias("a"))
    right = mentioned.select("fact", F.col("entity").alias("b"))
    return left.join(right, "fact").where("a < b").groupBy("a", "b").agg(F.count_distinct("fact").alias("facts"))


def neighbourhood(mentioned: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, entity, depth): entities within ``hops`` co-mentions of each seed, at most 4.

    A hop goes entity -> facts -> entities over the two-column table, so no pair table is made.
    Each hop is written to the shared folder.
    """
    if not 1 <= hops <= 4:
        raise ValueError("hops must lie between 1 and 4")
    spark = mentioned.sparkSession
    pairs = mentioned.select("fact", "entity").distinct()
    reached = seeds.select("seed", F.col("seed").alias("entity"), F.lit(0).alias("depth"))
    frontier = reached
    for d in range(1, hops + 1):
        facts = frontier.join(pairs, "entity").select("seed", "fact").distinct()
        found = facts.join(pairs, "fact").select("seed", "entity").distinct()
        fresh = found.join(reached, ["seed", "entity"], "left_anti").withColumn("depth", F.lit(d))
        path = f"{shared_folder(spark)}/hop-{uuid.uuid4().hex}"
        fresh.write.parquet(path)
        frontier = spark.read.schema(fresh.schema).parquet(path)
        reached = reached.unionByName(frontier)
    return reached


#: Bytes from which on a seed may be a part of an entity's name.
PARTIAL = 3


def resolve_seeds(mentioned: DataFrame, seeds: DataFrame) -> DataFrame:
    """(asked, seed) of (asked): the entity of that name, else the shortest one that contains it (of equals the first), else what was asked.

    Entities stand under their trigrams. A seed looks under the one of its trigrams that the fewest entities have, so frequent trigrams fetch nothing.
    """
    asked = seeds.select("asked", F.lower(F.trim("asked")).alias("name")).distinct()
    names = mentioned.select("entity").distinct()
    exact = asked.join(names, F.col("name") == F.col("entity"), "left_semi")
    part = asked.join(exact.select("asked"), "asked", "left_anti").where(F.octet_length("name") >= PARTIAL)
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    under = names.select("entity", F.explode(grams(F.col("entity"))).alias("gram"))
    wanted = part.select("asked", "name", F.explode(grams(F.col("name"))).alias("gram"))
    frequent = under.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # a trigram that no entity has means that none contains the seed
    rarest = wanted.join(frequent, "gram", "left").groupBy("asked", "name").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    # a seed shorter than three characters, of three bytes or more, is a trigram of names as short as itself alone, so it reads all names
    short = part.where(F.length("name") < 3)
    holds = rarest.where(F.length("name") >= 3).join(under, "gram").where(F.contains("entity", F.col("name"))).select("asked", "entity")
    pairs = F.explode(F.transform(F.sequence(F.lit(1), F.length("entity")), lambda i: F.substring("entity", i, F.lit(2))))
    singles = F.explode(F.transform(F.sequence(F.lit(1), F.length("entity")), lambda i: F.substring("entity", i, F.lit(1))))
    within = names.select("entity", pairs.alias("name")).unionByName(names.select("entity", singles.alias("name")))
    holds = holds.unionByName(short.join(within, "name").select("asked", "entity").distinct())
    best = holds.groupBy("asked").agg(F.min_by("entity", F.struct(F.octet_length("entity"), "entity")).alias("seed"))
    return asked.join(best, "asked", "left").select("asked", F.coalesce("seed", "name").alias("seed"))


def entity_graph(mentioned: DataFrame, seeds: DataFrame, hops: int = 1, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """What lies around each asked seed: nodes (asked, entity, depth, facts, place) and edges (asked, a, b, facts).

    ``mentioned``: (fact, entity); ``seeds``: (asked), names or parts of names. A node's facts are how many name it; nodes are ordered by depth, then
    by falling facts, then by name, and the first ``limit`` stay. An edge holds the ids, sorted, of the facts that name both of its ends, of which one is nearer
    than ``hops``; edges to nodes that do not stay are left out. Each hop is written to the shared folder.
    """
    if not 1 <= hops <= 4:
        raise ValueError("hops must lie between 1 and 4")
    pairs = kept(mentioned.select("fact", "entity").distinct(), "mentions")
    degree = pairs.groupBy("entity").agg(F.count("*").alias("facts"))
    start = kept(resolve_seeds(pairs, seeds), "seeds")
    reached = start.select("asked", F.col("seed").alias("entity"), F.lit(0).alias("depth"))
    frontier, met = reached, None
    for d in range(1, hops + 1):
        others = pairs.withColumnRenamed("entity", "other")
        found = kept(frontier.select("asked", "entity").join(pairs, "entity").join(others, "fact").where("other <> entity").select("asked", "entity", "other", "fact"), "hop")
        met = found if met is None else met.unionByName(found)
        fresh = found.select("asked", F.col("other").alias("entity")).distinct().join(reached, ["asked", "entity"], "left_anti").withColumn("depth", F.lit(d))
        frontier = kept(fresh, "frontier")
        reached = reached.unionByName(frontier)
    order = F.row_number().over(Window.partitionBy("asked").orderBy("depth", F.desc("facts"), "entity"))
    nodes = reached.join(degree, "entity", "left").na.fill(0, ["facts"]).withColumn("place", order).where(F.col("place") <= limit)
    nodes = kept(nodes.select("asked", "entity", "depth", "facts", "place"), "nodes")
    stays = nodes.select("asked", F.col("entity").alias("end"))
    edges = met.select("asked", F.least("entity", "other").alias("a"), F.greatest("entity", "other").alias("b"), "fact")
    for end in ("a", "b"):
        edges = edges.join(stays.withColumnRenamed("end", end), ["asked", end], "left_semi")
    return nodes, edges.groupBy("asked", "a", "b").agg(F.sort_array(F.collect_set("fact")).alias("facts"))


def busiest(mentioned: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """The ``n`` entities in most facts, as (entity, facts), and the co-mentions among them."""
    top = mentioned.groupBy("entity").agg(F.count_distinct("fact").alias("facts")).orderBy(F.desc("facts"), "entity").limit(n)
    kept = mentioned.join(top.select("entity"), "entity", "left_semi")
    return top, co_mentions(kept)


def chains(facts: DataFrame) -> DataFrame:
    """(id, last, length): where each fact's line of supersession ends, by pointer doubling.

    Rounds grow with the logarithm of the longest line. A pointer to an id that is no fact ends the line
    there. Facts that supersede each other in a circle have no end; they, and what leads to them, are an error.
    """
    spark = facts.sparkSession
    step = facts.select("id", F.col("superseded_by").alias("last"), F.when(F.col("superseded_by").isNull(), 0).otherwise(1).cast("long").alias("length"))
    step = step.withColumn("last", F.coalesce("last", "id"))
    most = facts.count()
    total = None
    while True:
        nxt = step.select(F.col("id").alias("n_id"), F.col("last").alias("n_last"), F.col("length").alias("n_length"))
        joined = step.join(nxt, step["last"] == nxt["n_id"], "left")
        following = joined.select("id", F.coalesce("n_last", "last").alias("last"), (F.col("length") + F.coalesce("n_length", F.lit(0))).alias("length"))
        path = f"{shared_folder(spark)}/chain-{uuid.uuid4().hex}"
        following.write.parquet(path)
        step = spark.read.schema(following.schema).parquet(path)
        longest, now = step.agg(F.max("length"), F.sum("length")).first()
        if (longest or 0) > most:
            raise ValueError("facts supersede each other in a circle")
        if now == total:
            return step
        total = now
