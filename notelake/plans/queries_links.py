"""Queries of the typed-query, visibility, link and graph families."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators import extract as X
from notelake.operators import links as L
from notelake.operators import query as Q
from notelake.plans.extraction import BLOCKS, FACT_LINES, FM, LINKS, NORMAL, TAGS, lines_of
from notelake.plans.inputs import FACTS, NOTES, memory, notes
from notelake.plans.registry import query, table

NOW = "1999-06-01 12:00:00"


def _notes_fm(spark, sf):
    return notes(spark, sf).withColumn("fm", X.frontmatter(F.col("body")))


def _now():
    return F.expr(f"timestamp_ntz '{NOW}'")


# -- typed queries

@query(
    f"""WITH {NOTES}, {TAGS}, f AS (SELECT *, regexp_extract({FM}, '(?m)^balance: (.*)$', 1) AS b FROM notes)
    SELECT path, title FROM f WHERE starts_with(path, 'asia/') AND path IN (SELECT note FROM tags WHERE lower(tag) = 'building')
      AND try_cast(b AS DOUBLE) > 1000 ORDER BY path LIMIT 200"""
)
def c1_note_query(spark, sf):
    n = _notes_fm(spark, sf)
    spec = Q.Spec(filters={"path": "asia/", "tag": "building", "where": [("balance", ">", 1000)]}, limit=200)
    return Q.query_notes(n, X.tags(n), X.links(n), spec)


@query(
    f"""WITH {NOTES}, {LINKS} SELECT path, title FROM notes WHERE path IN (SELECT src FROM links WHERE lower(target) = 'missing-7') AND contains(lower(body), 'urgent')
    ORDER BY updated DESC NULLS LAST, path LIMIT 50"""
)
def c1_note_query_linked(spark, sf):
    n = _notes_fm(spark, sf)
    spec = Q.Spec(filters={"linked_to": "Missing-7", "text": "URGENT"}, sort="updated", descending=True)
    return Q.query_notes(n, X.tags(n), X.links(n), spec)


@query(
    f"""WITH {NOTES}, {lines_of('notes')}, {BLOCKS}
    SELECT note, line::INT AS line, kind, level, b.text, checked, parent, title FROM blocks b JOIN notes n ON n.path = note
    WHERE kind = 'task' AND NOT checked AND lower(parent) = 'orders' AND contains(lower(b.text), 'urgent') AND starts_with(note, 'europe/') ORDER BY note, line LIMIT 200"""
)
def c2_block_query(spark, sf):
    n = notes(spark, sf)
    spec = Q.Spec("blocks", {"kind": "task", "checked": False, "section": "Orders", "text": "urgent", "path": "europe/"}, limit=200)
    return Q.query_blocks(X.blocks(n), n, X.tags(n), X.links(n), spec)


@query(
    """WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
    SELECT event_id, coalesce(try_cast(k AS DOUBLE) > 50, false) AS over, coalesce(try_cast(k AS DOUBLE) <> 7, true) AS not_seven,
           coalesce(contains(k, '1'), false) AS has_one, coalesce(k, '') = '' AS missing FROM e"""
)
def c4_property_predicate(spark, sf):
    k = F.get_json_object("props", "$.k")
    p = Q.property_predicate
    return table(spark, sf, "events").select(
        "event_id", p(k, ">", 50).alias("over"), p(k, "!=", 7).alias("not_seven"), p(k, "contains", "1").alias("has_one"), p(k, "missing").alias("missing")
    )


@query(f"WITH {NOTES} SELECT path, regexp_extract({FM}, '(?m)^tags: \\[(.*)\\]$', 1) AS tags, regexp_extract({FM}, '(?m)^segment: (.*)$', 1) AS segment FROM notes")
def c5_property_columns(spark, sf):
    return _notes_fm(spark, sf).select("path", *Q.properties(("tags", "segment")))


@query(
    f"""SELECT o_orderkey, trunc(date_diff('second', o_orderdate, TIMESTAMP '{NOW}') / 3600 / 24)::INT AS age, trunc(date_diff('second', TIMESTAMP '{NOW}', o_orderdate) / 3600 / 24)::INT AS left_,
    year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, strftime(o_orderdate, '%Y-%m-%d') AS d, upper(o_orderpriority) AS u, lower(o_orderpriority) AS l,
    length(o_orderpriority)::INT AS n, CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE o_orderstatus END AS s, o_orderstatus || '/' || o_orderpriority AS c FROM orders"""
)
def c6_formulas(spark, sf):
    o, now = table(spark, sf, "orders"), _now()
    f = lambda name, *a: Q.formula(name, *a, now=now)
    status = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).otherwise(F.lit(" "))
    p, d = F.col("o_orderpriority"), F.col("o_orderdate")
    return o.select(
        "o_orderkey", f("days_since", d).alias("age"), f("days_until", d).alias("left_"), f("year", d).alias("y"), f("month", d).alias("m"), f("date", d).alias("d"),
        f("upper", p).alias("u"), f("lower", p).alias("l"), f("length", p).alias("n"), f("default", status, F.lit("none")).alias("s"),
        f("concat", F.col("o_orderstatus"), F.lit("/"), p).alias("c"),
    )


@query(
    """WITH b AS (SELECT CASE WHEN p_size % 7 = 0 THEN '' ELSE p_type END AS bucket, p_partkey FROM part),
    g AS (SELECT bucket, count(*) AS n, min(p_partkey) AS first, md5(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey)) AS items_md5 FROM b GROUP BY bucket)
    SELECT bucket, n, items_md5, (row_number() OVER (ORDER BY bucket = '', first))::INT AS place FROM g"""
)
def c7_group_rows(spark, sf):
    p = table(spark, sf, "part").withColumn("bucket", F.when(F.col("p_size") % 7 != 0, F.col("p_type")))
    g = Q.group_rows(p, "bucket", ["p_partkey"], "p_partkey")
    return g.select("bucket", "n", F.md5(F.array_join(F.transform("items", lambda x: x.cast("string")), ",")).alias("items_md5"), "place")


@query(
    f"""WITH {NOTES}, {TAGS}, t AS (SELECT note, string_agg(tag, ',' ORDER BY tag) AS tags, count(*) AS n FROM tags GROUP BY note)
    SELECT path, title, tags, n FROM notes JOIN t ON note = path WHERE publish"""
)
def c8_table_mode(spark, sf):
    n = notes(spark, sf)
    t = X.tags(n).distinct().groupBy("note").agg(F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("tags"), F.count("*").alias("n"))
    return n.where("publish").join(t, n["path"] == t["note"]).select("path", "title", "tags", "n")


_PRINCIPALS_SQL = """
ps AS (SELECT 'u' || n_nationkey::VARCHAR AS usr, CASE WHEN n_nationkey % 6 = 0 THEN NULL WHEN n_nationkey % 6 = 1 THEN []
         ELSE [lower(replace(r_name, ' ', '-')), 'asia'] END AS spaces, n_nationkey % 2 = 0 AS include_private, n_nationkey % 3 = 0 AS trusted_only
       FROM nation JOIN region ON n_regionkey = r_regionkey),
vis AS (SELECT usr AS "user", n.*, rd.readers FROM notes n JOIN (SELECT path AS rp, CASE WHEN key % 4 = 0 THEN ['u2', 'u' || (key % 25)::VARCHAR] ELSE [] END AS readers FROM notes) rd ON rp = path
        JOIN ps ON (spaces IS NULL OR list_contains(spaces, space)) AND (include_private OR NOT private)
        AND (len(rd.readers) = 0 OR list_contains(rd.readers, usr)) AND (NOT trusted_only OR n.origin = 'human'))"""


def _principals(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    own = F.array_distinct(F.array(F.lower(F.replace("r_name", F.lit(" "), F.lit("-"))), F.lit("asia")))
    return n.select(
        F.concat(F.lit("u"), k.cast("string")).alias("user"),
        F.when(k % 6 == 0, F.lit(None)).when(k % 6 == 1, F.array().cast("array<string>")).otherwise(own).alias("spaces"),
        (k % 2 == 0).alias("include_private"),
        (k % 3 == 0).alias("trusted_only"),
    )


def _visible(spark, sf):
    k = F.col("key")
    readers = F.when(k % 4 == 0, F.array(F.lit("u2"), F.concat(F.lit("u"), (k % 25).cast("string")))).otherwise(F.array().cast("array<string>"))
    n = notes(spark, sf).withColumns({"readers": readers, "untrusted": F.col("origin") != "human"})
    return Q.visible_to(n, _principals(spark, sf), readers="readers", untrusted="untrusted")


@query(f'WITH {NOTES}, {_PRINCIPALS_SQL} SELECT "user", path FROM vis')
def c9_visibility(spark, sf):
    return _visible(spark, sf).select("user", "path")


@query(
    f"""WITH {NOTES}, {_PRINCIPALS_SQL}, r AS (SELECT "user", path, row_number() OVER (PARTITION BY "user" ORDER BY updated DESC NULLS LAST, path)::INT AS rank FROM vis WHERE segment = 'building')
    SELECT * FROM r WHERE rank <= 10"""
)
def c10_filter_before_limit(spark, sf):
    from pyspark.sql.window import Window

    order = Window.partitionBy("user").orderBy(F.desc_nulls_last("updated"), "path")
    v = _visible(spark, sf).where("segment = 'building'").withColumn("rank", F.row_number().over(order))
    return v.where("rank <= 10").select("user", "path", "rank")


@query("SELECT doc_id, (row_number() OVER (ORDER BY source, doc_id))::BIGINT AS place, length(text)::BIGINT AS chars FROM documents")
def c11_whole_corpus(spark, sf):
    from notelake.functions.ranks import numbered

    d = table(spark, sf, "documents").select("source", "doc_id", F.length("text").cast("long").alias("chars"))
    placed = numbered(d, [], [F.col("source")], [F.col("doc_id")], "place")
    return placed.select("doc_id", (F.col("place") + 1).alias("place"), "chars")


@query(
    """SELECT source, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(octet_length(encode(text))) <= 120000 AS fits FROM documents GROUP BY source"""
)
def c12_context_fits(spark, sf):
    return Q.context_fits(table(spark, sf, "documents"), "source", "text", 120_000)


@query(f"WITH {NOTES} SELECT path, pinned, (row_number() OVER (ORDER BY pinned DESC, updated DESC NULLS LAST, path))::INT AS place FROM notes WHERE segment = 'machinery' QUALIFY place <= 100")
def c13_listing(spark, sf):
    from pyspark.sql.window import Window

    n = notes(spark, sf).where("segment = 'machinery'")
    top = n.orderBy(F.desc("pinned"), F.desc_nulls_last("updated"), "path").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("pinned"), F.desc_nulls_last("updated"), "path"))).select("path", "pinned", "place")


@query(
    f"""WITH {NOTES}, p AS (SELECT '00' || n_nationkey::VARCHAR AS probe FROM nation WHERE n_nationkey >= 10 UNION ALL SELECT 'customer#0000000' || r_regionkey::VARCHAR FROM region),
    h AS (SELECT probe, path, title, row_number() OVER (PARTITION BY probe ORDER BY starts_with(lower(title), lower(probe)) DESC, title, path)::INT AS rank FROM notes JOIN p ON contains(lower(title), lower(probe)))
    SELECT * FROM h WHERE rank <= 10"""
)
def c14_autocomplete(spark, sf):
    a = table(spark, sf, "nation").where("n_nationkey >= 10").select(F.concat(F.lit("00"), F.col("n_nationkey").cast("string")).alias("probe"))
    b = table(spark, sf, "region").select(F.concat(F.lit("customer#0000000"), F.col("r_regionkey").cast("string")).alias("probe"))
    return Q.autocomplete(notes(spark, sf), a.unionByName(b))


@query()
def c15_random_note(spark, sf):
    """Seeded: the visible note with the smallest hash of path and seed. Spark's hash has no DuckDB twin."""
    return notes(spark, sf).where("not private").orderBy(F.xxhash64("path", F.lit(42)), "path").limit(1).select("path")


_RESOLVED_SQL = """
keys AS (SELECT lower(title) AS key, 0 AS tier, max(path) AS dst FROM notes GROUP BY ALL UNION ALL SELECT lower(path), 1, min(path) FROM notes GROUP BY ALL
  UNION ALL SELECT regexp_replace(lower(path), '\\.md$', ''), 1, min(path) FROM notes GROUP BY ALL
  UNION ALL SELECT lower(regexp_extract(path, '([^/]+)\\.md$', 1)), 2, min(path) FROM notes GROUP BY ALL UNION ALL SELECT lower(alias), 3, min(path) FROM notes GROUP BY ALL),
best AS (SELECT key, arg_min(dst, tier) AS dst FROM keys GROUP BY key),
resolved AS (SELECT l.src, l.target, l.alias, l.pos, b.dst FROM links l LEFT JOIN best b ON lower(l.target) = b.key)""".replace("\\\\", "\\")


def _resolved(spark, sf):
    n = notes(spark, sf)
    return n, L.resolve(X.links(n), n)


@query(
    f"""WITH {NOTES}, {LINKS}, {_RESOLVED_SQL}, p AS (SELECT path FROM notes WHERE publish AND NOT private)
    SELECT DISTINCT src, dst FROM resolved WHERE src IN (SELECT path FROM p) AND dst IN (SELECT path FROM p) AND src <> dst"""
)
def c16_published_backlinks(spark, sf):
    n, r = _resolved(spark, sf)
    return L.graph_edges(r, n.where("publish and not private")).where("src <> dst")


@query(f"WITH {NOTES}, {lines_of('notes')}, {FACT_LINES} SELECT note, value FROM kv JOIN notes ON path = note WHERE lower(kv.key) = 'worth' AND NOT private")
def c17_fact_lookup(spark, sf):
    n = notes(spark, sf)
    open_notes = n.where("not private").select(F.col("path").alias("note"))
    return X.facts(n).where("lower(key) = 'worth'").join(open_notes, "note", "left_semi").select("note", "value")


@query(
    f"""WITH {NOTES}, {lines_of('notes')}, {BLOCKS} SELECT note, line::INT AS line, text, checked, (row_number() OVER (PARTITION BY note ORDER BY checked, line))::INT AS place
    FROM blocks WHERE kind = 'task'"""
)
def c18_tasks(spark, sf):
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("note").orderBy("checked", "line"))
    return X.blocks(notes(spark, sf)).where("kind = 'task'").select("note", "line", "text", "checked", place.alias("place"))


# -- links and graph

@query(f"WITH {NOTES}, {LINKS}, {_RESOLVED_SQL} SELECT src, target, alias, pos, dst FROM resolved")
def d1_resolve_links(spark, sf):
    return _resolved(spark, sf)[1].select("src", "target", "alias", "pos", "dst")


_RETITLED = "CASE WHEN key % 100 = 3 THEN 'missing-' || cast(key % 50 as string) ELSE title END"


@query(
    f"""WITH {NOTES.replace("notes AS (", "old AS (")}, notes AS (SELECT * REPLACE ({_RETITLED} AS title) FROM old), {LINKS}, {_RESOLVED_SQL} SELECT src, target, alias, pos, dst FROM resolved"""
)
def d2_incremental_resolution(spark, sf):
    """Notes are retitled; only what that touches is looked up again, and equals a full pass."""
    before, resolved = _resolved(spark, sf)
    after = before.withColumn("title", F.expr(_RETITLED))
    old = before.where("key % 100 = 3")
    moved = after.where("key % 100 = 3")
    keys = old.select("path", F.lower("title").alias("key")).unionByName(moved.select("path", F.lower("title").alias("key")))
    return L.re_resolve(resolved, X.links(moved), after, keys).select("src", "target", "alias", "pos", "dst")


@query(f"WITH {NOTES}, {LINKS}, {_RESOLVED_SQL} SELECT r.src, r.target, n.title FROM resolved r LEFT JOIN notes n ON n.path = r.dst WHERE starts_with(r.src, 'africa/')")
def d3_outgoing_links(spark, sf):
    n, r = _resolved(spark, sf)
    titles = n.select(F.col("path").alias("dst"), "title")
    return r.where("startswith(src, 'africa/')").join(titles, "dst", "left").select("src", "target", "title")


@query(f"WITH {NOTES}, {LINKS}, {_RESOLVED_SQL} SELECT DISTINCT dst, src, title FROM resolved JOIN notes ON path = src WHERE dst IS NOT NULL AND dst <> src")
def d4_backlinks(spark, sf):
    n, r = _resolved(spark, sf)
    return L.backlinks(r, n)


@query(
    f"""WITH {NOTES}, {LINKS}, {_RESOLVED_SQL}, v AS (SELECT path FROM notes WHERE NOT private)
    SELECT 'edge' AS part, src AS a, dst AS b, 1::BIGINT AS n FROM (SELECT DISTINCT src, dst FROM resolved WHERE src IN (FROM v) AND dst IN (FROM v))
    UNION ALL SELECT * FROM (SELECT 'dangling', lower(target), NULL, count(*) FROM resolved WHERE dst IS NULL GROUP BY lower(target) ORDER BY 4 DESC, 2 LIMIT 200)"""
)
def d5_graph_export(spark, sf):
    n, r = _resolved(spark, sf)
    edges = L.graph_edges(r, n.where("not private")).select(F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).cast("long").alias("n"))
    loose = L.dangling(r).select(F.lit("dangling").alias("part"), F.col("target").alias("a"), F.lit(None).cast("string").alias("b"), "n")
    return edges.unionByName(loose)


@query(f"WITH {NOTES} SELECT lower(alias) AS alias, min(path) AS path FROM notes GROUP BY lower(alias)")
def d6_alias_map(spark, sf):
    return notes(spark, sf).groupBy(F.lower("alias").alias("alias")).agg(F.min("path").alias("path"))


@query(
    f"""WITH nm AS (SELECT DISTINCT p_name AS name, min('part/' || p_name) OVER (PARTITION BY p_name) AS dst FROM part UNION ALL SELECT lower(r_name), 'region/' || r_name FROM region
        UNION ALL SELECT split_part(p_name, ' ', 1), 'w/' || split_part(p_name, ' ', 1) FROM part GROUP BY ALL UNION ALL SELECT 'of the', 'w/of the'),
    k AS (SELECT *, {NORMAL.format('name')} AS nk FROM nm WHERE length({NORMAL.format('name')}) >= 3),
    l AS (SELECT 'd/' || doc_id::VARCHAR AS doc, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
    z AS (SELECT doc, line, ' ' || {NORMAL.format('t')} || ' ' AS t FROM l)
    SELECT name, doc, min(line)::INT AS line FROM z JOIN k ON contains(z.t, ' ' || k.nk || ' ') WHERE ('d/' || (length(name) * 7)::VARCHAR) <> doc GROUP BY name, doc"""
)
def d7_unlinked_mentions(spark, sf):
    part = table(spark, sf, "part")
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    names = (
        part.select(F.col("p_name").alias("name"), F.concat(F.lit("part/"), "p_name").alias("dst"))
        .unionByName(table(spark, sf, "region").select(F.lower("r_name").alias("name"), F.concat(F.lit("region/"), "r_name").alias("dst")))
        .unionByName(part.select(word.alias("name"), F.concat(F.lit("w/"), word).alias("dst")))
        .unionByName(spark.createDataFrame([("of the", "w/of the")], "name string, dst string"))
        .distinct()
    )
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("doc"), F.col("text").alias("body"))
    linked = names.select(F.concat(F.lit("d/"), (F.length("name") * 7).cast("string")).alias("doc"), "dst")
    return L.mentions(docs, names, linked)


_SPACES = [("", "root"), ("asia/", "asia"), ("asia/nation_1/", "asia-one"), ("europe/", "europe"), ("america/nation_", "never")]
_SPACES_SQL = "sp AS (SELECT * FROM (VALUES ('', 'root'), ('asia/', 'asia'), ('asia/nation_1/', 'asia-one'), ('europe/', 'europe'), ('america/nation_', 'never')) t(prefix, id))"
_ASSIGN_SQL = "asg AS (SELECT path, arg_max(id, length(prefix)) AS space FROM notes JOIN sp ON starts_with(path, prefix) AND (prefix = '' OR suffix(prefix, '/')) GROUP BY path)"


@query(f"WITH {NOTES}, {_SPACES_SQL}, {_ASSIGN_SQL} SELECT path, space FROM asg")
def d8_space_assignment(spark, sf):
    return L.assign_spaces(notes(spark, sf), spark.createDataFrame(_SPACES, "prefix string, id string"))


@query(f"WITH {NOTES}, {_SPACES_SQL}, {_ASSIGN_SQL} SELECT n.path, n.space AS before, asg.space AS after FROM notes n JOIN asg USING (path) WHERE n.space <> asg.space")
def d9_restamp_spaces(spark, sf):
    n = notes(spark, sf)
    to = L.assign_spaces(n, spark.createDataFrame(_SPACES, "prefix string, id string")).withColumnRenamed("space", "after")
    return n.join(to, "path").where("space <> after").select("path", F.col("space").alias("before"), "after")


@query(
    """WITH m AS (SELECT 'u' || (c_custkey % 50)::VARCHAR AS usr, 'space-' || c_nationkey::VARCHAR AS space FROM customer),
    a AS (SELECT DISTINCT 'u' || (s_suppkey % 60)::VARCHAR AS usr FROM supplier WHERE s_suppkey % 10 = 0),
    g AS (SELECT usr, string_agg(DISTINCT space, ',' ORDER BY space) AS spaces FROM m GROUP BY usr)
    SELECT coalesce(g.usr, a.usr) AS "user", CASE WHEN a.usr IS NULL THEN spaces END AS spaces FROM g FULL JOIN a ON g.usr = a.usr"""
)
def d10_principals(spark, sf):
    m = table(spark, sf, "customer").select(F.concat(F.lit("u"), (F.col("c_custkey") % 50).cast("string")).alias("user"), F.concat(F.lit("space-"), F.col("c_nationkey").cast("string")).alias("space"))
    a = table(spark, sf, "supplier").where("s_suppkey % 10 = 0").select(F.concat(F.lit("u"), (F.col("s_suppkey") % 60).cast("string")).alias("user")).distinct()
    return L.principals(m, a).select("user", F.array_join("spaces", ",").alias("spaces"))


@query(
    """WITH d AS (SELECT 'o' || o_orderkey::VARCHAR AS doc, 's' || (o_orderkey % 3)::VARCHAR AS source, unnest(['e' || (o_orderkey % 40)::VARCHAR, 'e' || (o_orderkey % 97)::VARCHAR]) AS external FROM orders),
    i AS (SELECT 's' || (n_nationkey % 3)::VARCHAR AS source, 'e' || n_nationkey::VARCHAR AS external, 'acct' || n_nationkey::VARCHAR AS usr FROM nation)
    SELECT doc, string_agg(DISTINCT usr, ',' ORDER BY usr) AS users, count(*) FILTER (WHERE usr IS NULL) AS unmapped FROM d LEFT JOIN i USING (source, external) GROUP BY doc HAVING count(usr) > 0"""
)
def d11_reader_mapping(spark, sf):
    k = F.col("o_orderkey")
    name = lambda p, v: F.concat(F.lit(p), v.cast("string"))
    docs = table(spark, sf, "orders").select(name("o", k).alias("doc"), name("s", k % 3).alias("source"), F.array(name("e", k % 40), name("e", k % 97)).alias("readers"))
    n = F.col("n_nationkey")
    ids = table(spark, sf, "nation").select(name("s", n % 3).alias("source"), name("e", n).alias("external"), name("acct", n).alias("user"))
    return L.map_readers(docs, ids).select("doc", F.array_join("users", ",").alias("users"), "unmapped")


_KEY_SQL = r"lower(regexp_extract({0}, '^https?://[^/]*')) || regexp_replace({0}, '^https?://[^/]*', '')"
_URL_KEY = _KEY_SQL.format(r"regexp_replace(regexp_replace({0}, '[?#].*$', ''), '/+$', '')")


@query(
    rf"""WITH b AS (SELECT 'see ' || url || ' or http://safe.example.org/' || (page_id % 9)::VARCHAR AS body, page_id % 3 <> 0 AS untrusted FROM pages),
    u AS (SELECT unnest(regexp_extract_all(body, 'https?://[^\s"''<>)\]]+')) AS u, untrusted FROM b),
    k AS (SELECT {_URL_KEY.format('u')} AS k, bool_or(untrusted) AS nu, bool_or(NOT untrusted) AS nt FROM u GROUP BY 1),
    t AS (SELECT url AS target FROM pages UNION ALL SELECT 'http://safe.example.org/3?x=1' UNION ALL SELECT 'http://nobody.example.org/')
    SELECT target, coalesce(nu, false) AS named_untrusted, coalesce(nt, false) AS named_trusted, NOT coalesce(nu, false) OR coalesce(nt, false) AS allowed
    FROM t LEFT JOIN k ON {_URL_KEY.format('target')} = k.k"""
)
def d12_provenance(spark, sf):
    p = table(spark, sf, "pages")
    body = F.concat(F.lit("see "), "url", F.lit(" or http://safe.example.org/"), (F.col("page_id") % 9).cast("string"))
    bodies = p.select(body.alias("body"), (F.col("page_id") % 3 != 0).alias("untrusted"))
    extra = spark.createDataFrame([("http://safe.example.org/3?x=1",), ("http://nobody.example.org/",)], "target string")
    return L.provenance(p.select(F.col("url").alias("target")).unionByName(extra), bodies)


def _mentioned(spark, sf):
    c = table(spark, sf, "conversations")
    fact = F.concat_ws("-", "conv_id", "turn")
    return c.select(fact.alias("fact"), F.explode(X.entities(F.col("text"))).alias("entity"))


_MENTIONED = r"""
a_ AS (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS fact, list_concat(
   regexp_extract_all(text, '\[\[([^\]\[|]+)', 1), regexp_extract_all(text, '`([^`\n]+)`', 1), regexp_extract_all(text, '[@#]([A-Za-z][\w-]+)', 1),
   regexp_extract_all(text, '[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)+'), regexp_extract_all(text, '[A-Z]{2,}[0-9]*'), regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')) AS l FROM conversations),
men AS (SELECT * FROM (SELECT DISTINCT fact, lower(trim(unnest(l))) AS entity FROM a_) WHERE length(entity) > 1 AND entity NOT IN
  ('the','a','an','this','that','these','those','it','in','on','of','for','and','but','we','i','to','he','she'))"""


@query(
    rf"""WITH RECURSIVE {_MENTIONED}, seeds AS (SELECT entity AS seed FROM men GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 10),
    pairs AS (SELECT DISTINCT a.entity AS a, b.entity AS b FROM men a JOIN men b USING (fact) WHERE a.entity <> b.entity),
    walk AS (SELECT seed, seed AS entity, 0 AS depth FROM seeds UNION SELECT seed, b, depth + 1 FROM walk JOIN pairs ON a = entity WHERE depth < 2)
    SELECT seed, entity, min(depth)::INT AS depth FROM walk GROUP BY seed, entity"""
)
def d13_entity_neighbourhood(spark, sf):
    m = _mentioned(spark, sf)
    seeds = m.groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(10).select(F.col("entity").alias("seed"))
    return L.neighbourhood(m, seeds, 2)


_PARTIAL = """tp AS (SELECT entity FROM men GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 10), sd AS (SELECT DISTINCT left(entity, greatest(3, length(entity) - 1)) AS asked FROM tp UNION SELECT 'zq'),
rs AS (SELECT asked, coalesce((SELECT any_value(entity) FROM men WHERE entity = asked), CASE WHEN strlen(asked) >= 3 THEN (SELECT arg_min(entity, (strlen(entity), entity)) FROM men WHERE contains(entity, asked)) END, asked) AS seed FROM sd),
pairs AS (SELECT a.entity AS a, b.entity AS b, fact FROM men a JOIN men b USING (fact) WHERE a.entity <> b.entity), near AS (SELECT DISTINCT a, b FROM pairs),
walk AS (SELECT asked, seed AS entity, 0 AS depth FROM rs UNION SELECT asked, b, depth + 1 FROM walk JOIN near ON a = entity WHERE depth < 2),
nd AS (SELECT asked, entity, min(depth)::INT AS depth FROM walk GROUP BY asked, entity), dg AS (SELECT entity, count(*) AS facts FROM men GROUP BY entity),
kn AS (SELECT asked, entity, depth, coalesce(facts, 0) AS facts, (row_number() OVER (PARTITION BY asked ORDER BY depth, coalesce(facts, 0) DESC, entity))::INT AS place FROM nd LEFT JOIN dg USING (entity) QUALIFY place <= 50)"""


def _graph(spark, sf):
    m = _mentioned(spark, sf)
    top = m.groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(10)
    seeds = top.select(F.left("entity", F.greatest(F.lit(3), F.length("entity") - 1)).alias("asked")).unionByName(spark.range(1).select(F.lit("zq").alias("asked")))
    return L.entity_graph(m, seeds, 2)


@query(rf"WITH RECURSIVE {_MENTIONED}, {_PARTIAL} SELECT asked, entity, depth, facts, place FROM kn")
def d13_graph_nodes(spark, sf):
    """Around parts of the names of the busiest entities, two hops far."""
    return _graph(spark, sf)[0]


@query(
    rf"""WITH RECURSIVE {_MENTIONED}, {_PARTIAL}, ed AS (SELECT DISTINCT n.asked, least(p.a, p.b) AS a, greatest(p.a, p.b) AS b, fact FROM nd n JOIN pairs p ON p.a = n.entity WHERE n.depth < 2)
    SELECT ed.asked, a, b, string_agg(fact, ',' ORDER BY fact) AS facts FROM ed JOIN kn x ON x.asked = ed.asked AND x.entity = a JOIN kn y ON y.asked = ed.asked AND y.entity = b GROUP BY 1, 2, 3"""
)
def d13_graph_edges(spark, sf):
    return _graph(spark, sf)[1].withColumn("facts", F.array_join("facts", ","))


@query(
    rf"""WITH {_MENTIONED}, top AS (SELECT entity, count(*) AS n FROM men GROUP BY entity ORDER BY 2 DESC, 1 LIMIT 40)
    SELECT a.entity AS a, b.entity AS b, count(DISTINCT fact) AS facts FROM men a JOIN men b USING (fact) WHERE a.entity < b.entity
    AND a.entity IN (SELECT entity FROM top) AND b.entity IN (SELECT entity FROM top) GROUP BY 1, 2"""
)
def d14_busiest_edges(spark, sf):
    return L.busiest(_mentioned(spark, sf), 40)[1]


@query(
    f"""WITH {FACTS}, live AS (SELECT * FROM mem WHERE expires IS NULL OR expires > TIMESTAMP '{NOW}')
    SELECT a.id, b.id AS contested, b.agent FROM live a JOIN live b ON a.challenges = b.id WHERE b.superseded_by IS NULL"""
)
def d15_open_challenges(spark, sf):
    m = memory(spark, sf).where(F.col("expires").isNull() | (F.col("expires") > _now()))
    contested = m.where("superseded_by is null").select(F.col("id").alias("contested"), "agent")
    return m.select("id", "challenges").join(contested, F.col("challenges") == F.col("contested")).select("id", "contested", "agent")


@query(
    f"""WITH {FACTS}, r AS (SELECT id, last_value(id) OVER w AS last, (count(*) OVER w - row_number() OVER (PARTITION BY cust ORDER BY stamp, num))::BIGINT AS length FROM mem
    WINDOW w AS (PARTITION BY cust ORDER BY stamp, num ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT * FROM r"""
)
def d16_supersession_chains(spark, sf):
    return L.chains(memory(spark, sf))
