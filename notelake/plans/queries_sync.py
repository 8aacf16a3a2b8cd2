"""Queries of the ingest, sync, history and access-log families."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators import access_log as A
from notelake.operators import sync as Y
from notelake.plans.extraction import SLUG
from notelake.plans.inputs import FACTS, NOTES, memory, notes
from notelake.plans.registry import query, table
from notelake.sources.notes import document_hash

_OLD = "old_ AS (SELECT 'p/' || p_partkey::VARCHAR || CASE WHEN p_partkey % 10 = 0 THEN '.png' ELSE '.md' END AS path, p_partkey::DOUBLE AS mtime, md5(p_name) AS hash FROM part WHERE p_partkey % 9 <> 0)"
_NEW = """new_ AS (SELECT 'p/' || p_partkey::VARCHAR || CASE WHEN p_partkey % 10 = 0 THEN '.png' ELSE '.md' END AS path, p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 5.0::DOUBLE WHEN p_partkey % 7 = 0 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS mtime,
  CASE WHEN p_partkey % 6 = 0 OR p_partkey % 7 = 0 THEN md5(p_name || 'x') ELSE md5(p_name) END AS hash FROM part WHERE p_partkey % 8 <> 0)"""


def _snapshots(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    path = F.concat(F.lit("p/"), k.cast("string"), F.when(k % 10 == 0, ".png").otherwise(".md")).alias("path")
    old = p.where(k % 9 != 0).select(path, k.cast("double").alias("mtime"), F.md5("p_name").alias("hash"))
    mtime = k + F.when(k % 3 == 0, 5.0).when(k % 7 == 0, -1.0).otherwise(0.0)
    name = F.when((k % 6 == 0) | (k % 7 == 0), F.concat("p_name", F.lit("x"))).otherwise(F.col("p_name"))
    return old, p.where(k % 8 != 0).select(path, mtime.alias("mtime"), F.md5(name).alias("hash"))


@query(
    f"""WITH {_OLD}, {_NEW} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
    WHEN abs(o.mtime - n.mtime) < 0.001 OR o.hash = n.hash THEN 'unchanged' ELSE 'updated' END AS status FROM old_ o FULL JOIN new_ n ON o.path = n.path"""
)
def h1_incremental_sync(spark, sf):
    return Y.sync_status(*_snapshots(spark, sf))


_DOCS = f"""dc AS (SELECT 'c' || (doc_id % 3)::VARCHAR AS connector, 'e' || doc_id::VARCHAR AS external_id, left(text, 30) AS title, text AS body, doc_id,
  sha256(left(text, 30) || chr(1) || text || chr(1) || 'http://x/' || doc_id::VARCHAR || chr(1) || lang || chr(1) || 'lang=' || lang || chr(2) || 'source=' || source) AS hash,
  'in/' || {SLUG.format('source')} AS folder FROM documents),
kn AS (SELECT connector, external_id, 'old/' || external_id || '.md' AS path, CASE WHEN doc_id % 4 = 0 THEN 'stale' ELSE hash END AS hash FROM dc WHERE doc_id % 5 <> 0)"""


def _docs(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    title = F.left("text", F.lit(30))
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    rows = d.select(
        k, "source", "lang", F.concat(F.lit("c"), (k % 3).cast("string")).alias("connector"), F.concat(F.lit("e"), k.cast("string")).alias("external_id"), title.alias("title"), F.col("text").alias("body"),
        document_hash(title, F.col("text"), F.concat(F.lit("http://x/"), k.cast("string")), F.col("lang"), meta).alias("hash"),
    )
    docs = Y.route(rows, spark.createDataFrame([("nobody", "x")], "name string, folder string"), "source", "in")
    known = docs.where(k % 5 != 0).select(
        "connector", "external_id", F.concat(F.lit("old/"), "external_id", F.lit(".md")).alias("path"), F.when(k % 4 == 0, F.lit("stale")).otherwise(F.col("hash")).alias("hash")
    )
    return docs, known


@query(
    f"""WITH {_DOCS} SELECT dc.connector, dc.external_id, coalesce(kn.path, folder || '/' || {SLUG.format('title')} || '-' || left(sha256(dc.external_id), 6) || '.md') AS path, dc.hash,
    CASE WHEN kn.hash IS NULL THEN 'create' WHEN kn.hash = dc.hash THEN 'unchanged' ELSE 'update' END AS action FROM dc LEFT JOIN kn ON dc.connector = kn.connector AND dc.external_id = kn.external_id WHERE trim(body) <> ''"""
)
def h2_connector_upsert(spark, sf):
    docs, known = _docs(spark, sf)
    return Y.upsert_plan(docs, known)


@query(
    f"""WITH {_DOCS} SELECT connector, external_id, path, hash FROM kn WHERE connector IN ('c0', 'c1') AND NOT EXISTS (SELECT 1 FROM dc WHERE dc.connector = kn.connector AND dc.external_id = kn.external_id AND (doc_id % 7 <> 0 OR doc_id % 14 = 0))"""
)
def h3_reap(spark, sf):
    docs, known = _docs(spark, sf)
    page, seen = docs.where("doc_id % 7 <> 0"), docs.where("doc_id % 14 = 0")
    complete = spark.createDataFrame([("c0", True), ("c1", True), ("c2", False)], "connector string, complete boolean")
    return Y.reap(known, page, seen, complete).select("connector", "external_id", "path", "hash")


@query(f"SELECT doc_id, CASE lower(source) WHEN 'src1' THEN 'team/one' WHEN 'src2' THEN 'team/two' ELSE 'inbox/' || {SLUG.format('source')} END AS folder FROM documents")
def h4_folder_routing(spark, sf):
    routes = spark.createDataFrame([("SRC1", "team/one"), ("Src2", "team/two")], "name string, folder string")
    return Y.route(table(spark, sf, "documents"), routes, "source", "inbox").select("doc_id", "folder")


@query(
    "WITH c AS (SELECT event_type AS connector, max(ts) AS cursor FROM events GROUP BY event_type) SELECT connector, cursor, date_diff('second', cursor, TIMESTAMP '2024-01-31 00:00:00') >= 86400 + length(connector) * 100 AS due FROM c"
)
def h5_cursors(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("connector"), F.col("ts").alias("updated"))
    runs = Y.cursors(e).withColumns({"last_run": F.col("cursor"), "interval_s": 86400 + F.length("connector") * 100})
    late = Y.due(runs, F.expr("timestamp_ntz '2024-01-31 00:00:00'")).select("connector", F.lit(True).alias("due"))
    return runs.select("connector", "cursor").join(late, "connector", "left").na.fill(False, ["due"])


@query(
    """WITH e AS (SELECT 'n' || user_id::VARCHAR AS path, ts AS "at", event_id AS seq, md5((event_id // 3 % 5)::VARCHAR) AS hash FROM events),
    l AS (SELECT *, lag(hash) OVER (PARTITION BY path ORDER BY "at", seq) AS b FROM e), c AS (SELECT * FROM l WHERE b IS NULL OR b <> hash),
    v AS (SELECT path, "at", seq, hash, (row_number() OVER (PARTITION BY path ORDER BY "at" DESC, seq DESC))::INT AS version FROM c) SELECT * FROM v WHERE version <= 25"""
)
def h6_version_history(spark, sf):
    e = table(spark, sf, "events").select(
        F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("path"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        F.md5((F.floor(F.col("event_id") / 3) % 5).cast("string")).alias("hash"),
    )
    return Y.version_history(e)


@query(
    f"""WITH {_OLD}, {_NEW} SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'push' WHEN o.path IS NULL THEN 'pull' WHEN o.hash = n.hash THEN 'in_sync'
    WHEN regexp_matches(coalesce(o.path, n.path), '\\.(md|markdown|txt)$') THEN 'merge' WHEN o.mtime >= n.mtime THEN 'push' ELSE 'pull' END AS action FROM old_ o FULL JOIN new_ n ON o.path = n.path""".replace("\\\\", "\\")
)
def h7_manifest_diff(spark, sf):
    return Y.manifest_diff(*_snapshots(spark, sf))


@query(
    f"""WITH {_OLD}, ch AS (SELECT 'p/' || p_partkey::VARCHAR || CASE WHEN p_partkey % 10 = 0 THEN '.png' ELSE '.md' END AS path, CASE WHEN p_partkey % 3 = 0 THEN 'other' ELSE md5(p_name) END AS base_hash, md5(p_name || 'z') AS hash, p_partkey % 11 = 0 AS deleted FROM part),
    s AS (SELECT ch.path, ch.hash, CASE WHEN o.hash IS NULL AND deleted THEN 'gone' WHEN o.hash IS NULL THEN 'created' WHEN o.hash = base_hash THEN CASE WHEN deleted THEN 'deleted' ELSE 'ok' END
      WHEN deleted THEN 'conflict-keep' WHEN o.hash = ch.hash THEN 'ok' ELSE 'conflict' END AS status FROM ch LEFT JOIN old_ o USING (path))
    SELECT path, status, CASE WHEN status = 'conflict' THEN regexp_replace(path, '\\.md$', '') || '.conflict.md' ELSE path END AS final_path, hash FROM s""".replace("\\\\", "\\")
)
def h8_apply_changes(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    path = F.concat(F.lit("p/"), k.cast("string"), F.when(k % 10 == 0, ".png").otherwise(".md")).alias("path")
    base = F.when(k % 3 == 0, F.lit("other")).otherwise(F.md5("p_name"))
    changes = p.select(path, base.alias("base_hash"), F.md5(F.concat("p_name", F.lit("z"))).alias("hash"), (k % 11 == 0).alias("deleted"))
    return Y.apply_changes(_snapshots(spark, sf)[0], changes)


@query(
    """WITH a AS (SELECT conv_id AS doc, turn * 1000000 + i AS k, substr(text, i::BIGINT, 1) AS ch, turn FROM (SELECT conv_id, turn, text, unnest(range(1, length(text) + 1)) AS i FROM conversations))
    SELECT doc, string_agg(ch, '' ORDER BY turn % 3, k) AS text, count(*) AS atoms FROM a WHERE NOT (k % 5 = 0) GROUP BY doc"""
)
def h9_crdt_merge(spark, sf):
    c = table(spark, sf, "conversations")
    i = F.explode(F.sequence(F.lit(1), F.length("text")))
    a = c.where("length(text) > 0").select("conv_id", "turn", "text", i.alias("i"))
    clock = F.col("turn") * 1_000_000 + F.col("i")
    key = F.array((F.col("turn") % 3).cast("int"), clock.cast("int"))
    atoms = a.select(F.col("conv_id").alias("doc"), key.alias("key"), (F.col("turn") % 2).cast("string").alias("site"), clock.alias("clock"), F.expr("substring(text, i, 1)").alias("ch"))
    other = atoms.where("clock % 2 = 0")  # a second replica that knows a part
    return Y.crdt_merge(atoms.unionByName(other), atoms.where("clock % 5 = 0"))


@query(
    f"""WITH {NOTES}, r AS (SELECT path, body, regexp_replace(regexp_replace(body, '(?m)^(tags: \\[(?:[^\\]]*, )?)building((?:, [^\\]]*)?\\])$', '\\1tower\\2'), '(^|\\s)#vip/building($|[^\\w/-])', '\\1#gold\\2', 'g') AS after FROM notes)
    SELECT path, md5(after) AS body_md5, after <> body AS changed FROM r""".replace("\\\\", "\\")
)
def h10_rename_tag(spark, sf):
    after = Y.rename_tag(Y.rename_tag(F.col("body"), "building", "tower"), "vip/building", "gold")
    return notes(spark, sf).select("path", F.md5(after).alias("body_md5"), (after != F.col("body")).alias("changed"))


@query(
    f"""WITH {NOTES}, s AS (SELECT path, CASE WHEN key % 2 = 0 THEN regexp_replace(body, '(^|\\n)worth:: [^\\n]*', '\\1worth:: ' || key::VARCHAR) ELSE body || 'mood:: ' || key::VARCHAR || chr(10) END AS body FROM notes)
    SELECT path, md5(body) AS body_md5 FROM s""".replace("\\\\", "\\")
)
def h11_set_fact(spark, sf):
    value, b = F.col("key").cast("string"), F.col("body")
    new = F.when(F.col("key") % 2 == 0, Y.set_fact(b, "worth", value)).otherwise(Y.set_fact(b, "mood", value))
    return notes(spark, sf).select("path", F.md5(new).alias("body_md5"))


@query(
    """WITH d AS (SELECT doc_id, text, instr(lower(text), 'the') AS p FROM documents)
    SELECT doc_id, md5(CASE WHEN p > 0 THEN substr(text, 1, p - 1) || '[[' || substr(text, p, 3) || ']]' || substr(text, p + 3) ELSE text END) AS text_md5 FROM d"""
)
def h12_link_mention(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(Y.link_first_mention(F.col("text"), F.lit("The"))).alias("text_md5"))


@query(
    f"""WITH {NOTES} SELECT CASE WHEN key % 4 = 0 THEN 'moved/' || path ELSE path END AS path, title FROM notes"""
)
def h13_rename_notes(spark, sf):
    n = notes(spark, sf)
    moves = n.where("key % 4 = 0").select(F.col("path").alias("old"), F.concat(F.lit("moved/"), "path").alias("new"))
    return Y.rename_notes({"notes": n.select("path", "title")}, moves)["notes"]


@query(
    """WITH t AS (SELECT o_orderkey AS id, 'n/' || (o_orderkey % 300)::VARCHAR || '.md' AS path, o_orderdate AS deleted_at FROM orders WHERE o_orderkey % 5 = 0),
    c AS (SELECT DISTINCT 'n/' || (p_partkey % 150)::VARCHAR || '.md' AS path FROM part),
    r AS (SELECT id, t.path, row_number() OVER (PARTITION BY t.path ORDER BY deleted_at DESC, id) - 1 + CASE WHEN c.path IS NULL THEN 0 ELSE 1 END AS n FROM t LEFT JOIN c USING (path))
    SELECT id, CASE WHEN n > 0 THEN regexp_replace(path, '\\.md$', '') || '-' || n::VARCHAR || '.md' ELSE path END AS path FROM r""".replace("\\\\", "\\")
)
def h14_restore(spark, sf):
    name = lambda v: F.concat(F.lit("n/"), v.cast("string"), F.lit(".md"))
    trash = table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id"), name(F.col("o_orderkey") % 300).alias("path"), F.col("o_orderdate").alias("deleted_at"))
    return Y.restore(trash, table(spark, sf, "part").select(name(F.col("p_partkey") % 150).alias("path")).distinct())


@query(
    """SELECT 'daily/' || strftime(ts, '%Y-%m-%d') || '.md' AS path, count(*) AS links, md5(string_agg('- [[inbox/' || event_id::VARCHAR || ']]', chr(10) ORDER BY ts, event_id)) AS body_md5 FROM events WHERE event_type = 'signup' GROUP BY 1"""
)
def h15_capture(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'signup'")
    c = e.select(F.col("ts").alias("at"), F.col("event_id").alias("id"), F.concat(F.lit("inbox/"), F.col("event_id").cast("string")).alias("path"))
    return Y.daily_notes(c).select("path", "links", F.md5("body").alias("body_md5"))


@query(
    f"""WITH {FACTS}, u AS (SELECT 'read' AS kind, ts AS "at", 'e' || event_id::VARCHAR AS subject FROM events UNION ALL SELECT 'fact', stamp, id FROM mem UNION ALL SELECT 'secret', o_orderdate, 'k' || o_orderkey::VARCHAR FROM orders)
    SELECT * FROM u WHERE kind IN ('read', 'fact') ORDER BY "at" DESC, kind, subject LIMIT 100"""
)
def h16_timeline(spark, sf):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("subject")
    feeds = {
        "read": table(spark, sf, "events").select(F.col("ts").alias("at"), name("e", "event_id")),
        "fact": memory(spark, sf).select(F.col("stamp").alias("at"), F.col("id").alias("subject")),
        "secret": table(spark, sf, "orders").select(F.col("o_orderdate").alias("at"), name("k", "o_orderkey")),
    }
    return Y.timeline(feeds, ["read", "fact"], 100)


@query(
    """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'view'), i AS (SELECT *, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS island FROM d)
    SELECT user_id, min(day)::VARCHAR AS first, max(day)::VARCHAR AS last, count(*) AS length FROM i GROUP BY user_id, island"""
)
def h17_streaks(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'view'").select("user_id", F.to_date("ts").alias("day"))
    return Y.streaks(e, "user_id").withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


@query(
    """WITH s AS (SELECT (DATE '2023-12-25' + i::INT)::DATE AS day FROM range(84) t(i)), d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1)
    SELECT s.day::VARCHAR AS day, coalesce(n, 0) AS n FROM s LEFT JOIN d USING (day)"""
)
def h17_calendar(spark, sf):
    return Y.calendar(table(spark, sf, "events").select(F.to_date("ts").alias("day")), "2023-12-25").withColumn("day", F.col("day").cast("string"))


@query(f"WITH {FACTS} SELECT note, 'x' || (num % 50)::VARCHAR AS id, min(num) AS line FROM mem GROUP BY ALL")
def h18_id_deduplication(spark, sf):
    m = memory(spark, sf).select("note", F.concat(F.lit("x"), (F.col("num") % 50).cast("string")).alias("id"), F.col("num").alias("line"))
    return m.groupBy("note", "id").agg(F.min("line").alias("line"))


# -- access log

_EV = """ev AS (SELECT event_id AS id, ts AS "at", 'u' || (user_id % 20)::VARCHAR AS caller, 'hr/doc-' || json_extract_string(props, '$.k') AS path, event_type <> 'error' AS allowed, event_id % 3 = 0 AS restricted, value FROM events)"""


def _events(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("at"), F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("caller"),
        F.concat(F.lit("hr/doc-"), F.get_json_object("props", "$.k")).alias("path"), (F.col("event_type") != "error").alias("allowed"), (F.col("event_id") % 3 == 0).alias("restricted"), "value",
    )


@query(f"WITH {_EV} SELECT id, caller, left(path, 512) AS path, allowed FROM ev WHERE NOT allowed OR restricted")
def i1_log_ingest(spark, sf):
    return A.ingest(_events(spark, sf)).select("id", "caller", "path", "allowed")


@query(
    f"""WITH {_EV}, w AS (SELECT 'u' || (id % 2)::VARCHAR AS caller, date_trunc('minute', TIMESTAMP '2024-01-01' + to_seconds((id // 10)::BIGINT)) AS minute FROM ev WHERE NOT allowed)
    SELECT caller, minute, least(count(*), 40) AS kept, greatest(count(*) - 40, 0) AS suppressed FROM w GROUP BY ALL"""
)
def i2_denial_cap(spark, sf):
    e = _events(spark, sf)
    squeezed = e.withColumns(
        {"caller": F.concat(F.lit("u"), (F.col("id") % 2).cast("string")), "at": F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, floor(id / 10))")}
    )
    return A.cap_denials(squeezed, 40)


_BREADTH = """b AS (SELECT caller, id, "at", count(DISTINCT CASE WHEN allowed THEN path END) OVER w AS n, max(CASE WHEN allowed THEN "at" END) OVER w AS last FROM ev WINDOW w AS (PARTITION BY caller ORDER BY "at" RANGE BETWEEN CURRENT ROW AND INTERVAL 14400 SECOND FOLLOWING)),
b1 AS (SELECT caller, n, "at" AS first, last FROM b WHERE n >= 8 QUALIFY row_number() OVER (PARTITION BY caller ORDER BY n DESC, "at", id) = 1),
b2 AS (SELECT b1.caller, path, arg_min(id, ("at", id)) AS i, min("at") AS a FROM b1 JOIN ev ON ev.caller = b1.caller AND allowed AND "at" BETWEEN first AND last GROUP BY b1.caller, path),
b3 AS (SELECT * FROM b2 QUALIFY row_number() OVER (PARTITION BY caller ORDER BY a, i) <= 8),
br AS (SELECT caller, n, first, last, documents FROM b1 JOIN (SELECT caller, string_agg(path, ',' ORDER BY a, i) AS documents FROM b3 GROUP BY caller) USING (caller))"""
_DENIED = """d AS (SELECT caller, id, "at", count(*) OVER w AS n, max("at") OVER w AS last FROM ev WHERE NOT allowed WINDOW w AS (PARTITION BY caller ORDER BY "at" RANGE BETWEEN CURRENT ROW AND INTERVAL 14400 SECOND FOLLOWING)),
d1 AS (SELECT caller, id AS from_, n, "at" AS first, last FROM d WHERE n >= 4 QUALIFY row_number() OVER (PARTITION BY caller ORDER BY n DESC, "at", id) = 1),
d3 AS (SELECT d1.caller, path, id, "at" AS a FROM d1 JOIN ev ON ev.caller = d1.caller AND NOT allowed AND ("at", id) >= (first, from_) AND "at" <= last QUALIFY row_number() OVER (PARTITION BY d1.caller ORDER BY "at", id) <= 8),
dn AS (SELECT caller, n, first, last, documents FROM d1 JOIN (SELECT caller, string_agg(path, ',' ORDER BY a, id) AS documents FROM d3 GROUP BY caller) USING (caller))"""


def _named(found):
    return found.withColumn("documents", F.array_join("documents", ","))


@query(f"WITH {_EV}, {_BREADTH} SELECT * FROM br")
def i3_breadth_burst(spark, sf):
    return _named(A.breadth_bursts(_events(spark, sf), 14400, 8))


@query(f"WITH {_EV}, {_DENIED} SELECT * FROM dn")
def i4_denial_burst(spark, sf):
    return _named(A.denial_bursts(_events(spark, sf), 14400, 4))


_RECENT = _EV.replace("FROM events)", "FROM events WHERE ts >= TIMESTAMP '2024-01-15')")


@query(f"WITH {_RECENT}, {_BREADTH}, {_DENIED} SELECT *, 'breadth' AS kind FROM br UNION ALL SELECT *, 'denied' FROM dn")
def i5_anomaly_report(spark, sf):
    return _named(A.anomalies(_events(spark, sf), F.expr("timestamp_ntz '2024-01-15 00:00:00'"), 14400, 8, 4))


@query(f"""WITH {_EV} SELECT id FROM ev WHERE "at" >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY""")
def i9_retention(spark, sf):
    return A.prune(_events(spark, sf), F.expr("timestamp_ntz '2024-01-31 00:00:00'"), 10).select("id")


@query(f"""WITH {_EV} SELECT id, caller, path FROM ev WHERE contains(path, 'doc-7') AND NOT allowed ORDER BY "at" DESC, id DESC LIMIT 50""")
def i10_audit_browse(spark, sf):
    return A.browse(_events(spark, sf), path="doc-7", denied_only=True, n=50).select("id", "caller", "path")


@query(
    f"""WITH {_EV} SELECT time_bucket(INTERVAL 1 HOUR, "at") AS "start", allowed, count(*) AS n, round(sum(value), 2) AS value_sum, count(*) FILTER (WHERE value <= 25) AS under_25 FROM ev GROUP BY ALL"""
)
def i11_windowed_metrics(spark, sf):
    w = _events(spark, sf).groupBy(F.window("at", "1 hour").alias("w"), "allowed")
    out = w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value_sum"), F.count_if(F.col("value") <= 25).alias("under_25"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "allowed", "n", "value_sum", "under_25")

