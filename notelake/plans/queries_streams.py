"""Queries that land rows of the tables as exports or streams and read them back through the sources and jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from notelake.plans.inputs import NOTES, PAGES, memory, notes
from notelake.plans.queries_memory import FOLD
from notelake.plans.queries_sync import _EV, _events
from notelake.plans.registry import query, table
from notelake.sources import exports
from notelake.sources.notes import note_tree, read_jsonl, shared_folder, write_jsonl
from notelake.streaming import index, jobs, state


def _landed(spark, df, name, fmt="json"):
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.format(fmt).save(path)
    return path


@query(f"WITH {NOTES} SELECT count(*) AS notes, sum(length(body) + 1)::BIGINT AS chars FROM notes")
def a1_note_tree(spark, sf):
    """Notes written as files of text, a file per partition, and read back as a tree without hidden folders."""
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    n = notes(spark, sf)
    n.select("body").write.text(f"{root}/notes")
    n.select("body").write.text(f"{root}/.trash/notes")
    found = note_tree(spark, root)
    # one file holds many notes here; each starts with its frontmatter
    starts = F.size(F.regexp_extract_all("body", F.lit(r"(?m)^segment: "), F.lit(0)))
    return found.agg(F.sum(starts).cast("long").alias("notes"), F.sum(F.length("body")).alias("chars"))


@query(f"WITH {PAGES} SELECT 'http://x/' || page_id::VARCHAR AS external_id, 'Page ' || page_id::VARCHAR AS title, TIMESTAMP '2024-01-01' + to_hours(page_id) AS updated, md5(body) AS body_md5 FROM md")
def a5_feed(spark, sf):
    k = F.col("page_id").cast("string")
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, page_id, 0, 0)")
    text = F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    link = F.concat(F.lit("http://x/"), k)
    rows = table(spark, sf, "pages").select(link.alias("link"), F.concat(F.lit("Page "), k).alias("title"), F.col("html").alias("description"), text.alias("pubDate"))
    path = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    rows.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)
    return exports.feed(spark, path).select("external_id", "title", "updated", F.md5("body").alias("body_md5"))


@query(
    """SELECT 'K-' || conv_id::VARCHAR AS external_id, 'p' || (conv_id % 5)::VARCHAR || ' · ' || CASE WHEN conv_id % 2 = 0 THEN 'open' ELSE 'done' END || ' · unassigned' || chr(10) || chr(10) || '# Head' || chr(10) || chr(10) || 'said ' || conv_id::VARCHAR
      || chr(10) || chr(10) || string_agg('**' || role || '**: ' || text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id"""
)
def a8_tracker_export(spark, sf):
    c = table(spark, sf, "conversations")
    said = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("author"), F.col("text").alias("body")))), lambda x: F.struct(x["author"].alias("author"), x["body"].alias("body")))
    g = c.groupBy("conv_id").agg(said.alias("comments"))
    k = F.col("conv_id").cast("string")
    tree = F.concat(
        F.lit('{"type":"doc","content":[{"type":"heading","attrs":{"level":1},"content":[{"type":"text","text":"Head"}]},{"type":"paragraph","content":[{"type":"text","text":"said '), k, F.lit('"}]}]}')
    )
    fields = F.struct(
        F.lit("s").alias("summary"), tree.alias("description"), F.lit("2024-01-01").alias("updated"), F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string")).alias("project"),
        F.when(F.col("conv_id") % 2 == 0, "open").otherwise("done").alias("status"), F.lit(None).cast("string").alias("assignee"), "comments",
    )
    path = _landed(spark, g.select(F.array(F.struct(F.concat(F.lit("K-"), k).alias("key"), fields.alias("fields"))).alias("issues")), "tracker")
    return exports.tracker(spark, path).select("external_id", "body")


@query(f"WITH {PAGES} SELECT page_id::VARCHAR AS external_id, md5(body) AS body_md5, 's' || (page_id % 3)::VARCHAR AS space FROM md")
def a9_wiki_export(spark, sf):
    k = F.col("page_id").cast("string")
    rows = table(spark, sf, "pages").select(k.alias("id"), F.lit("t").alias("title"), F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")).alias("space"), F.struct(F.struct(F.col("html").alias("value")).alias("storage")).alias("body"), F.lit("2024-02").alias("updated"))
    return exports.wiki(spark, _landed(spark, rows, "wiki")).select("external_id", F.md5("body").alias("body_md5"), F.element_at("meta", F.lit("space")).alias("space"))


@query(
    """SELECT CASE WHEN conv_id % 2 = 0 THEN 'pull-' ELSE 'issue-' END || conv_id::VARCHAR AS external_id, CASE WHEN conv_id % 2 = 0 THEN 'pull' ELSE 'issue' END AS kind, 'bug,x' AS labels,
    string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id"""
)
def a10_code_export(spark, sf):
    c = table(spark, sf, "conversations")
    said = F.collect_list(F.struct(F.lpad(F.col("turn").cast("string"), 6, "0").alias("at"), F.col("role").alias("user"), F.col("text").alias("body")))
    g = c.groupBy(F.col("conv_id").alias("number")).agg(said.alias("comments"))
    pull = F.when(F.col("number") % 2 == 0, F.struct(F.lit("u").alias("url")))
    rows = g.select("number", F.lit("t").alias("title"), F.lit("").alias("body"), F.lit("me").alias("user"), F.lit("2024-01-01").alias("updated_at"), pull.alias("pull_request"), F.array(F.lit("bug"), F.lit("x")).alias("labels"), "comments")
    out = exports.code_host(spark, _landed(spark, rows, "code"))
    return out.select("external_id", F.element_at("meta", F.lit("kind")).alias("kind"), F.element_at("meta", F.lit("labels")).alias("labels"), "body")


@query("SELECT doc_id::VARCHAR AS external_id, source AS title, md5(text) AS body_md5 FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 28 + 1 > 10")
def a11_drive_export(spark, sf):
    k = F.col("doc_id")
    day = F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))
    kind = F.when(k % 3 == 0, "image/png").otherwise("text/plain")
    rows = table(spark, sf, "documents").select(k.cast("string").alias("id"), F.col("source").alias("name"), kind.alias("mimeType"), day.alias("modifiedTime"), "text")
    return exports.drive(spark, _landed(spark, rows, "drive"), "2024-01-10").select("external_id", "title", F.md5("body").alias("body_md5"))


@query("SELECT item_id AS q, text AS question FROM benchmark")
def a14_eval_set(spark, sf):
    path = f"{shared_folder(spark)}/set-{uuid.uuid4().hex}"
    write_jsonl(table(spark, sf, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("question")), path)
    return read_jsonl(spark, path, "q long, question string")


# -- streams

@query(f"WITH {_EV} SELECT id, caller, left(path, 512) AS path, allowed FROM ev WHERE NOT allowed OR restricted")
def i1_stream_ingest(spark, sf):
    return jobs.deliver(_events(spark, sf), "at", jobs.log_ingest, "append", "ingest").select("id", "caller", "path", "allowed")


@query(
    f"""WITH {_EV}, w AS (SELECT caller, date_trunc('minute', "at") AS minute FROM ev WHERE NOT allowed) SELECT caller, minute, least(count(*), 1) AS kept, greatest(count(*) - 1, 0) AS suppressed FROM w GROUP BY ALL"""
)
def i2_stream_denial_cap(spark, sf):
    out = jobs.newest(jobs.deliver(_events(spark, sf), "at", lambda s: jobs.denial_caps(s, 1), "update", "caps"), ["caller", "minute"])
    return out.select("caller", F.col("minute").cast("timestamp_ntz").alias("minute"), "kept", "suppressed")


_BUSY = f"""{_EV}, bz AS (SELECT id, 'u' || (id % 2)::VARCHAR AS caller, path, TIMESTAMP '2024-01-01' + to_seconds((id // 10)::BIGINT) AS "at" FROM ev WHERE NOT allowed),
    bn AS (SELECT *, date_trunc('minute', "at") AS minute, row_number() OVER (PARTITION BY caller, date_trunc('minute', "at") ORDER BY "at", id) AS r FROM bz)"""


@query(
    f"""WITH {_BUSY} SELECT caller, minute, id, path, NULL::BIGINT AS suppressed FROM bn WHERE r <= 20
    UNION ALL SELECT caller, minute, NULL, NULL, count(*) - 20 FROM bn GROUP BY caller, minute HAVING count(*) > 20"""
)
def i2_stream_capped_denials(spark, sf):
    """Denials squeezed into busy minutes: the first 20 of a minute pass, the number of the others comes when the minute is closed."""
    squeezed = _events(spark, sf).withColumns(
        {"caller": F.concat(F.lit("u"), (F.col("id") % 2).cast("string")), "at": F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, floor(id / 10))")}
    ).select("id", "caller", "path", "at", "allowed")
    # a denial long after the others moves the watermark past all minutes
    end = squeezed.agg(F.max("at").alias("at")).select(
        F.lit(-1).cast("long").alias("id"), F.lit("end").alias("caller"), F.lit("").alias("path"), F.expr("at + interval '1' day").alias("at"), F.lit(False).alias("allowed")
    )
    out = jobs.deliver(squeezed.unionByName(end), "at", lambda s: state.capped_denials(s, 20), "append", "capped")
    return out.where("caller <> 'end'").select("caller", F.col("minute").cast("timestamp_ntz").alias("minute"), "id", "path", "suppressed")


@query(
    f"""WITH {_EV}, k AS (SELECT *, lag("at") OVER (PARTITION BY path ORDER BY "at") AS b FROM ev),
    g AS (SELECT *, sum(CASE WHEN b IS NULL OR "at" >= b + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS s FROM k)
    SELECT path, min("at") AS first, max("at") AS last, count(*) AS n, arg_max(caller, ("at", id)) AS content FROM g GROUP BY path, s"""
)
def i8_stream_coalesced_edits(spark, sf):
    """Bursts as the stream closes them; a row from long after the last edit moves the watermark past all of them."""
    e = _events(spark, sf).select("path", "at", F.col("id").alias("seq"), F.col("caller").alias("content"))
    end = e.agg(F.max("at").alias("at")).select(
        F.lit("").alias("path"), F.expr("at + interval '30' day").alias("at"), F.lit(-1).cast("long").alias("seq"), F.lit("").alias("content")
    )
    out = jobs.deliver(e.unionByName(end), "at", lambda s: jobs.coalesced_edits(s, "6 hours"), "append", "edits")
    return out.where("path <> ''").select("path", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n", "content")


@query(
    f"""WITH {_EV}, c AS (SELECT path, arg_max('see [[' || caller || ']] worth ' || floor(value)::BIGINT::VARCHAR || ' of lot ' || (id % 7)::VARCHAR, ("at", id)) AS content FROM ev GROUP BY path),
    t AS (SELECT path, unnest(list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+'))) AS term FROM c)
    SELECT 'term' AS kind, term AS name, count(*) AS n FROM t GROUP BY term UNION ALL SELECT 'link', regexp_extract(content, '\\[\\[(.*?)\\]\\]', 1), count(*) FROM c GROUP BY ALL""".replace("\\\\", "\\")
)
def i8_stream_index(spark, sf):
    """The index behind coalesced edits, as it stands after the last delivery."""
    said = F.concat(F.lit("see [["), "caller", F.lit("]] worth "), F.floor("value").cast("string"), F.lit(" of lot "), (F.col("id") % 7).cast("string"))
    e = _events(spark, sf).select("path", "at", F.col("id").alias("seq"), said.alias("content"))
    end = e.agg(F.max("at").alias("at")).select(
        F.lit("").alias("path"), F.expr("at + interval '30' day").alias("at"), F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("content")
    )
    root = f"{shared_folder(spark)}/follow-{uuid.uuid4().hex}"
    index.follow(e.unionByName(end), root, "6 hours")
    now = index.current(spark, f"{root}/index")
    terms = now["frequencies"].select(F.lit("term").alias("kind"), F.col("term").alias("name"), F.col("df").alias("n"))
    return terms.unionByName(now["links"].groupBy(F.col("target").alias("name")).agg(F.count("*").alias("n")).select(F.lit("link").alias("kind"), "name", "n"))


@query("SELECT DISTINCT 'c' || (doc_id % 3)::VARCHAR AS connector, 'e' || (doc_id // 2)::VARCHAR AS external_id, md5((doc_id // 2)::VARCHAR) AS hash FROM documents")
def i7_stream_upserts(spark, sf):
    k = F.col("doc_id")
    half = F.floor(k / 2).cast("string")
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id)")
    rows = table(spark, sf, "documents").select(F.concat(F.lit("c"), (k % 3).cast("string")).alias("connector"), F.concat(F.lit("e"), half).alias("external_id"), F.md5(half).alias("hash"), at.alias("at"))
    # every page is delivered twice, the second time half an hour later
    p = rows.unionByName(rows.withColumn("at", F.expr("at + interval '30' minute")))
    return jobs.deliver(p, "at", jobs.connector_upserts, "append", "upserts").select("connector", "external_id", "hash")


@query(
    f"""WITH {_EV} SELECT time_bucket(INTERVAL 1 HOUR, "at") AS "start", allowed, count(*) AS n, round(sum(value), 2) AS value_sum FROM ev GROUP BY ALL"""
)
def i11_stream_metrics(spark, sf):
    out = jobs.newest(jobs.deliver(_events(spark, sf), "at", jobs.windowed_metrics, "update", "metrics"), ["start", "allowed"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "allowed", "n", F.round("value_sum", 2).alias("value_sum"))


@query(FOLD)
def i6_stream_reconcile(spark, sf):
    """Facts reconciled as they arrive, a scope per customer."""
    m = memory(spark, sf).select("cust", "id", "stamp", "text")
    return jobs.deliver(m, "stamp", lambda s: state.reconcile_stream(s, "cust"), "append", "reconcile").select("scope", "id", "op", "target", "challenges")
