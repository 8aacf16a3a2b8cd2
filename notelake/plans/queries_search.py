"""Queries of the aggregation and retrieval families."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.functions.text import tokens
from notelake.operators import extract as X
from notelake.operators import memory as M
from notelake.operators import overview as O
from notelake.operators import retrieval as V
from notelake.operators import search as R
from notelake.operators.embed import hash_tokens, hash_vectors
from notelake.plans.extraction import _STATEMENTS, LINKS, TAGS, words_sql
from notelake.plans.inputs import FACTS, NOTES, memory, notes
from notelake.plans.queries_links import _RESOLVED_SQL, NOW, _now, _resolved
from notelake.plans.registry import query, table

# -- aggregations


@query(f"WITH {NOTES}, {TAGS} SELECT tag, count(*) AS n FROM tags JOIN notes ON path = note WHERE NOT private GROUP BY tag")
def e1_tag_counts(spark, sf):
    n = notes(spark, sf)
    seen = n.where("not private").select(F.col("path").alias("note"))
    return X.tags(n).distinct().join(seen, "note", "left_semi").groupBy("tag").agg(F.count("*").alias("n"))


@query(
    f"""WITH {FACTS}, l AS (SELECT *, superseded_by IS NULL AND (expires IS NULL OR expires > TIMESTAMP '{NOW}') AS live FROM mem)
    SELECT agent, session, category, count(*) AS total, count(*) FILTER (WHERE live) AS live FROM l GROUP BY GROUPING SETS ((agent), (session), (category), ())"""
)
def e2_memory_facets(spark, sf):
    live = F.col("superseded_by").isNull() & (F.col("expires").isNull() | (F.col("expires") > _now()))
    sets = [[F.col("agent")], [F.col("session")], [F.col("category")], []]
    m = memory(spark, sf).withColumn("live", live)
    return m.groupingSets(sets, "agent", "session", "category").agg(F.count("*").alias("total"), F.count_if("live").alias("live"))


@query(
    """SELECT source, split_part(source, ':', 1) AS family, source NOT IN ('src0', 'src1', 'src2') AS untrusted, count(*) AS notes FROM documents GROUP BY source"""
)
def e3_trust_overview(spark, sf):
    d = table(spark, sf, "documents")
    untrusted = ~F.col("source").isin("src0", "src1", "src2")
    return d.groupBy("source").agg(F.count("*").alias("notes")).select(
        "source", F.split_part("source", F.lit(":"), F.lit(1)).alias("family"), untrusted.alias("untrusted"), "notes"
    )


@query(
    """WITH d AS (SELECT source, lang, length(text) AS c, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents)
    SELECT source, count(*) AS chunks, count(DISTINCT lang) AS langs, sum(c)::BIGINT AS chars, round(avg(t), 6) AS avg_tokens FROM d GROUP BY source"""
)
def e4_corpus_statistics(spark, sf):
    d = table(spark, sf, "documents").select("source", "lang", F.length("text").alias("c"), F.size(tokens(F.col("text"))).alias("t"))
    return d.groupBy("source").agg(
        F.count("*").alias("chunks"), F.count_distinct("lang").alias("langs"), F.sum("c").alias("chars"), F.round(F.avg("t"), 6).alias("avg_tokens")
    )


@query(
    """WITH t AS (SELECT lang, doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)
    SELECT lang, term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY lang, term"""
)
def e5_document_frequency(spark, sf):
    p = R.terms(table(spark, sf, "documents"), ["lang", "doc_id"], "text")
    return p.groupBy("lang", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(
    f"""WITH {NOTES}, {LINKS}, {_RESOLVED_SQL}, i AS (SELECT dst, count(DISTINCT src) AS inbound FROM resolved WHERE dst IS NOT NULL GROUP BY dst),
    s AS (SELECT path, coalesce(inbound, 0) AS inbound, greatest(date_diff('second', updated, TIMESTAMP '{NOW}') / 86400.0, 0) AS age FROM notes LEFT JOIN i ON dst = path WHERE updated IS NOT NULL)
    SELECT path, inbound, round(age, 4) AS age, round(age * (1 + ln(1 + inbound)), 4) AS staleness FROM s WHERE age > 180"""
)
def e6_staleness(spark, sf):
    n, r = _resolved(spark, sf)
    inbound = r.where("dst is not null").groupBy("dst").agg(F.count_distinct("src").alias("inbound"))
    age = F.greatest((F.unix_seconds(_now().cast("timestamp")) - F.unix_seconds(F.col("updated").cast("timestamp"))) / 86400.0, F.lit(0))
    s = n.where("updated is not null").join(inbound, n["path"] == inbound["dst"], "left").na.fill(0, ["inbound"]).withColumn("age", age)
    return s.where("age > 180").select("path", "inbound", F.round("age", 4).alias("age"), F.round(F.col("age") * (1 + F.log1p("inbound")), 4).alias("staleness"))


@query(f"SELECT o_orderkey, round(date_diff('second', o_orderdate, TIMESTAMP '{NOW}') / 86400.0, 4) AS age, o_orderdate IS NOT NULL AS known, date_diff('second', o_orderdate, TIMESTAMP '{NOW}') / 86400.0 > 180 AS stale FROM orders")
def e7_freshness(spark, sf):
    age = (F.unix_seconds(_now().cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))) / 86400.0
    return table(spark, sf, "orders").select("o_orderkey", F.round(age, 4).alias("age"), F.col("o_orderdate").isNotNull().alias("known"), (age > 180).alias("stale"))


_BUCKETS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 1e9)
_ROUTE = "CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'read' WHEN 'error' THEN 'other' ELSE 'write' END"
_STATUS = "CASE event_type WHEN 'error' THEN '4xx' ELSE '2xx' END"


@query(
    f"""WITH e AS (SELECT {_ROUTE} AS route, {_STATUS} AS status, value FROM events), b AS (SELECT unnest({list(_BUCKETS)}) AS le)
    SELECT route, status, le::DOUBLE AS le, count(*) FILTER (WHERE value <= le) AS n, count(*) AS total, round(sum(value), 2) AS value_sum FROM e, b GROUP BY route, status, le"""
)
def e8_latency_histogram(spark, sf):
    e = table(spark, sf, "events").select(F.expr(_ROUTE).alias("route"), F.expr(_STATUS).alias("status"), "value")
    counts = [F.count_if(F.col("value") <= le).alias(f"le{i}") for i, le in enumerate(_BUCKETS)]
    wide = e.groupBy("route", "status").agg(*counts, F.count("*").alias("total"), F.round(F.sum("value"), 2).alias("value_sum"))
    pairs = F.array(*[F.struct(F.lit(le).alias("le"), F.col(f"le{i}").alias("n")) for i, le in enumerate(_BUCKETS)])
    return wide.select("route", "status", F.explode(pairs).alias("p"), "total", "value_sum").select("route", "status", "p.le", "p.n", "total", "value_sum")


@query("SELECT event_type, user_id % 5 AS shard, count(*) AS n, round(sum(value), 2) AS value_sum FROM events GROUP BY ALL")
def e9_counters(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type", (F.col("user_id") % 5).alias("shard")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value_sum"))


@query(
    """WITH w AS (SELECT lang, source, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words FROM documents)
    SELECT lang, count(*) AS notes, count(DISTINCT source) AS sources, sum(words)::BIGINT AS words FROM w GROUP BY lang""".replace("\\\\", "\\")
)
def e10_vault_stats(spark, sf):
    words = F.size(F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda x: x != ""))
    d = table(spark, sf, "documents").withColumn("words", words)
    return d.groupBy("lang").agg(F.count("*").alias("notes"), F.count_distinct("source").alias("sources"), F.sum("words").alias("words"))


@query(
    f"""WITH {_STATEMENTS}, s AS (SELECT DISTINCT statement AS text FROM st), w AS (SELECT text, unnest({words_sql('text')}) AS w FROM s), z AS (SELECT text, count(*) AS n FROM w GROUP BY text),
    i AS (SELECT a.text AS a, b.text AS b, count(*) AS shared FROM w a JOIN w b USING (w) WHERE a.text < b.text GROUP BY ALL)
    SELECT i.a, i.b, round(shared / (za.n + zb.n - shared), 4) AS similarity FROM i JOIN z za ON za.text = i.a JOIN z zb ON zb.text = i.b WHERE shared / (za.n + zb.n - shared) >= 0.5"""
)
def e12_statement_similarity(spark, sf):
    said = table(spark, sf, "conversations").select(F.explode(X.statements(F.col("text"))).alias("text"))
    return M.similar_statements(said, 0.5).withColumn("similarity", F.round("similarity", 4))


@query(
    f"""WITH {NOTES}, s AS (SELECT path, title, 0 AS section, row_number() OVER (ORDER BY updated DESC NULLS LAST, path) AS r FROM notes WHERE pinned
      UNION ALL SELECT path, title, 1, row_number() OVER (ORDER BY updated DESC NULLS LAST, path) FROM notes WHERE segment = 'building'
      UNION ALL SELECT path, title, 2, row_number() OVER (ORDER BY updated DESC NULLS LAST, path) FROM notes),
    f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY section) AS again FROM s WHERE r <= 30)
    SELECT path, title, section, r::INT AS r FROM f WHERE again = 1"""
)
def e13_briefing(spark, sf):
    n = notes(spark, sf)
    parts = None
    for i, rows in enumerate((n.where("pinned"), n.where("segment = 'building'"), n)):
        top = rows.orderBy(F.desc_nulls_last("updated"), "path").limit(30)
        r = F.row_number().over(Window.orderBy(F.desc_nulls_last("updated"), "path"))
        one = top.select("path", "title", F.lit(i).alias("section"), r.alias("r"))
        parts = one if parts is None else parts.unionByName(one)
    again = F.row_number().over(Window.partitionBy("path").orderBy("section"))
    return parts.withColumn("again", again).where("again = 1").drop("again")


@query(
    f"""WITH {NOTES}, {TAGS}, t AS (SELECT tag, count(DISTINCT note) AS n FROM tags GROUP BY tag)
    SELECT 'total' AS kind, 'notes' AS name, count(*) AS n FROM notes UNION ALL SELECT 'total', 'tags', count(*) FROM t UNION ALL (SELECT 'tag', tag, n FROM t ORDER BY n DESC, tag LIMIT 5)
    UNION ALL SELECT 'words', strftime(updated, '%Y-%m-%d'), sum(len(list_filter(string_split_regex(body, '\\s+'), lambda x: x <> '')))::BIGINT FROM notes WHERE updated IS NOT NULL GROUP BY ALL""".replace("\\\\", "\\")
)
def e10_vault_panel(spark, sf):
    n = notes(spark, sf)
    return O.vault_stats(n, X.tags(n))


@query(
    f"""WITH {NOTES}, {TAGS}, {FACTS}, o AS (SELECT * FROM notes WHERE NOT private),
    s AS (SELECT 0 AS i, 'pinned' AS section, * FROM (SELECT path, title, updated FROM o WHERE pinned ORDER BY updated DESC NULLS LAST, path LIMIT 10)
      UNION ALL SELECT 1, 'onboarding', * FROM (SELECT path, title, updated FROM o WHERE path IN (SELECT note FROM tags WHERE tag = 'vip/building') ORDER BY updated DESC NULLS LAST, path LIMIT 10)
      UNION ALL SELECT 2, 'recent_memories', * FROM (SELECT path, title, updated FROM o WHERE starts_with(path, 'asia/') ORDER BY updated DESC NULLS LAST, path LIMIT 5)),
    u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY path ORDER BY i) = 1), f AS (SELECT id, text, stamp FROM mem WHERE superseded_by IS NULL AND (expires IS NULL OR expires > TIMESTAMP '{NOW}') ORDER BY stamp DESC, id LIMIT 5),
    w AS (SELECT CASE WHEN num % 13 = 0 THEN 'retracted:' || agent ELSE superseded_by END AS by_ FROM mem WHERE superseded_at > TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND superseded_at <= TIMESTAMP '{NOW}')
    SELECT section, (row_number() OVER (PARTITION BY section ORDER BY updated DESC NULLS LAST, path))::INT AS place, path AS key, title FROM u
    UNION ALL SELECT 'recent_facts', (row_number() OVER (ORDER BY stamp DESC, id))::INT, id, text FROM f
    UNION ALL SELECT 'belief_changes', 1, 'changed', (count(*) FILTER (WHERE NOT starts_with(by_, 'retracted:')))::VARCHAR FROM w UNION ALL SELECT 'belief_changes', 2, 'retracted', (count(*) FILTER (WHERE starts_with(by_, 'retracted:')))::VARCHAR FROM w"""
)
def e13_full_briefing(spark, sf):
    n = notes(spark, sf)
    facts = memory(spark, sf)
    retracted = F.when((F.col("num") % 13 == 0) & F.col("superseded_by").isNotNull(), F.concat(F.lit("retracted:"), "agent")).otherwise(F.col("superseded_by"))
    return O.briefing(n, X.tags(n), facts.withColumn("superseded_by", retracted), _now(), 5, "vip/building", "asia/")


# -- retrieval over documents, one chunk a row; queries are the benchmark texts

_TOK = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
POSTINGS = f"""
q AS (SELECT item_id AS qid, text FROM benchmark),
p AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY ALL),
ln_ AS (SELECT doc_id AS id, len({_TOK.format('text')}) AS n_tokens FROM documents),
st AS (SELECT count(*) AS n, avg(n_tokens) AS avg_len FROM ln_),
dfs AS (SELECT term, ln(any_value(n) / count(*)) AS idf, any_value(avg_len) AS avg_len FROM p, st GROUP BY term),
qt AS (SELECT DISTINCT qid, unnest({_TOK.format('text')}) AS term FROM q),
lexical AS (SELECT qid, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / avg_len))), 6) AS lex
            FROM qt JOIN p USING (term) JOIN dfs USING (term) JOIN ln_ USING (id) WHERE idf > 0 GROUP BY qid, id)"""
_HASHED = """
h{0} AS (SELECT id, ('0x' || substr(m, 31, 2))::INT AS b, sum(CASE WHEN ('0x' || substr(m, 29, 2))::INT % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x
         FROM (SELECT {1} AS id, md5(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS m FROM {2}) GROUP BY ALL),
n{0} AS (SELECT id, sqrt(sum(x * x)) AS norm FROM h{0} GROUP BY id),
v{0} AS (SELECT id, b, x / norm AS w FROM h{0} JOIN n{0} USING (id) WHERE norm > 0)"""
SEMANTIC = _HASHED.format("d", "doc_id", "documents") + "," + _HASHED.format("q", "qid", "q") + """,
semantic AS (SELECT vq.id AS qid, vd.id AS id, round(sum(vq.w * vd.w), 6) AS cos FROM vq JOIN vd USING (b) GROUP BY ALL HAVING round(sum(vq.w * vd.w), 6) > 0)"""
FUSED = """
both_ AS (SELECT qid, id, coalesce(lex, 0.0) AS lex, coalesce(cos, 0.0) AS cos FROM lexical FULL JOIN semantic USING (qid, id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lex DESC, id) - 1 AS r1, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) - 1 AS r2 FROM both_ WHERE lex > 0 OR cos > 0),
fused AS (SELECT *, 1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2) AS score FROM rk),
hits AS (SELECT qid, id, lex, cos, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1)::INT AS rank FROM fused)"""
HYBRID = f"{POSTINGS},{SEMANTIC},{FUSED}"


def _asked(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")
    )


def _lexical(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.lexical(d, _asked(spark, sf))


def hybrid_hits(spark, sf, k=8):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return V.hybrid_search(d, table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text"), k, embed=hash_tokens)


@query(f"WITH {POSTINGS} SELECT qid, id, lex FROM lexical")
def f1_bm25(spark, sf):
    return _lexical(spark, sf)


@query(
    """WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0),
    c AS (SELECT qid, vec_id AS id, round(list_cosine_similarity(e, embedding::DOUBLE[]), 6) AS cos FROM q, embeddings)
    SELECT * FROM c WHERE cos > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) <= 50"""
)
def f2_dense(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R.dense(v, v.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding"), best=50)


@query(f"WITH {HYBRID} SELECT qid, id, lex, cos, round(score, 9) AS score, rank FROM hits WHERE rank < 100")
def f3_fusion(spark, sf):
    return hybrid_hits(spark, sf, 100).withColumn("score", F.round("score", 9))


@query(
    f"""WITH {HYBRID}, s AS (SELECT hits.*, source AS note FROM hits JOIN documents ON doc_id = id WHERE rank < 60),
    g AS (SELECT *, row_number() OVER (PARTITION BY qid, note ORDER BY rank) > 1 AS again FROM s),
    o AS (SELECT qid, note, id, (row_number() OVER (PARTITION BY qid ORDER BY again, rank))::INT AS place FROM g) SELECT * FROM o WHERE place <= 25"""
)
def f4_best_per_note(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("note"))
    return R.best_per_note(hybrid_hits(spark, sf, 60).join(d, "id"), ["qid"], 8).select("qid", "note", "id", "place")


@query(
    f"""WITH {HYBRID}, c AS (SELECT 'n' || (doc_id // 10)::VARCHAR AS note, (doc_id % 10)::INT AS chunk_idx, text, doc_id FROM documents),
    t AS (SELECT qid, rank + 1 AS place, note, chunk_idx FROM hits JOIN c ON doc_id = id WHERE rank < 3),
    w AS (SELECT qid, place, note, unnest(range(chunk_idx - 1, chunk_idx + 2)) AS chunk_idx FROM t),
    x AS (SELECT w.qid, w.place, w.note, w.chunk_idx, text, lag(w.chunk_idx) OVER (PARTITION BY qid, place, w.note ORDER BY w.chunk_idx) AS b FROM w JOIN c ON c.note = w.note AND c.chunk_idx = w.chunk_idx)
    SELECT qid, place::INT AS place, note, md5(string_agg(CASE WHEN chunk_idx - b > 1 THEN '[…]' || chr(10) || text ELSE text END, chr(10) ORDER BY chunk_idx)) AS passage_md5 FROM x GROUP BY qid, place, note"""
)
def f5_passages(spark, sf):
    d = F.col("doc_id")
    c = table(spark, sf, "documents").select(
        F.concat(F.lit("n"), F.floor(d / 10).cast("string")).alias("note"), (d % 10).cast("int").alias("chunk_idx"), "text", d.alias("id")
    )
    hits = hybrid_hits(spark, sf, 3).withColumn("place", F.col("rank") + 1).join(c.drop("text"), "id")
    return R.passages(hits, c, ["qid"]).select("qid", "place", "note", F.md5("passage").alias("passage_md5"))


@query(
    f"""WITH {HYBRID}, c AS (SELECT doc_id // 10 AS note, (doc_id % 10)::INT AS chunk_idx, text, doc_id AS id FROM documents), h AS (SELECT qid, id, note, chunk_idx, rank, score FROM hits JOIN c USING (id)),
    o AS (SELECT *, row_number() OVER (PARTITION BY qid, note ORDER BY rank) AS own FROM h), f AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY rank))::INT AS place FROM o WHERE own = 1 QUALIFY place <= 8),
    w AS (SELECT qid, place, note, chunk_idx AS part FROM f UNION SELECT f.qid, place, f.note, o.chunk_idx FROM f JOIN o ON o.qid = f.qid AND o.note = f.note WHERE place <= 3 AND o.own <= 3
      UNION SELECT qid, place, note, unnest([chunk_idx - 1, chunk_idx + 1]) FROM f WHERE place <= 3),
    x AS (SELECT qid, place, w.note, part, text, lag(part) OVER (PARTITION BY qid, place ORDER BY part) AS b FROM w JOIN c ON c.note = w.note AND c.chunk_idx = part)
    SELECT qid, place, note, md5(string_agg(CASE WHEN part - b > 1 THEN '[…]' || chr(10) || text ELSE text END, chr(10) ORDER BY part)) AS passage_md5 FROM x GROUP BY qid, place, note"""
)
def f5_merged_passages(spark, sf):
    d = F.col("doc_id")
    chunks = table(spark, sf, "documents").select(d.alias("id"), F.floor(d / 10).alias("note"), (d % 10).cast("int").alias("chunk_idx"), "text")
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return V.merged_passages(chunks, queries, 8, hash_tokens).select("qid", "place", "note", F.md5("passage").alias("passage_md5"))


@query(f"WITH {HYBRID} SELECT qid, id, rank, round(score, 9) AS score FROM hits WHERE rank < 5")
def f6_hybrid_search(spark, sf):
    return hybrid_hits(spark, sf, 5).select("qid", "id", "rank", F.round("score", 9).alias("score"))


# -- the same for principals: ten documents are a note, which has a space, readers and a trust level

_MARKED = """dn AS (SELECT doc_id AS id, doc_id // 10 AS note, text, 's' || (doc_id // 10 % 3)::VARCHAR AS space, doc_id // 10 % 7 = 0 AS private, doc_id // 10 % 5 < 2 AS untrusted,
  CASE WHEN doc_id // 10 % 4 = 0 THEN ['u2', 'u' || (doc_id // 10 % 25)::VARCHAR] ELSE [] END AS readers FROM documents),
pr AS (SELECT 'u' || n_nationkey::VARCHAR AS usr, CASE WHEN n_nationkey % 6 = 0 THEN NULL WHEN n_nationkey % 6 = 1 THEN [] ELSE ['s' || (n_nationkey % 3)::VARCHAR, 's' || (n_nationkey % 2)::VARCHAR] END AS spaces,
  n_nationkey % 2 = 0 AS include_private, n_nationkey % 3 = 0 AS trusted_only FROM nation),
dv AS (SELECT usr, dn.* FROM dn JOIN pr ON (spaces IS NULL OR list_contains(spaces, space)) AND (include_private OR NOT private)
  AND (len(readers) = 0 OR list_contains(readers, usr)) AND (NOT trusted_only OR NOT untrusted))"""


def _marked(spark, sf):
    d = F.col("doc_id")
    note = F.floor(d / 10)
    readers = F.when(note % 4 == 0, F.array(F.lit("u2"), F.concat(F.lit("u"), (note % 25).cast("string")))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "documents").select(
        d.alias("id"), note.alias("note"), "text", F.concat(F.lit("s"), (note % 3).cast("string")).alias("space"), (note % 7 == 0).alias("private"), (note % 5 < 2).alias("untrusted"), readers.alias("readers")
    )


def _askers(spark, sf):
    k = F.col("n_nationkey")
    two = F.array(F.concat(F.lit("s"), (k % 3).cast("string")), F.concat(F.lit("s"), (k % 2).cast("string")))
    spaces = F.when(k % 6 == 0, F.lit(None)).when(k % 6 == 1, F.array().cast("array<string>")).otherwise(two)
    return table(spark, sf, "nation").select(F.concat(F.lit("u"), k.cast("string")).alias("user"), spaces.alias("spaces"), (k % 2 == 0).alias("include_private"), (k % 3 == 0).alias("trusted_only"))


@query(
    f"""WITH {_MARKED} SELECT usr AS "user", count(*) AS chunks, count(DISTINCT note) AS notes, sum(length(text))::BIGINT AS chars, sum(len({_TOK.format('text')}))::BIGINT AS tokens,
    round(avg(len({_TOK.format('text')})), 6) AS avg_tokens FROM dv GROUP BY usr"""
)
def e4_principal_statistics(spark, sf):
    return V.statistics_as(_marked(spark, sf), _askers(spark, sf)).withColumn("avg_tokens", F.round("avg_tokens", 6))


@query(
    f"""WITH {_MARKED}, q AS (SELECT DISTINCT unnest({_TOK.format('text')}) AS term FROM benchmark), t AS (SELECT id, unnest({_TOK.format('text')}) AS term FROM documents JOIN dn ON id = doc_id),
    c AS (SELECT id, term, count(*) AS tf FROM t SEMI JOIN q USING (term) GROUP BY id, term)
    SELECT usr AS "user", term, count(*) AS df, sum(tf)::BIGINT AS tf FROM c JOIN dv USING (id) GROUP BY usr, term""".replace("SELECT id, unnest(regexp_extract_all(lower(text)", "SELECT id, unnest(regexp_extract_all(lower(documents.text)")
)
def e5_principal_frequency(spark, sf):
    terms = table(spark, sf, "benchmark").select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    users = _askers(spark, sf).select("user")
    # every user asks about every term: 25 users here
    asked = terms.withColumn("user", F.explode(F.array(*[F.lit(f"u{i}") for i in range(25)]))).join(users, "user", "left_semi")
    return V.frequencies_as(_marked(spark, sf), _askers(spark, sf), asked)


@query(
    f"""WITH {_MARKED},{POSTINGS.split("st AS")[0]}{SEMANTIC.lstrip()},
    qt AS (SELECT DISTINCT qid, unnest({_TOK.format('text')}) AS term FROM q), pt AS (SELECT * FROM p WHERE term IN (SELECT term FROM qt)),
    us AS (SELECT usr, count(*) AS n, avg(n_tokens) AS avg_len FROM dv JOIN ln_ USING (id) GROUP BY usr),
    ud AS (SELECT usr, term, ln(any_value(n) / count(*)) AS idf, any_value(avg_len) AS avg_len FROM pt JOIN dv USING (id) JOIN us USING (usr) GROUP BY usr, term),
    ul AS (SELECT usr, qid, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / avg_len))), 6) AS lex
      FROM qt JOIN pt USING (term) JOIN dv USING (id) JOIN ud USING (usr, term) JOIN ln_ USING (id) WHERE idf > 0 GROUP BY usr, qid, id),
    uc AS (SELECT usr, qid, id, cos FROM semantic JOIN dv USING (id)),
    ub AS (SELECT usr, qid, id, coalesce(lex, 0.0) AS lex, coalesce(cos, 0.0) AS cos FROM ul FULL JOIN uc USING (usr, qid, id)),
    ur AS (SELECT *, row_number() OVER (PARTITION BY usr, qid ORDER BY lex DESC, id) - 1 AS r1, row_number() OVER (PARTITION BY usr, qid ORDER BY cos DESC, id) - 1 AS r2 FROM ub WHERE lex > 0 OR cos > 0),
    uf AS (SELECT *, 1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2) AS score FROM ur),
    uh AS (SELECT usr, qid, id, lex, cos, score, (row_number() OVER (PARTITION BY usr, qid ORDER BY score DESC, id) - 1)::INT AS rank FROM uf)
    SELECT usr AS "user", qid, id, rank, lex, round(score, 9) AS score FROM uh WHERE rank < 5"""
)
def f6_principal_search(spark, sf):
    """Every principal asks every question."""
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    asks = queries.select(F.explode(F.array(*[F.lit(f"u{i}") for i in range(25)])).alias("user"), "qid")
    found = V.search_as(_marked(spark, sf), queries, asks, _askers(spark, sf), 5, embed=hash_tokens)
    return found.select("user", "qid", "id", "rank", "lex", F.round("score", 9).alias("score"))


@query(
    f"""WITH {POSTINGS}, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY lex DESC, id) AS r FROM lexical),
    u AS (SELECT qid, id, (r - 1)::INT AS rank, sum(length(text)) OVER (PARTITION BY qid ORDER BY r)::BIGINT AS used FROM r JOIN documents ON doc_id = id) SELECT * FROM u WHERE used <= 20000"""
)
def f7_lexical_baseline(spark, sf):
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("lex"), "id")) - 1
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n"), "text")
    hits = _lexical(spark, sf).withColumn("rank", rank).join(d, "id")
    return R.budgeted(hits, ["qid"], ["rank"], "text", 20_000).select("qid", "id", "rank", "used")


@query(
    f"""WITH {HYBRID}, s AS (SELECT qid // 2 AS qid, qid % 2 AS sub_id, id, rank, source AS note, text FROM hits JOIN documents ON doc_id = id WHERE rank < 8),
    g AS (SELECT *, row_number() OVER (PARTITION BY qid, note, left(text, 80) ORDER BY rank, sub_id) AS again FROM s),
    o AS (SELECT qid, id, sub_id, (row_number() OVER (PARTITION BY qid ORDER BY rank, sub_id, note))::INT AS place FROM g WHERE again = 1) SELECT * FROM o WHERE place <= 8"""
)
def f8_subquery_pool(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("note"), "text")
    h = hybrid_hits(spark, sf, 8).join(d, "id").withColumn("sub_id", F.col("qid") % 2).withColumn("qid", F.floor(F.col("qid") / 2))
    return R.pool_subqueries(h, 8).select("qid", "id", "sub_id", "place")


@query(
    f"""WITH {HYBRID}, o AS (SELECT qid, id, id % 5 AS pos FROM hits WHERE rank < 8 AND id % 3 = 0)
    SELECT h.qid, h.id, (row_number() OVER (PARTITION BY h.qid ORDER BY pos NULLS LAST, rank) - 1)::INT AS new_rank FROM hits h LEFT JOIN o USING (qid, id) WHERE rank < 8"""
)
def f9_external_rerank(spark, sf):
    h = hybrid_hits(spark, sf, 8)
    order = h.where("id % 3 = 0").select("qid", "id", (F.col("id") % 5).alias("pos"))
    return R.rerank(h, order, ["qid"]).select("qid", "id", "new_rank")


_PREFIXED = "left(regexp_extract_all(lower(text), '[a-z0-9]+')[2], 4) || ' ' || left(regexp_extract_all(lower(text), '[a-z0-9]+')[3], 5)"


@query(
    f"""WITH {POSTINGS.replace("item_id AS qid, text FROM", f"item_id AS qid, {_PREFIXED} AS text FROM")}, n AS (SELECT qid, count(*) AS needed FROM qt GROUP BY qid),
    m AS (SELECT qid, id, count(DISTINCT qt.term) AS matched FROM qt JOIN p ON starts_with(p.term, qt.term) GROUP BY ALL), f AS (SELECT * FROM m JOIN n USING (qid))
    SELECT qid, id, matched, 'all' AS mode FROM f WHERE matched = needed UNION ALL
    SELECT qid, id, matched, 'any' FROM f WHERE needed > 1 AND qid NOT IN (SELECT qid FROM f WHERE matched = needed)"""
)
def f10_prefix_search(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    t = tokens(F.col("text"))
    q = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"), F.concat_ws(" ", F.left(F.get(t, F.lit(1)), F.lit(4)), F.left(F.get(t, F.lit(2)), F.lit(5))).alias("text")
    )
    return R.prefix_search(R.terms(d, ["id"], "text"), q)


@query(
    f"""WITH q AS (SELECT item_id AS qid, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[2:4], ' ') || ' ' AS ph FROM benchmark),
    d AS (SELECT doc_id AS id, ' ' || array_to_string({_TOK.format('text')}, ' ') || ' ' AS t FROM documents)
    SELECT qid, id FROM q JOIN d ON contains(t, ph)"""
)
def f11_phrase_search(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(F.slice(tokens(F.col("text")), F.lit(2), F.lit(3)), " ").alias("text"))
    return R.phrase_search(d, q)


@query(
    """WITH w AS (SELECT doc_id, string_split_regex(text, '[ \n]+') AS w FROM documents),
    a AS (SELECT doc_id, w, list_position(list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), 'the') AS hit FROM w),
    s AS (SELECT *, greatest(hit - 3, 1) AS st FROM a WHERE hit > 0),
    u AS (SELECT doc_id, hit, st, unnest(w[st:st + 11]) AS x, unnest(range(len(w[st:st + 11]))) AS i FROM s)
    SELECT doc_id, string_agg(CASE WHEN i + st = hit THEN '[' || x || ']' ELSE x END, ' ' ORDER BY i) AS snippet FROM u GROUP BY doc_id"""
)
def f13_snippet(spark, sf):
    # texts without the word leave no row; a filter behind the column would work it out twice
    found = F.array_compact(F.array(R.snippet(F.col("text"), F.lit("the"))))
    return table(spark, sf, "documents").select("doc_id", F.explode(found).alias("snippet"))


@query(
    """WITH c AS (SELECT source AS note, doc_id AS chunk_idx, text, contains(lower(text), 'the')::INT + contains(lower(text), 'tion')::INT + contains(lower(text), 'mente')::INT AS score FROM documents),
    u AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY note ORDER BY score DESC, chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c)
    SELECT note, md5(string_agg(text, chr(10) ORDER BY chunk_idx)) AS excerpt_md5 FROM u WHERE used < 2400 AND score > 0 GROUP BY note"""
)
def f14_excerpt(spark, sf):
    c = table(spark, sf, "documents").select(F.col("source").alias("note"), F.col("doc_id").alias("chunk_idx"), "text")
    return R.excerpt(c, ["the", "tion", "mente"]).select("note", F.md5("excerpt").alias("excerpt_md5"))


_CUT = r"CASE WHEN length(text) > 400 THEN regexp_replace(left(text, 400), '[ \n]+[^ \n]*$', '…') ELSE text END"


@query(
    f"""WITH {HYBRID} SELECT qid, md5(string_agg('[' || (rank + 1)::VARCHAR || '] ' || {_CUT} || CASE WHEN doc_id % 3 = 0 THEN ' (untrusted)' ELSE '' END, chr(10) ORDER BY rank)) AS answer_md5
    FROM hits JOIN documents ON doc_id = id WHERE rank < 4 GROUP BY qid"""
)
def f15_extractive_answer(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 3 == 0).alias("untrusted"))
    h = hybrid_hits(spark, sf, 4).join(d, "id")
    return R.extractive_answer(h, ["qid"]).select("qid", F.md5("answer").alias("answer_md5"))


@query(
    """SELECT page_id, md5(CASE WHEN page_id % 2 = 0 THEN '<<<untrusted' || chr(10) || replace(replace(html || '<<<x>>>', '<<<', '< < <'), '>>>', '> > >') || chr(10) || 'untrusted>>>' ELSE html || '<<<x>>>' END) AS fenced_md5 FROM pages"""
)
def f16_fence(spark, sf):
    text = F.concat("html", F.lit("<<<x>>>"))
    return table(spark, sf, "pages").select("page_id", F.md5(R.fence(text, F.col("page_id") % 2 == 0)).alias("fenced_md5"))


@query(
    f"""WITH {HYBRID}, s AS (SELECT qid, 0 AS leg, id, rank FROM hits WHERE rank < 4 UNION ALL
      SELECT qid, 1, id, (row_number() OVER (PARTITION BY qid ORDER BY lex DESC, id) - 1)::INT FROM lexical),
    d AS (SELECT s.*, source, text, row_number() OVER (PARTITION BY qid, source, left(text, 64) ORDER BY leg, rank) AS again FROM s JOIN documents ON doc_id = id WHERE rank < 6),
    o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY leg, rank) AS place FROM d WHERE again = 1)
    SELECT qid, md5(string_agg('### ' || source || chr(10) || text, chr(10) || chr(10) ORDER BY place)) AS context_md5, count(*) AS passages FROM o WHERE place <= 6 GROUP BY qid"""
)
def f19_reader_context(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    a = hybrid_hits(spark, sf, 4).select("qid", F.lit(0).alias("leg"), "id", "rank")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("lex"), "id")) - 1
    b = _lexical(spark, sf).withColumn("rank", rank).where("rank < 6").select("qid", F.lit(1).alias("leg"), "id", "rank")
    same = Window.partitionBy("qid", "source", F.left("text", F.lit(64))).orderBy("leg", "rank")
    once = a.unionByName(b).join(d, "id").withColumn("again", F.row_number().over(same)).where("again = 1")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("leg", "rank"))).where("place <= 6")
    part = F.struct("place", F.concat(F.lit("### "), "source", F.lit("\n"), "text").alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"])
    return placed.groupBy("qid").agg(F.md5(F.array_join(ordered, "\n\n")).alias("context_md5"), F.count("*").alias("passages"))


@query(
    f"""WITH u AS (SELECT conv_id AS qid, text FROM conversations WHERE turn = 0 AND text IS NOT NULL), w_ AS (SELECT qid, list_sort(list_distinct(list_filter({_TOK.format('text')}, lambda w: length(w) > 3)))[1:2] AS w FROM u),
    d AS (SELECT doc_id, source, list_distinct({_TOK.format('text')}) AS t FROM documents), m AS (SELECT DISTINCT qid, source AS note FROM w_, d WHERE len(w) = 2 AND list_has_all(t, w)),
    q AS (SELECT * FROM u WHERE qid NOT IN (SELECT qid FROM m)),{_HASHED.format('d', 'doc_id', 'documents')},{_HASHED.format('q', 'qid', 'q')},
    c AS (SELECT vq.id AS qid, vd.id AS id, round(sum(vq.w * vd.w), 6) AS cos FROM vq JOIN vd USING (b) GROUP BY ALL HAVING round(sum(vq.w * vd.w), 6) > 0),
    r AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) <= 15)
    SELECT qid, note, 'words' AS how FROM m UNION ALL SELECT DISTINCT qid, source, 'meaning' FROM r JOIN documents ON doc_id = id"""
)
def f18_all_words_recall(spark, sf):
    """Notes that hold the two first words of a question; for questions that no note answers, those of the 15 nearest documents."""
    asked = table(spark, sf, "conversations").where("turn = 0 and text is not null").select(F.col("conv_id").alias("qid"), "text")
    words = F.slice(F.sort_array(F.array_distinct(F.filter(tokens(F.col("text")), lambda x: F.length(x) > 3))), F.lit(1), F.lit(2))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("note"), "text")
    return R.recall_notes(d, hash_vectors(d, "id", "text"), asked.withColumn("words", words).where("size(words) = 2"), asked, hash_vectors, 15)
