"""Queries of the memory family."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.functions.text import content_id
from notelake.operators import memory as M
from notelake.operators import search as R
from notelake.operators.embed import hash_token_rows, hash_vectors
from notelake.functions.statements import GENERIC_TERMS, VALUE_PATTERNS
from notelake.plans.extraction import ATTRIBUTE, NORMAL, attribute_sql, negation_sql, slot_sql, values_sql, words_sql
from notelake.plans.inputs import FACTS, memory
from notelake.plans.queries_links import NOW, _now
from notelake.plans.queries_search import _HASHED
from notelake.plans.registry import query, table

_LIVE = f"superseded_by IS NULL AND NOT coalesce(expires <= TIMESTAMP '{NOW}', false)"


def _asked(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        k.cast("long").alias("qid"), F.concat(F.lit("Which customer "), (k * 100 + 7).cast("string"), F.lit(" prefers urgent or low")).alias("text")
    )


_FQ = f"""
f AS (SELECT * FROM mem), q AS (SELECT n_nationkey::BIGINT AS qid, 'Which customer ' || (n_nationkey * 100 + 7)::VARCHAR || ' prefers urgent or low' AS text FROM nation),
ft AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM f),
qt AS (SELECT qid, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM q),
w AS (SELECT term, ln(1 + ((SELECT count(*) FROM f) - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM ft GROUP BY term),
qw AS (SELECT qid, term, coalesce(w, 1.0) AS w FROM qt LEFT JOIN w USING (term)),
kw AS (SELECT qid, id, sum(qw.w) / any_value(full_) AS keyword FROM ft JOIN qw USING (term) JOIN (SELECT qid, sum(w) AS full_ FROM qw GROUP BY qid) USING (qid) GROUP BY qid, id)"""
_ENT = r"""list_filter(list_distinct(list_transform(list_concat(regexp_extract_all({0}, '[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)+'), regexp_extract_all({0}, '[A-Z]{{2,}}[0-9]*'), regexp_extract_all({0}, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')), lambda x: lower(trim(x)))),
 lambda x: length(x) > 1 AND x NOT IN ('the','a','an','this','that','these','those','it','in','on','of','for','and','but','we','i','to','he','she'))"""


@query(
    f"""WITH {FACTS}, {_FQ},{_HASHED.format('d', 'id', 'f')},{_HASHED.format('q', 'qid', 'q')},
    sem AS (SELECT vq.id AS qid, vd.id AS id, round(sum(vq.w * vd.w), 6) AS cos FROM vq JOIN vd USING (b) GROUP BY ALL HAVING round(sum(vq.w * vd.w), 6) > 0),
    bt AS (SELECT qid, id, coalesce(keyword, 0.0) AS keyword, coalesce(cos, 0.0) AS cos FROM kw FULL JOIN sem USING (qid, id)),
    e AS (SELECT bt.*, f.stamp, f.helpful, f.unhelpful, {_ENT.format('q.text')} AS asked, {_ENT.format('f.text')} AS held FROM bt JOIN f USING (id) JOIN q USING (qid)),
    s AS (SELECT qid, id, stamp, round(0.42 * cos + 0.28 * keyword
       + 0.18 * CASE WHEN len(asked) = 0 THEN 0 ELSE len(list_filter(asked, lambda a: list_contains(held, a) OR (length(a) >= 3 AND len(list_filter(held, lambda h: contains(h, a))) > 0))) / len(asked) END
       + 0.04 * CASE WHEN date_diff('second', stamp, TIMESTAMP '{NOW}') <= 0 THEN 1.0 ELSE pow(2.0, -(date_diff('second', stamp, TIMESTAMP '{NOW}') / 86400.0) / 90.0) END
       + 0.08 * (0.5 + 0.5 * tanh((helpful - unhelpful) / 3.0)), 6) AS score FROM e),
    r AS (SELECT qid, id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, stamp DESC, id))::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 10"""
)
def g1_fact_ranking(spark, sf):
    return M.rank_facts(memory(spark, sf, costly=True), _asked(spark, sf), hash_token_rows, _now())


@query(f"WITH {FACTS} SELECT note, id, text FROM mem WHERE agent = 'ann' AND category = '' AND superseded_by IS NULL AND NOT coalesce(expires <= TIMESTAMP '{NOW}', false)")
def g2_fact_filter(spark, sf):
    return M.memory_entries(memory(spark, sf), _now(), agent="ann", category="").select("note", "id", "text")


@query(f"WITH {FACTS}, {_FQ} SELECT qid, id, round(keyword, 6) AS keyword FROM kw")
def g3_keyword_score(spark, sf):
    return M.keyword_scores(memory(spark, sf, costly=True), _asked(spark, sf)).withColumn("keyword", F.round("keyword", 6))


_INSTANTS = ("1996-01-01 00:00:00", "1998-06-15 00:00:00", NOW)


@query(
    f"""WITH {FACTS}, i AS (SELECT unnest([{', '.join(f"TIMESTAMP '{t}'" for t in _INSTANTS)}]) AS as_of)
    SELECT as_of, id, text FROM mem JOIN i ON stamp <= as_of AND (superseded_by IS NULL OR superseded_at > as_of) AND NOT coalesce(expires <= as_of, false)"""
)
def g4_believed_at(spark, sf):
    rows = spark.createDataFrame([(t,) for t in _INSTANTS], "t string").selectExpr("cast(t as timestamp_ntz) as as_of")
    return M.believed_at(memory(spark, sf), rows)


@query(f"WITH {FACTS} SELECT note, count(*) FILTER (WHERE {_LIVE}) AS live, count(*) FILTER (WHERE coalesce(expires <= TIMESTAMP '{NOW}', false)) AS expired FROM mem GROUP BY note")
def g5_liveness(spark, sf):
    now = _now()
    return memory(spark, sf).groupBy("note").agg(F.count_if(M.live(now)).alias("live"), F.count_if(M.expired_at(F.col("expires"), now)).alias("expired"))


@query(
    """WITH r AS (SELECT o_orderkey, o_orderdate AS stamp, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 3 DAY WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 = 0 THEN o_orderdate END AS absolute,
      CASE o_orderkey % 6 WHEN 1 THEN (o_orderkey % 90)::VARCHAR || 'h' WHEN 2 THEN '7d' WHEN 3 THEN 'soon' WHEN 4 THEN '45m' END AS relative FROM orders),
    p AS (SELECT *, try_cast(nullif(regexp_extract(relative, '^(\\d+)([hdm])$', 1), '') AS INT) AS n, regexp_extract(relative, '^(\\d+)([hdm])$', 2) AS u FROM r),
    z AS (SELECT *, CASE WHEN absolute IS NOT NULL AND relative IS NOT NULL THEN 'both' WHEN relative IS NOT NULL AND (n IS NULL OR n <= 0) THEN 'relative' WHEN absolute <= stamp THEN 'past' END AS problem FROM p)
    SELECT o_orderkey, problem, CASE WHEN problem IS NULL THEN coalesce(absolute, stamp + to_minutes(n * CASE u WHEN 'h' THEN 60 WHEN 'd' THEN 1440 ELSE 1 END)) END AS expires_at FROM z""".replace("\\\\", "\\")
)
def g5b_expiry_resolution(spark, sf):
    k = F.col("o_orderkey")
    absolute = F.when(k % 4 == 0, F.expr("o_orderdate + interval '3' day")).when((k % 4 == 1) & (k % 3 == 0), F.col("o_orderdate"))
    relative = F.when(k % 6 == 1, F.concat((k % 90).cast("string"), F.lit("h"))).when(k % 6 == 2, F.lit("7d")).when(k % 6 == 3, F.lit("soon")).when(k % 6 == 4, F.lit("45m"))
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("stamp"), absolute.alias("absolute"), relative.alias("relative"))
    return M.resolve_expiry(rows).select("o_orderkey", "problem", "expires_at")


@query(
    f"""WITH {FACTS} SELECT id, round(CASE WHEN date_diff('second', stamp, TIMESTAMP '{NOW}') <= 0 THEN 1.0 ELSE pow(2.0, -(date_diff('second', stamp, TIMESTAMP '{NOW}') / 86400.0) / 90.0) END, 6) AS recency,
    round(0.5 + 0.5 * tanh((helpful - unhelpful) / 3.0), 6) AS usefulness FROM mem"""
)
def g6_recency_usefulness(spark, sf):
    return memory(spark, sf).select("id", F.round(M.recency(F.col("stamp"), _now()), 6).alias("recency"), F.round(M.usefulness(F.col("helpful"), F.col("unhelpful")), 6).alias("usefulness"))


_AUTH = "CASE WHEN {0} NOT IN ('human', 'agent', 'import') THEN 0 WHEN {1} THEN 2 ELSE 1 END"
_PAIRS_SQL = """pr AS (SELECT n.id, n.id AS new_id, CASE WHEN n.num % 10 = 3 THEN 'It is not so: ' || o.text WHEN n.num % 10 = 4 THEN o.text || ' now' ELSE n.text END AS new, o.text AS old,
  CASE WHEN n.origin NOT IN ('human', 'agent', 'import') THEN 0 WHEN n.human THEN 2 ELSE 1 END AS na, CASE WHEN o.origin NOT IN ('human', 'agent', 'import') THEN 0 WHEN o.human THEN 2 ELSE 1 END AS oa, o.immutable AS im
  FROM mem o JOIN mem n ON o.superseded_by = n.id)"""


@query(
    f"""WITH {FACTS}, {_PAIRS_SQL}, a AS (SELECT *, {attribute_sql('new', 'n_')}, {attribute_sql('old', 'o_')}, {words_sql('new')} AS nw, {words_sql('old')} AS ow, {negation_sql('new')} AS neg FROM pr),
    b AS (SELECT *, round(len(list_intersect(nw, ow)) / len(list_distinct(list_concat(nw, ow))), 6) AS similarity, n_subject <> '' AND n_value <> '' AND o_value <> '' AND n_subject = o_subject AND n_predicate = o_predicate AS same,
        n_value = o_value AS eq, na < oa AS outranked FROM a),
    c AS (SELECT *, CASE WHEN NOT outranked AND NOT im AND same THEN CASE WHEN neg THEN 'DELETE' WHEN eq THEN 'NOOP' ELSE 'UPDATE' END WHEN similarity >= 0.9 AND NOT neg THEN 'NOOP'
        WHEN neg AND similarity >= 0.45 AND NOT outranked AND NOT im THEN 'DELETE' ELSE 'ADD' END AS verdict FROM b)
    SELECT id, similarity, verdict AS op, verdict = 'ADD' AND outranked AND similarity > 0 AS challenge FROM c"""
)
def g7_pair_decision(spark, sf):
    m = memory(spark, sf)
    old = m.select(
        "superseded_by", F.col("text").alias("old"), M.authority(F.col("origin"), F.col("human")).alias("old_authority"), F.col("immutable").alias("old_immutable")
    )
    new = m.select("id", "num", "text", M.authority(F.col("origin"), F.col("human")).alias("new_authority"))
    text = F.when(F.col("num") % 10 == 3, F.concat(F.lit("It is not so: "), "old")).when(F.col("num") % 10 == 4, F.concat("old", F.lit(" now"))).otherwise(F.col("text"))
    pairs = old.join(new, old["superseded_by"] == new["id"]).withColumn("new", text)
    return M.decide_pairs(pairs).select("id", "similarity", "op", "challenge")


_NEW = """'The yearly hosting budget of team ' || o_orderstatus || ' is $' || cast(cast(floor(o_totalprice) as bigint) as string)"""
_OLD = """CASE o_orderkey % 5 WHEN 0 THEN 'The yearly hosting budget of team ' || o_orderstatus || ' is $' || cast(cast(floor(o_totalprice) as bigint) - o_orderkey % 2 as string) || '.0'
  WHEN 1 THEN 'A cat named $' || cast(o_orderkey % 7 as string) || ' sleeps' WHEN 2 THEN 'team hosting budget yearly: between $20 and $30'
  WHEN 3 THEN 'the yearly hosting budget is twelve percent' ELSE 'yearly hosting budget was $12 of team ' || o_orderstatus END"""


@query(
    f"""WITH p AS (SELECT o_orderkey AS id, {_NEW} AS new, {_OLD} AS old FROM orders),
    w AS (SELECT id, {slot_sql('new')} AS nw, {slot_sql('old')} AS ow FROM p), vn AS ({values_sql('new', 'p', 'id')}), vo AS ({values_sql('old', 'p', 'id')}),
    x AS (SELECT id, list_intersect(nw, ow) AS both_, least(len(nw), len(ow)) AS least_ FROM w)
    SELECT id, len(both_)::INT AS shared, round(CASE WHEN least_ = 0 THEN 0 ELSE len(both_) / least_ END, 6) AS overlap,
      len(both_) >= 3 AND len(list_filter(both_, lambda t: t NOT IN ({", ".join(f"'{t}'" for t in GENERIC_TERMS)}))) >= 1 AND len(both_) >= 0.34 * least_ AND ("""
    + " OR ".join(f"(len(vn.v_{k}) = 1 AND len(vo.v_{k}) = 1 AND coalesce(vn.v_{k}[1] <> vo.v_{k}[1], false))" for k, _ in VALUE_PATTERNS)
    + """) AS "update" FROM x JOIN vn USING (id) JOIN vo USING (id)"""
)
def g8_value_updates(spark, sf):
    pairs = table(spark, sf, "orders", costly=True).select(F.col("o_orderkey").alias("id"), F.expr(_NEW).alias("new"), F.expr(_OLD).alias("old"))
    return M.value_updates(pairs).select("id", "shared", "overlap", "update")


@query(
    f"""WITH {FACTS}, {ATTRIBUTE}, s AS (SELECT *, lag(value) OVER (PARTITION BY note, subject, predicate ORDER BY stamp, id) AS before FROM attr),
    k AS (SELECT *, CASE WHEN before IS NULL THEN 'ADD' WHEN before = value THEN 'NOOP' ELSE 'UPDATE' END AS op FROM s),
    t AS (SELECT id, lead(id) OVER w AS sb, lead(stamp) OVER w AS sa FROM k WHERE op <> 'NOOP' WINDOW w AS (PARTITION BY note, subject, predicate ORDER BY stamp, id))
    SELECT k.id, note AS scope, subject, predicate, value, op, sb AS superseded_by, sa AS superseded_at FROM k LEFT JOIN t ON t.id = k.id"""
)
def g9_reconcile_attributes(spark, sf):
    return M.reconcile_attributes(memory(spark, sf), "note")


#: One attribute per customer and no authority: a repeat of the live value is a NOOP, any other value an UPDATE.
FOLD = f"""WITH {FACTS}, l AS (SELECT cust, id, stamp, text, lag(text) OVER w AS before FROM mem WINDOW w AS (PARTITION BY cust ORDER BY stamp, id)),
    o AS (SELECT *, CASE WHEN before IS NULL THEN 'ADD' WHEN before = text THEN 'NOOP' ELSE 'UPDATE' END AS op FROM l)
    SELECT cust AS scope, id, op, last_value(CASE WHEN op <> 'NOOP' THEN id END IGNORE NULLS) OVER (PARTITION BY cust ORDER BY stamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target,
      NULL::VARCHAR AS challenges FROM o"""


@query(FOLD)
def g9_reconcile_fold(spark, sf):
    """The full fold per customer."""
    facts = memory(spark, sf).select("cust", "id", "stamp", "text")
    return M.reconcile(facts, "cust")


@query(
    f"""SELECT f.scope AS cust, f.id, m.stamp, m.text, m.agent, f.challenges, n.id AS superseded_by, n.stamp AS superseded_at
    FROM ({FOLD}) f JOIN (WITH {FACTS} SELECT * FROM mem) m ON m.id = f.id LEFT JOIN (SELECT g.target, g.id, k.stamp FROM ({FOLD}) g JOIN (WITH {FACTS} SELECT * FROM mem) k ON k.id = g.id WHERE g.op = 'UPDATE') n ON n.target = f.id
    WHERE f.op IN ('ADD', 'UPDATE')"""
)
def g9_fact_table(spark, sf):
    """What is on record after the fold per customer."""
    facts = memory(spark, sf).select("cust", "id", "stamp", "text", "agent")
    return M.fact_table(facts, M.reconcile(facts, "cust"), "cust")


@query()
def g9_reconcile_authority(spark, sf):
    """The fold per topic with authority, immutable facts and expiry; a test holds it against a plain version."""
    m = memory(spark, sf).withColumn("authority", M.authority(F.col("origin"), F.col("human")))
    return M.reconcile(m, "note")


@query(f"WITH {FACTS} SELECT id, {_AUTH.format('origin', 'human')}::INT AS authority FROM mem")
def g10_authority(spark, sf):
    return memory(spark, sf).select("id", M.authority(F.col("origin"), F.col("human")).alias("authority"))


_ID_SQL = f"substr(sha256(strftime(stamp, '%Y-%m-%d') || chr(1) || agent || chr(1) || {NORMAL.format('text')}), 1, 12)"


@query(
    f"""WITH {FACTS}, i AS (SELECT id, num, stamp, agent, text, {_ID_SQL} AS good FROM mem),
    e AS (SELECT id, CASE num % 4 WHEN 0 THEN good WHEN 1 THEN good || '-2' WHEN 2 THEN reverse(good) ELSE 'note-' || id END AS given, good FROM i)
    SELECT id, regexp_matches(regexp_replace(given, '-\\d+$', ''), '^[0-9a-f]{{12}}$') AND regexp_replace(given, '-\\d+$', '') <> good AS edited FROM e""".replace("\\\\", "\\")
)
def g11_hand_edits(spark, sf):
    day = F.date_format("stamp", "yyyy-MM-dd")
    good = content_id(day, F.col("agent"), F.col("text"))
    k = F.col("num") % 4
    given = F.when(k == 0, good).when(k == 1, F.concat(good, F.lit("-2"))).when(k == 2, F.reverse(good)).otherwise(F.concat(F.lit("note-"), "id"))
    return memory(spark, sf).withColumn("given", given).select("id", M.hand_edited(F.col("given"), day, F.col("agent"), F.col("text")).alias("edited"))


@query(
    f"""WITH {FACTS}, r AS (SELECT note, num, 'x' || (num % 50)::VARCHAR AS x, row_number() OVER (PARTITION BY note, 'x' || (num % 50)::VARCHAR ORDER BY num) - 1 AS again FROM mem)
    SELECT note, num AS line, x || CASE WHEN again > 0 THEN '-' || again::VARCHAR ELSE '' END AS id FROM r"""
)
def g12_unique_ids(spark, sf):
    m = memory(spark, sf).select("note", F.col("num").alias("line"), F.concat(F.lit("x"), (F.col("num") % 50).cast("string")).alias("id"))
    return M.unique_ids(m)


_SINCE = "1998-01-01 00:00:00"
_CHANGES = f"""
ch AS (SELECT m.id, 'learned' AS kind, m.stamp AS "at", NULL::VARCHAR AS successor FROM mem m WHERE stamp > TIMESTAMP '{_SINCE}' AND id NOT IN (SELECT superseded_by FROM mem WHERE superseded_by IS NOT NULL)
  UNION ALL SELECT m.id, CASE WHEN s.id IS NULL THEN 'retracted' ELSE 'changed' END, m.superseded_at, s.id FROM mem m LEFT JOIN mem s ON m.superseded_by = s.id WHERE m.superseded_by IS NOT NULL AND m.superseded_at > TIMESTAMP '{_SINCE}'
  UNION ALL SELECT id, 'expired', expires, NULL FROM mem WHERE superseded_by IS NULL AND expires > TIMESTAMP '{_SINCE}' AND expires <= TIMESTAMP '{NOW}')"""


def _changes(spark, sf):
    m = memory(spark, sf)
    # every 13th supersession lost its successor: a retraction
    m = m.withColumn("superseded_by", F.when((F.col("num") % 13 == 0) & F.col("superseded_by").isNotNull(), F.lit("gone")).otherwise(F.col("superseded_by")))
    return M.changes(m, F.expr(f"timestamp_ntz '{_SINCE}'"), _now())


_MEM13 = FACTS.replace("mem AS (", "mem0 AS (") + ", mem AS (SELECT * REPLACE (CASE WHEN num % 13 = 0 AND superseded_by IS NOT NULL THEN 'gone' ELSE superseded_by END AS superseded_by) FROM mem0)"


@query(f"WITH {_MEM13}, {_CHANGES} SELECT * FROM ch")
def g13_change_feed(spark, sf):
    return _changes(spark, sf)


@query(f"""WITH {_MEM13}, {_CHANGES} SELECT kind, count(*) AS n FROM ch WHERE "at" > TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND "at" <= TIMESTAMP '{NOW}' GROUP BY kind""")
def g14_recent_changes(spark, sf):
    now = _now()
    return _changes(spark, sf).where((F.col("at") > now - F.expr("interval '7' day")) & (F.col("at") <= now)).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    f"""WITH {FACTS}, fb AS (SELECT 'f' || (l_orderkey % 1000)::VARCHAR AS id, count(*) FILTER (WHERE l_returnflag = 'A') AS h, count(*) FILTER (WHERE l_returnflag = 'R') AS u FROM lineitem GROUP BY ALL),
    g AS (SELECT mem.*, coalesce(h, 0) AS h, coalesce(u, 0) AS u FROM mem LEFT JOIN fb USING (id) WHERE num % 17 <> 0)
    SELECT id, (helpful + h)::INT AS helpful, (unhelpful + u)::INT AS unhelpful, CASE WHEN num % 5 = 0 AND NOT immutable THEN 'patched' ELSE category END AS category,
      CASE WHEN num % 19 = 0 AND superseded_by IS NULL THEN 'retracted' ELSE superseded_by END AS superseded_by FROM g"""
)
def g15_mutations(spark, sf):
    m = memory(spark, sf)
    l = table(spark, sf, "lineitem")
    given = l.select(
        F.concat(F.lit("f"), (F.col("l_orderkey") % 1000).cast("string")).alias("id"), (F.col("l_returnflag") == "A").cast("int").alias("helpful"), (F.col("l_returnflag") == "R").cast("int").alias("unhelpful")
    )
    out = M.apply_feedback(M.retract(m, m.where("num % 17 = 0").select("id"), _now(), hard=True), given)
    out = M.patch(out, m.where("num % 5 = 0").select("id", F.lit("patched").alias("category")), ("category",))
    return M.retract(out, m.where("num % 19 = 0").select("id"), _now()).select("id", "helpful", "unhelpful", "category", "superseded_by")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'trusted' WHEN doc_id % 10 = 4 THEN 'untrusted' WHEN (CASE source WHEN 'src0' THEN 'human' WHEN 'src1' THEN 'agent' ELSE source END) IN ('human', 'agent', 'import') THEN 'trusted' ELSE 'untrusted' END AS trust FROM documents"""
)
def g16_trust_level(spark, sf):
    origin = F.when(F.col("source") == "src0", "human").when(F.col("source") == "src1", "agent").otherwise(F.col("source"))
    given = F.when(F.col("doc_id") % 10 == 3, "trusted").when(F.col("doc_id") % 10 == 4, "untrusted").when(F.col("doc_id") % 10 == 5, "maybe")
    return table(spark, sf, "documents").select("doc_id", M.trust_level(origin, given).alias("trust"))


@query(
    f"""WITH {FACTS}, v AS (SELECT id, num % 2 = 0 AS ok FROM mem WHERE num % 21 = 0)
    SELECT mem.id, CASE WHEN v.ok THEN 'trusted' WHEN v.id IS NOT NULL THEN 'untrusted' WHEN origin IN ('human', 'agent', 'import') THEN 'trusted' ELSE 'untrusted' END AS trust,
      greatest(stamp, CASE WHEN v.ok THEN TIMESTAMP '{NOW}' ELSE stamp END) AS verified FROM mem LEFT JOIN v USING (id)"""
)
def g17_vouch(spark, sf):
    m = memory(spark, sf)
    v = m.where("num % 21 = 0").select("id", F.when(F.col("num") % 2 == 0, "trusted").otherwise("untrusted").alias("given"))
    rows = m.join(v, "id", "left")
    verified = F.greatest("stamp", F.when(F.col("given") == "trusted", _now()).otherwise(F.col("stamp")))
    return rows.select("id", M.trust_level(F.col("origin"), F.col("given")).alias("trust"), verified.alias("verified"))


@query(
    """WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0),
    c AS (SELECT qid, vec_id AS id, round(list_cosine_similarity(e, embedding::DOUBLE[]), 6) AS cos FROM q, embeddings),
    r AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id))::INT AS rank FROM c WHERE cos > 0) SELECT * FROM r WHERE rank <= 5"""
)
def f17_vector_fact_search(spark, sf):
    from pyspark.sql.window import Window

    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    hits = R.dense(v, v.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding"), best=5)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cos"), "id")))
