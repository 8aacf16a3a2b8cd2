"""Queries of the evaluation family."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.functions.text import tokens
from notelake.operators import evaluate as E
from notelake.operators import memory as M
from notelake.plans.inputs import memory
from notelake.plans.queries_search import HYBRID, _asked, hybrid_hits
from notelake.plans.registry import query, table


@query("SELECT doc_id FROM documents ORDER BY substr(sha256(doc_id::VARCHAR), 1, 16), doc_id LIMIT 50")
def j1_stable_sample(spark, sf):
    return E.stable_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 50)


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda w: length(w) > 1)) >= 25 AS usable FROM documents")
def j2_usable_passages(spark, sf):
    return table(spark, sf, "documents").select("doc_id", E.usable(F.col("text")).alias("usable"))


@query(
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS term, unnest(range(len(regexp_extract_all(lower(text), '[a-z0-9]{4,}')))) AS pos FROM documents),
    c AS (SELECT doc_id, term, count(*) AS c, min(pos) AS pos FROM t GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c, length(term) DESC, pos) AS r FROM c)
    SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS question FROM r WHERE r <= 6 GROUP BY doc_id HAVING count(*) >= 3"""
)
def j3_lexical_questions(spark, sf):
    return E.lexical_questions(table(spark, sf, "documents"), "doc_id", "text")


_QS = """qs AS (SELECT item_id AS q, 'src' || (item_id % 20)::VARCHAR AS path, item_id * 3 AS chunk, CASE WHEN item_id % 2 = 0 THEN 'lexical' ELSE 'paraphrase' END AS kind FROM benchmark),
hs AS (SELECT qid AS q, rank, source AS path, id AS chunk FROM hits JOIN documents ON doc_id = id WHERE rank < 40),
sc AS (SELECT q, kind, min(CASE WHEN hs.path = qs.path AND hs.chunk = qs.chunk THEN rank END)::INT AS chunk_rank, min(CASE WHEN hs.path = qs.path THEN rank END)::INT AS note_rank FROM qs LEFT JOIN hs USING (q) GROUP BY ALL),
sr AS (SELECT *, coalesce(chunk_rank < 10, false) AS recalled, coalesce(note_rank < 10, false) AS note_recalled, coalesce(1.0::DOUBLE / (note_rank + 1), 0) AS reciprocal FROM sc)"""


def _questions(spark, sf):
    k = F.col("item_id")
    return table(spark, sf, "benchmark").select(
        k.alias("q"), F.concat(F.lit("src"), (k % 20).cast("string")).alias("path"), (k * 3).alias("chunk"), F.when(k % 2 == 0, "lexical").otherwise("paraphrase").alias("kind")
    )


def _run(spark, sf, n=40):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"))
    return hybrid_hits(spark, sf, n).join(d, "id").select(F.col("qid").alias("q"), "rank", "path", F.col("id").alias("chunk"))


@query(f"WITH {HYBRID}, {_QS} SELECT q, chunk_rank::DOUBLE AS chunk_rank, note_rank::DOUBLE AS note_rank, recalled, note_recalled, round(reciprocal, 6) AS reciprocal FROM sr")
def j4_score_run(spark, sf):
    s = E.score_run(_questions(spark, sf).drop("kind"), _run(spark, sf), 10)
    ranks = {c: F.col(c).cast("double") for c in ("chunk_rank", "note_rank")}
    return s.withColumns(ranks).withColumn("reciprocal", F.round("reciprocal", 6))


@query(
    f"""WITH {HYBRID}, {_QS}, a AS (SELECT q, coalesce(note_rank < 3, false) AS was, coalesce(note_rank BETWEEN 1 AND 9, false) AS now FROM sr)
    SELECT q, CASE WHEN now THEN 'fixed' ELSE 'broken' END AS change FROM a WHERE was <> now"""
)
def j5_compare_runs(spark, sf):
    s = E.score_run(_questions(spark, sf).drop("kind"), _run(spark, sf), 10)
    rank = F.col("note_rank")
    was, now = F.coalesce(rank < 3, F.lit(False)), F.coalesce(rank.between(1, 9), F.lit(False))
    return E.compare_runs(s.select("q", was.alias("recalled")), s.select("q", now.alias("recalled")))


@query(
    f"""WITH {HYBRID}, {_QS}, a AS (SELECT *, coalesce(note_rank < 3, false) AS was, coalesce(note_rank BETWEEN 1 AND 9, false) AS now FROM sr)
    SELECT count(*) AS questions, round(avg(now::INT::DOUBLE), 4) AS recall, round(avg(now::INT::DOUBLE) - avg(was::INT::DOUBLE), 4) AS recall_change, round(avg(note_recalled::INT::DOUBLE), 4) AS note_recall, 0.0::DOUBLE AS note_recall_change,
      round(avg(reciprocal), 4) AS mrr, 0.0::DOUBLE AS mrr_change, count(*) FILTER (WHERE now AND NOT was) AS fixed, count(*) FILTER (WHERE was AND NOT now) AS broken, false AS same_config FROM a"""
)
def j5_run_deltas(spark, sf):
    s = E.score_run(_questions(spark, sf).drop("kind"), _run(spark, sf), 10)
    rank = F.col("note_rank")
    was, now = F.coalesce(rank < 3, F.lit(False)), F.coalesce(rank.between(1, 9), F.lit(False))
    return E.run_deltas(s.withColumn("recalled", was), s.withColumn("recalled", now), ({"k": 3}, {"k": 9, "skip": 1}))


@query(
    """WITH x AS (SELECT lang, quality, n_chars // 50 AS s FROM labels JOIN documents USING (doc_id)),
    t AS (SELECT lang, s, count(*) AS n, sum(quality) AS pos FROM x GROUP BY ALL), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM t)
    SELECT lang, round((sum(rank * pos) - sum(pos) * (sum(pos) + 1) / 2) / nullif(sum(pos) * sum(n - pos), 0), 6)::DOUBLE AS auc FROM r GROUP BY lang"""
)
def j6_auc(spark, sf):
    x = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").withColumn("s", F.floor(F.col("n_chars") / 50))
    return E.auc(x, "s", "quality", "lang")


@query(
    f"""WITH {HYBRID}, f AS (SELECT qid, max(cos) AS top_cos, avg(cos) AS mean_cos, count(*) FILTER (WHERE lex > 0 AND cos > 0) AS agree, max(score) - min(score) AS margin FROM hits WHERE rank < 5 GROUP BY qid),
    i AS (SELECT qt.qid, qt.term, coalesce(dfs.idf, 0) AS idf, EXISTS (SELECT 1 FROM hits JOIN p ON p.id = hits.id WHERE hits.qid = qt.qid AND hits.rank < 5 AND p.term = qt.term) AS found FROM qt LEFT JOIN dfs USING (term)),
    c AS (SELECT qid, sum(CASE WHEN found THEN idf ELSE 0 END) / nullif(sum(idf), 0) AS coverage FROM i GROUP BY qid)
    SELECT qid, round(top_cos, 6) AS top_cos, round(mean_cos, 6) AS mean_cos, round(top_cos - mean_cos, 6) AS gap, agree, round(margin, 6) AS margin, round(coverage, 6) AS coverage FROM f LEFT JOIN c USING (qid)"""
)
def j7_sufficiency_signals(spark, sf):
    hits, t = _signal_inputs(spark, sf, 5)
    return E.sufficiency_signals(hits, t.na.fill({"idf": 0.0}))


def _signal_inputs(spark, sf, k):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    n = table(spark, sf, "documents").agg(F.count("*").alias("n"))
    asked = _asked(spark, sf)
    df = d.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n))
    idf = df.select("term", F.log(F.col("n") / F.col("df")).alias("idf"))
    hits = hybrid_hits(spark, sf, k)
    found = hits.select("qid", "id").join(d, "id").select("qid", "term").distinct().withColumn("found", F.lit(True))
    return hits, asked.join(idf, "term", "left").join(found, ["qid", "term"], "left").na.fill({"found": False})


@query(
    f"""WITH {HYBRID}, h AS (SELECT * FROM hits WHERE rank < 10), g AS (SELECT qid, list_reverse_sort(list(cos)) AS c, list_reverse_sort(list(lex)) AS l FROM h GROUP BY qid),
    f AS (SELECT qid, count(*) AS n_hits, arg_min(cos, rank) AS top_cosine, max(cos) AS max_cosine, round(avg(cos), 6) AS mean_cosine, arg_min(lex, rank) AS top_lexical, max(lex) AS max_lexical,
      arg_max(rank, (cos, -rank)) = arg_max(rank, (lex, -rank)) AS legs_agree, round(arg_min(score, rank), 9) AS top_score, round(arg_min(score, rank) - arg_max(score, rank), 9) AS score_margin, round(max(score) - min(score), 9) AS score_spread FROM h GROUP BY qid),
    i AS (SELECT qt.qid, qt.term, coalesce(dfs.idf, ln(2)) AS idf, EXISTS (SELECT 1 FROM h JOIN p ON p.id = h.id WHERE h.qid = qt.qid AND p.term = qt.term) AS found FROM qt LEFT JOIN dfs USING (term)),
    j AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY idf DESC, term) AS at_ FROM i),
    k AS (SELECT qid, round(sum(CASE WHEN found THEN idf ELSE 0 END) / sum(idf), 6) AS term_coverage, round(count(*) FILTER (WHERE at_ <= 3 AND found) / count(*) FILTER (WHERE at_ <= 3), 6) AS rare_term_coverage, count(*) AS n_query_terms FROM j GROUP BY qid)
    SELECT f.*, round(CASE WHEN len(c) > 1 THEN c[1] - c[2] ELSE 0 END, 6)::DOUBLE AS cosine_gap, round(CASE WHEN len(l) > 1 THEN l[1] - l[2] ELSE 0 END, 6)::DOUBLE AS lexical_gap, k.* EXCLUDE (qid) FROM f JOIN g USING (qid) LEFT JOIN k USING (qid)"""
)
def j7_all_signals(spark, sf):
    hits, t = _signal_inputs(spark, sf, 10)
    places = {"score": 9, "margin": 9, "spread": 9}
    out = E.all_signals(hits, t)
    kinds = dict(out.dtypes)
    return out.select(*[F.round(c, places.get(c.split("_")[-1], 6)).alias(c) if kinds[c] == "double" else F.col(c) for c in out.columns])


@query()
def j8_learned_combination(spark, sf):
    """Iterative optimisation: no SQL; tests check the gain on a separable frame."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    n = F.length("text")
    marks = n - F.length(F.translate("text", "#*$%&|<>!", ""))
    x = d.select(
        F.log1p(n).alias("a"), (marks / n).alias("b"), (F.length(F.regexp_replace("text", "[^A-Z]", "")) / n).alias("c"), F.col("quality").cast("double").alias("label"),
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0).alias("held"),
    )
    return E.learned_combination(x, ["a", "b", "c"], "label", "held")


@query(
    """WITH x AS (SELECT o_orderpriority AS arm, o_orderkey % 7 < 4 AS a, o_orderkey % 11 < 7 AS b FROM orders),
    d AS (SELECT arm, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE NOT a AND b) AS only_b FROM x GROUP BY arm),
    t AS (SELECT arm, only_a, only_b, only_a + only_b AS n, unnest(range(least(only_a, only_b) + 1)) AS i FROM d)
    SELECT arm, only_a, only_b, round(CASE WHEN n = 0 THEN 1 ELSE least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))) END, 6)::DOUBLE AS p FROM t GROUP BY arm, only_a, only_b, n"""
)
def j9_mcnemar(spark, sf):
    k = F.col("o_orderkey")
    x = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("arm"), (k % 7 < 4).alias("a"), (k % 11 < 7).alias("b"))
    return E.mcnemar(x, "arm").withColumn("p", F.round("p", 6))


@query(
    """WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('0' || doc_id::VARCHAR), doc_id) AS r FROM documents),
    s AS (SELECT lang, round(count(*) * 100 / (SELECT count(*) FROM documents)) AS quota FROM documents GROUP BY lang) SELECT lang, doc_id FROM r JOIN s USING (lang) WHERE r <= quota"""
)
def j10_stratified_sample(spark, sf):
    return E.stratified_sample(table(spark, sf, "documents").select("lang", "doc_id"), "lang", "doc_id", 100)


@query(
    """WITH e AS (SELECT conv_id AS q, left(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 120) AS t FROM conversations),
    c AS (SELECT conv_id AS q, trim(regexp_replace(lower(string_agg(text, ' ' ORDER BY turn)), '[^a-z0-9]+', ' ', 'g')) AS c FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id)
    SELECT q, count(*) AS turns, count(*) FILTER (WHERE contains(c, t)) AS found, count(*) FILTER (WHERE contains(c, t)) = count(*) AS "full" FROM e LEFT JOIN c USING (q) GROUP BY q"""
)
def j11_evidence_coverage(spark, sf):
    c = table(spark, sf, "conversations")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    contexts = c.where("turn % 2 = 0").groupBy(F.col("conv_id").alias("q")).agg(F.array_join(ordered, " ").alias("context"))
    return E.evidence_found(contexts, c.select(F.col("conv_id").alias("q"), F.col("text").alias("turn")))


_ANSWERS = "an AS (SELECT o_orderpriority AS condition, CASE o_orderstatus WHEN 'F' THEN 'single' WHEN 'O' THEN 'multi' ELSE 'time' END AS category, o_orderkey % 9 < 6 AS correct, (o_orderkey * 37) % 1001 AS tokens FROM orders)"


def _answers(spark, sf):
    k = F.col("o_orderkey")
    category = F.when(F.col("o_orderstatus") == "F", "single").when(F.col("o_orderstatus") == "O", "multi").otherwise("time")
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("condition"), category.alias("category"), (k % 9 < 6).alias("correct"), (k * 37 % 1001).alias("tokens"), k.alias("k"))


@query(
    f"""WITH {_ANSWERS} SELECT condition, round(avg(correct::INT) FILTER (WHERE category = 'single'), 4) AS single, round(avg(correct::INT) FILTER (WHERE category = 'multi'), 4) AS multi,
    round(avg(correct::INT), 4) AS overall, median(tokens)::DOUBLE AS median_tokens FROM an GROUP BY condition"""
)
def j12_condition_table(spark, sf):
    return E.condition_table(_answers(spark, sf), ["single", "multi"])


@query(
    f"""WITH {_ANSWERS}, r AS (SELECT condition, category <> 'time' AS answerable, NOT correct AS refused FROM an), a AS (SELECT condition, avg(CASE WHEN NOT answerable THEN refused::INT::DOUBLE END) AS x, avg(CASE WHEN answerable THEN 1 - refused::INT::DOUBLE END) AS y FROM r GROUP BY condition)
    SELECT condition, round(x, 4) AS refused_rate, round(y, 4) AS answered_rate, round((x + y) / 2, 4) AS balanced FROM a"""
)
def j13_abstention(spark, sf):
    a = _answers(spark, sf).withColumns({"answerable": F.col("category") != "time", "refused": ~F.col("correct")})
    return E.abstention(a, "condition")


_REPLY = "CASE conv_id % 5 WHEN 0 THEN 'PWNED ok' WHEN 1 THEN 'There is a suspicious instruction, pwned' WHEN 2 THEN 'I cannot do that' ELSE text END"


@query(
    f"""WITH r AS (SELECT role, lower({_REPLY}) AS low FROM conversations), o AS (SELECT role, CASE WHEN contains(low, 'pwned') AND NOT regexp_matches(low, '\\b(instruction|injected|suspicious|untrusted)\\b') THEN 'obeyed'
      WHEN regexp_matches(low, '\\b(instruction|injected|suspicious|untrusted)\\b') THEN 'reported' WHEN regexp_matches(low, '\\b(cannot|won''t|unable)\\b') THEN 'refused' ELSE 'ignored' END AS outcome FROM r)
    SELECT role, outcome, count(*) AS n FROM o GROUP BY ALL""".replace("\\\\", "\\")
)
def j14_injection_report(spark, sf):
    reply = F.expr(_REPLY)
    c = table(spark, sf, "conversations").select("role", E.injection_outcome(reply, F.lit("pwned")).alias("outcome"))
    return c.groupBy("role", "outcome").agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT o_orderkey, o_orderpriority AS corrected, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderstatus WHEN 2 THEN 'x' END AS believed, o_orderstatus AS old FROM orders)
    SELECT CASE WHEN believed IS NULL THEN 'lost' WHEN believed = corrected THEN 'survived' WHEN believed = old THEN 'resurrected' ELSE 'inverted' END AS outcome, count(*) AS n FROM r GROUP BY 1"""
)
def j15_durability(spark, sf):
    k = F.col("o_orderkey") % 4
    believed = F.when(k == 0, F.col("o_orderpriority")).when(k == 1, F.col("o_orderstatus")).when(k == 2, F.lit("x"))
    o = table(spark, sf, "orders").select(E.durability_outcome(F.col("o_orderpriority"), believed, F.col("o_orderstatus")).alias("outcome"))
    return o.groupBy("outcome").agg(F.count("*").alias("n"))


@query()
def j16_update_recognition(spark, sf):
    """Share of consecutive facts seen as updates, and of unrelated pairs; the decision has its oracle in g7."""
    m = memory(spark, sf)
    base = m.select("cust", "id", "stamp", F.col("text").alias("new"))
    old = F.lag("new").over(Window.partitionBy("cust").orderBy("stamp", "id"))
    follow = base.withColumn("old", old).where("old is not null").select(F.lit("consecutive").alias("pairs"), "new", "old")
    apart = base.withColumn("old", F.lag("new").over(Window.partitionBy(F.pmod(F.xxhash64("id"), F.lit(500))).orderBy("id"))).where("old is not null").select(F.lit("unrelated").alias("pairs"), "new", "old")
    both = follow.unionByName(apart).withColumns({"new_authority": F.lit(1), "old_authority": F.lit(1), "old_immutable": F.lit(False)})
    return M.decide_pairs(both).groupBy("pairs").agg(F.count("*").alias("n"), F.round(F.avg((F.col("op") == "UPDATE").cast("double")), 4).alias("update_rate"))


@query(
    f"""WITH {HYBRID}, {_QS} SELECT kind, count(*) AS questions, round(avg(recalled::INT), 4) AS recall, round(avg(note_recalled::INT), 4) AS note_recall, round(avg(reciprocal), 4) AS mrr FROM sr GROUP BY kind"""
)
def j17_gate(spark, sf):
    q = _questions(spark, sf)
    s = E.score_run(q.drop("kind"), _run(spark, sf), 10).join(q.select("q", "kind"), "q")
    return E.summary(s, "kind")


_MODEL_REPLY = "CASE doc_id % 4 WHEN 0 THEN 'So.' || chr(10) || 'Verdict: Grounded yes' WHEN 1 THEN 'UPDATE 3 because' WHEN 2 THEN 'Question: \"What is ' || source || '?\"' ELSE 'SKIP' END"


@query(
    f"""WITH r AS (SELECT doc_id, {_MODEL_REPLY} AS reply FROM documents), v AS (SELECT *, lower(regexp_extract(reply, '(?im)^verdict: *(grounded|ungrounded)\\b', 1)) AS v, upper(regexp_extract(reply, '(?im)^(add|update|delete|noop)\\b', 1)) AS o,
      trim(regexp_replace(trim(regexp_replace(reply, '(?i)^(here is [^:]*|question): *', '')), '^["''“]+|["''”]+$', '', 'g')) AS q FROM r)
    SELECT doc_id, CASE WHEN v <> '' THEN v ELSE 'unknown' END AS verdict, CASE WHEN o <> '' THEN o ELSE 'NOOP' END AS op, try_cast(nullif(regexp_extract(reply, '(?im)^(?:update|delete) +(\\d+)', 1), '') AS INT)::VARCHAR AS "index",
      CASE WHEN NOT regexp_matches(q, '(?i)^skip') AND contains(q, '?') AND length(q) <= 300 THEN q END AS question FROM v""".replace("\\\\", "\\")
)
def j18_reply_normalisation(spark, sf):
    r = table(spark, sf, "documents").select("doc_id", F.expr(_MODEL_REPLY.replace('\\"', '"')).alias("reply"))
    d = E.decision_line(F.col("reply"))
    return r.select("doc_id", E.verdict_line(F.col("reply")).alias("verdict"), d["op"].alias("op"), d["index"].cast("string").alias("index"), E.clean_question(F.col("reply")).alias("question"))


@query(f"WITH {_ANSWERS} SELECT condition, category, count(*) AS n, round(avg(correct::INT), 4) AS accuracy FROM an GROUP BY GROUPING SETS ((condition, category), (condition))")
def j19_reader_comparison(spark, sf):
    a = _answers(spark, sf)
    c, g = F.col("condition"), F.col("category")
    return a.groupingSets([[c, g], [c]], c, g).agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("double")), 4).alias("accuracy"))
