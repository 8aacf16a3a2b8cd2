"""Queries of full-text search: stems, phrases, the search box with its operators, recall by words."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.functions.stem import search_terms, stem_terms
from notelake.operators import fulltext as T
from notelake.operators.embed import hash_tokens
from notelake.operators.retrieval import hybrid_search
from notelake.plans.queries_search import _TOK, FUSED, POSTINGS, SEMANTIC
from notelake.plans.registry import query, table
from notelake.plans.stem_sql import stems_sql

_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"


@query(f"WITH v AS (SELECT DISTINCT unnest({_WORDS.format('text')}) AS term FROM documents), {stems_sql('v')} SELECT term, stem FROM stems")
def f12_stems(spark, sf):
    vocabulary = table(spark, sf, "documents").select(F.explode(search_terms(F.col("text"))).alias("term")).distinct()
    return stem_terms(vocabulary)


def _search_sql(questions: str, policy: str) -> str:
    """CTEs ``place`` (qid, id, score, mode, place) for ``fq`` (qid, words) over documents."""
    starts = policy == "prefix"
    fields = "[array_to_string(words, ' ')]" if policy == "phrase" else "words"
    said = _WORDS.format("replace(field, '\"', '')" if starts else "field")
    last = "j = m" if starts else "FALSE"
    return f"""{questions},
fw AS (SELECT qid, unnest({fields}) AS field FROM fq), fs AS (SELECT DISTINCT qid, {said} AS said FROM fw),
dt AS MATERIALIZED (SELECT doc_id AS id, {_WORDS.format('text')} AS said FROM documents),
dp AS MATERIALIZED (SELECT id, unnest(said) AS term, unnest(range(len(said))) AS pos FROM dt), dn AS (SELECT id, len(said) AS n FROM dt),
v AS (SELECT DISTINCT term FROM (SELECT unnest(said) AS term FROM fs UNION ALL SELECT term FROM dp)), {stems_sql('v')},
fl AS (SELECT qid, said, unnest(said) AS term, unnest(range(1, len(said) + 1)) AS j FROM fs WHERE len(said) > 0),
fp AS (SELECT DISTINCT qid, list(stem ORDER BY j) AS ph FROM fl JOIN stems USING (term) GROUP BY qid, said),
up AS (SELECT DISTINCT ph, len(ph) AS m FROM fp), ut AS (SELECT ph, m, unnest(ph) AS stem, unnest(range(1, m + 1)) AS j FROM up),
sv AS (SELECT DISTINCT stem FROM stems JOIN dp USING (term)),
ue AS (SELECT ph, m, j, sv.stem FROM ut JOIN sv ON sv.stem = ut.stem WHERE NOT ({last}) UNION ALL SELECT ph, m, j, sv.stem FROM ut JOIN sv ON starts_with(sv.stem, ut.stem) WHERE {last}),
ds AS MATERIALIZED (SELECT id, pos, stem FROM dp JOIN stems USING (term) WHERE stem IN (SELECT stem FROM ue)),
mt AS (SELECT ph, id, count(*) AS tf FROM (SELECT ph, id, pos - j AS b FROM ue JOIN ds USING (stem) GROUP BY ph, m, id, pos - j HAVING count(DISTINCT j) = m) GROUP BY ph, id),
sc AS (SELECT count(*) AS n, avg(n) AS mean FROM dn), wt AS (SELECT ph, ln(any_value(n) / count(*)) AS idf, any_value(mean) AS mean FROM mt, sc GROUP BY ph),
ha AS (SELECT qid, id, count(*) AS held, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM fp JOIN mt USING (ph) JOIN wt USING (ph) JOIN dn USING (id) GROUP BY qid, id),
nx AS (SELECT qid, count(*) AS needed FROM fp GROUP BY qid), hb AS (SELECT ha.*, held = needed AS all_ FROM ha JOIN nx USING (qid)),
hc AS (SELECT *, bool_or(all_) OVER (PARTITION BY qid) AS any_all FROM hb), hx AS (SELECT * FROM hc WHERE all_ = any_all{'' if starts else ' AND all_'}),
place AS (SELECT qid, id, score, CASE WHEN all_ THEN 'all' ELSE 'any' END AS mode, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INT AS place FROM hx QUALIFY place <= 500)"""


def _documents(spark, sf):
    d = F.col("doc_id")
    path = F.concat("source", F.lit("/D"), d.cast("string"), F.lit(".md"))
    tags = F.array("lang", F.concat(F.lit("t"), (d % 5).cast("string")))
    return table(spark, sf, "documents").select(d.alias("id"), "text", path.alias("path"), tags.alias("tags"), (d % 10 == 0).alias("pinned"), (d * 7919 % 1009).alias("updated"))


_BOX = f"""bq AS (SELECT item_id AS k, text, {_TOK.format('text')} AS t FROM benchmark),
bx AS (SELECT k * 4 AS qid, text FROM bq UNION ALL SELECT k * 4 + 1, left(t[1], 3) || ' ' || left(t[2], 5) || ' tag:' || ['en', 'fr', 'de', 'es', 't1'][1 + k % 5] FROM bq
  UNION ALL SELECT k * 4 + 2, 'PATH:SRC' || (k % 20)::VARCHAR || '/ ' || left(t[3], 4) || ' is:pinned' FROM bq UNION ALL SELECT k * 4 + 3, 'is:pin path:src' || (k % 7)::VARCHAR FROM bq),
bf AS (SELECT qid, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS f FROM bx),
bo AS (SELECT qid, list_filter(f, lambda x: NOT regexp_matches(lower(x), '^(tag:|path:|is:pin(ned)?$)')) AS words,
  list_filter(f, lambda x: starts_with(lower(x), 'tag:')) AS tg, list_filter(f, lambda x: starts_with(lower(x), 'path:')) AS pt, len(list_filter(f, lambda x: lower(x) IN ('is:pin', 'is:pinned'))) > 0 AS pin FROM bf),
fq AS (SELECT qid, words FROM bo)"""


def _box(spark, sf):
    b, k = table(spark, sf, "benchmark"), F.col("item_id")
    t = lambda i, n: F.left(F.get(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), F.lit(i)), F.lit(n))
    tag = F.get(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es", "t1")]), (k % 5).cast("int"))
    whole = b.select((k * 4).alias("qid"), "text")
    tagged = b.select((k * 4 + 1).alias("qid"), F.concat(t(0, 3), F.lit(" "), t(1, 5), F.lit(" tag:"), tag).alias("text"))
    pinned = b.select((k * 4 + 2).alias("qid"), F.concat(F.lit("PATH:SRC"), (k % 20).cast("string"), F.lit("/ "), t(2, 4), F.lit(" is:pinned")).alias("text"))
    listed = b.select((k * 4 + 3).alias("qid"), F.concat(F.lit("is:pin path:src"), (k % 7).cast("string")).alias("text"))
    return whole.unionByName(tagged).unionByName(pinned).unionByName(listed)


@query(
    f"""WITH {_search_sql(_BOX, 'prefix')},
    no AS (SELECT doc_id AS id, lower(source || '/D' || doc_id::VARCHAR || '.md') AS low, source || '/D' || doc_id::VARCHAR || '.md' AS path, [lang, 't' || (doc_id % 5)::VARCHAR] AS tags, doc_id % 10 = 0 AS pinned, doc_id * 7919 % 1009 AS updated FROM documents),
    li AS (SELECT id, (row_number() OVER (ORDER BY updated DESC, path))::INT AS place FROM no QUALIFY place <= 500),
    al AS (SELECT * FROM place UNION ALL SELECT qid, id, NULL, 'list', place FROM bo, li WHERE len(words) = 0),
    ok AS (SELECT al.* FROM al JOIN bo USING (qid) JOIN no USING (id) WHERE (len(tg) = 0 OR list_contains(tags, substr(tg[-1], 5))) AND (len(pt) = 0 OR contains(low, lower(substr(pt[-1], 6)))) AND (NOT pin OR pinned))
    SELECT qid, id, score, mode, (row_number() OVER (PARTITION BY qid ORDER BY place))::INT AS rank FROM ok QUALIFY rank <= 50"""
)
def f10_fulltext_search(spark, sf):
    """Whole benchmark texts, and short questions with operators."""
    return T.search_notes(_documents(spark, sf), _box(spark, sf))


_SPOKEN = "fq AS (SELECT item_id AS qid, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS words FROM benchmark)"


def _spoken(spark, sf):
    return T.operators(table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")).select("qid", "words")


@query(f"WITH {_search_sql(_SPOKEN, 'phrase')} SELECT qid, id, score, place FROM place")
def f11_phrase_policy(spark, sf):
    """Whole benchmark texts as phrases."""
    return T.search(_documents(spark, sf), _spoken(spark, sf), "phrase").select("qid", "id", "score", "place")


@query(f"WITH {_search_sql(_SPOKEN, 'terms')} SELECT qid, id, score, place FROM place")
def f11_terms_policy(spark, sf):
    """Documents with all words of whole benchmark texts."""
    return T.search(_documents(spark, sf), _spoken(spark, sf), "terms").select("qid", "id", "score", "place")


_FIRST_TURNS = "uq AS (SELECT conv_id AS qid, text FROM conversations WHERE turn = 0 AND text IS NOT NULL), fq AS (SELECT qid, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS words FROM uq)"
_FALLBACK = f"{POSTINGS},{SEMANTIC},{FUSED}".replace("q AS (SELECT item_id AS qid, text FROM benchmark)", "q AS (SELECT * FROM uq WHERE qid NOT IN (SELECT qid FROM held))", 1)


@query(
    f"""WITH {_search_sql(_FIRST_TURNS, 'terms')},
    held AS (SELECT qid, id, (row_number() OVER (PARTITION BY qid ORDER BY id * 7919 % 1009 DESC, id))::INT AS rank FROM hx QUALIFY rank <= 20), {_FALLBACK},
    fb AS (SELECT qid, id, rank + 1 AS rank FROM hits WHERE rank < 20)
    SELECT qid, id, rank, 'words' AS how FROM held UNION ALL SELECT qid, id, rank, 'meaning' FROM fb"""
)
def f18_whole_question_recall(spark, sf):
    """Documents with all words of a conversation's first turn, newest first; where none has, what a hybrid search finds."""
    asked = table(spark, sf, "conversations").where("turn = 0 and text is not null").select(F.col("conv_id").alias("qid"), "text")
    # each document is a note here, so the first third of the hits are the notes
    return T.recall(_documents(spark, sf), asked, lambda rows, rest, k: hybrid_search(rows, rest, k // 3, embed=hash_tokens))
