"""Notes and facts rendered from the star-schema tables, the same way in Spark and in DuckDB.

A note per customer with frontmatter, headings, tasks, facts, links, tags and a code fence;
a fact per order, "<customer> prefers <priority>".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.plans.registry import table

# The expressions below are valid in both dialects.
_COLS = """
  lower(replace(r_name, ' ', '-')) || '/' || lower(n_name) || '/' || cast(c_custkey as string) || '.md' AS path,
  c_name AS title,
  lower(replace(r_name, ' ', '-')) AS space,
  c_custkey % 7 = 0 AS private,
  CASE WHEN c_custkey % 5 = 0 THEN 'feed:news' WHEN c_custkey % 5 = 1 THEN 'chat:team' ELSE 'human' END AS origin,
  c_custkey % 10 = 0 AS pinned,
  c_custkey % 3 = 0 AS publish,
  'cust-' || cast(c_custkey as string) AS alias,
  lower(c_mktsegment) AS segment,
  c_acctbal AS balance,
  c_custkey AS key,
"""
_HEAD = (
    "'---' || chr(10) || 'segment: ' || lower(c_mktsegment) || chr(10) || 'balance: ' || cast(cast(floor(c_acctbal) as bigint) as string)"
    " || chr(10) || 'pinned: ' || CASE WHEN c_custkey % 10 = 0 THEN 'true' ELSE 'false' END"
    " || chr(10) || 'publish: ' || CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END"
    " || chr(10) || 'tags: [' || lower(c_mktsegment) || ', n' || cast(c_nationkey as string) || ']'"
    " || chr(10) || 'aliases: [cust-' || cast(c_custkey as string) || ']' || chr(10) || '---' || chr(10)"
    " || '# ' || c_name || chr(10) || chr(10) || '## Orders' || chr(10)"
)
_TAIL = (
    "chr(10) || chr(10) || '## Notes' || chr(10) || 'nation:: ' || n_name || chr(10)"
    " || 'worth:: ' || cast(cast(floor(c_acctbal) as bigint) as string) || chr(10)"
    " || 'see [[cust-' || cast((c_custkey * 7 + 3) % 1500 as string) || '|friend]] and [[cust-'"
    " || cast((c_custkey * 11 + 1) % 1500 as string) || ']] and [[missing-' || cast(c_custkey % 50 as string)"
    " || ']] and [[CUST-' || cast((c_custkey * 11 + 1) % 1500 as string) || '#top]] #vip/' || lower(c_mktsegment) || chr(10)"
    " || '```' || chr(10) || 'code:: no #nottag [[nolink]]' || chr(10) || '- [ ] fenced task' || chr(10) || '```' || chr(10)"
    " || '- [site](http://example.com/' || cast(c_custkey % 20 as string) || ')' || chr(10)"
    " || '- [peer](cust-' || cast((c_custkey + 1) % 1600 as string) || ')' || chr(10)"
)
_LINE = (
    "CASE WHEN o_orderstatus = 'F' THEN '- [x] ' ELSE '- [ ] ' END || 'order ' || cast(o_orderkey as string) || ' '"
    " || lower(substr(o_orderpriority, 3)) || ' on ' || substr(cast(o_orderdate as string), 1, 10)"
)

_SPARK_NOTES = f"""
WITH o AS (SELECT o_custkey, array_join(transform(sort_array(collect_list(struct(o_orderkey, {_LINE} AS line))), x -> x.line), chr(10)) AS lines,
                  min(o_orderdate) AS created, max(o_orderdate) AS updated
           FROM {{orders}} GROUP BY o_custkey)
SELECT {_COLS} created, updated, {_HEAD} || coalesce(lines, '- none') || {_TAIL} AS body
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey LEFT JOIN o ON o_custkey = c_custkey
"""

NOTES = f"""
o_ AS (SELECT o_custkey, string_agg({_LINE}, chr(10) ORDER BY o_orderkey) AS lines, min(o_orderdate) AS created, max(o_orderdate) AS updated
       FROM orders GROUP BY o_custkey),
notes AS (SELECT {_COLS} created, updated, {_HEAD} || coalesce(lines, '- none') || {_TAIL} AS body
          FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN o_ ON o_custkey = c_custkey)
"""

#: Facts: each order states its customer's preferred priority; the customer's next order supersedes it.
_FACT_COLS = """
  'm/' || cast(o_custkey % 40 as string) || '.md' AS note,
  'f' || cast(o_orderkey as string) AS id,
  'Customer ' || cast(o_custkey as string) || ' prefers ' || lower(substr(o_orderpriority, 3)) AS text,
  CASE o_orderkey % 3 WHEN 0 THEN 'ann' WHEN 1 THEN 'bob' ELSE 'bot' END AS agent,
  's' || cast(o_orderkey % 20 as string) AS session,
  CASE o_orderstatus WHEN 'F' THEN 'preference' WHEN 'O' THEN 'decision' ELSE '' END AS category,
  o_orderdate AS stamp,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL '400' DAY END AS expires,
  lead('f' || cast(o_orderkey as string)) OVER w AS superseded_by,
  lead(o_orderdate) OVER w AS superseded_at,
  o_orderkey % 11 = 0 AS immutable,
  o_orderkey % 6 = 0 AS human,
  CASE WHEN o_orderkey % 5 = 0 THEN 'feed:news' WHEN o_orderkey % 5 = 1 THEN 'chat:team' ELSE 'agent' END AS origin,
  cast(o_orderkey % 4 as int) AS helpful,
  cast(o_orderkey % 3 as int) AS unhelpful,
  CASE WHEN o_orderkey % 9 = 0 THEN lead('f' || cast(o_orderkey as string)) OVER w END AS challenges,
  o_custkey AS cust,
  o_orderkey AS num
"""
_FACT_WINDOW = "WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
FACTS = f"mem AS (SELECT {_FACT_COLS} FROM orders {_FACT_WINDOW})"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SPARK_NOTES, **{t: table(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders")})


def memory(spark: SparkSession, sf_dir: str, costly: bool = False) -> DataFrame:
    return spark.sql(f"SELECT {_FACT_COLS} FROM {{orders}} {_FACT_WINDOW}", orders=table(spark, sf_dir, "orders", costly))


def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, body, html): each page's html turned to markdown."""
    from notelake.operators.extract import html_to_markdown

    p = table(spark, sf_dir, "pages")
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".md"))
    return p.select(path.alias("path"), html_to_markdown(F.col("html")).alias("body"), "page_id", "url")


_MD = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g')"
for _n in range(1, 7):
    _MD = f"regexp_replace({_MD}, '(?i)<h{_n}[^>]*>', chr(10) || '{'#' * _n} ', 'g')"
_MD = f"regexp_replace({_MD}, '(?i)<li[^>]*>', chr(10) || '- ', 'g')"
_MD = f"regexp_replace({_MD}, '(?i)</(h[1-6]|li|p|div|tr|ul|ol)>|<br[^>]*>', chr(10), 'g')"
_MD = f"regexp_replace({_MD}, '(?s)<[^>]+>', '', 'g')"


def entity_sql(text: str) -> str:
    from notelake.operators.extract import ENTITIES

    for name, char in ENTITIES:
        text = f"replace({text}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return text


_MD = f"trim(regexp_replace(regexp_replace({entity_sql(_MD)}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ')"
PAGES = f"md AS (SELECT 'pages/' || cast(page_id as varchar) || '.md' AS path, {_MD} AS body, page_id, url FROM pages)"
