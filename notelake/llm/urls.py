"""URL filters: pattern rules behind an index of their rarest literal token.

Every rule names the literal tokens (runs of ASCII letters and digits) that a url it
matches must contain. The rule is filed under whichever of these is rarest among the urls
at hand. A url's own tokens fetch candidate rules by an equi-join with that index, and only
candidates run their regular expression. Work is done once per distinct url, and verdicts are
joined back; urls on many rows get theirs by broadcast, so that none meets in one task.

Host rules (a host and a path prefix) fit their host and its subdomains; of several that
fit, the longest wins, then the longer host, then the name. Where none fits, pattern rules
decide: one that fits blocks, else the url is allowed.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule
and is allowed; an empty rule list allows everything; ids may repeat or be null, and
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import joined_hot, written

#: Index rows up to which the index is broadcast: a few hundred bytes each.
BROADCAST_RULES = 10_000
#: A url on more than one in so many rows has its verdict broadcast; there are fewer than so many of them.
HOT_URLS = 1000


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is matched against host + path; ``tokens`` are whole tokens of every url it matches."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    host_length: int = 0  # over 0 for host rules

    def __post_init__(self):
        if not self.tokens:
            raise ValueError(f"rule {self.name} has no literal token to be filed under")


def host_rule(rule: str, action: str) -> UrlRule:
    """``example.com/en/``: the host and its subdomains, where the path starts with /en/."""
    host, _, path = rule.partition("/")
    bounded = f"{host}/{path}"
    tokens = re.findall(r"[A-Za-z0-9]+(?![A-Za-z0-9])", bounded)
    if bounded[-1].isalnum():
        tokens.pop()  # a url may go on where the rule's path ends
    return UrlRule(rule, action, rf"^([^/]*\.)?{re.escape(host)}/{re.escape(path)}", tuple(tokens), len(host))


def host_word(word: str) -> UrlRule:
    """Blocks hosts with a label that holds ``word`` as one of its dash-separated parts."""
    return UrlRule(f"host:{word}", "block", rf"^([^/]*[.\-])?{word}([.\-][^/]*)?(/|$)", tuple(word.split("-")))


#: The rules of the query, in the order of its contract.
HOST_RULES = (
    host_rule("com/", "allow"),
    host_rule("example.com/en/", "block"),
    host_rule("www.example.com/en/", "allow"),
    host_rule("net/es/", "block"),
    host_rule("net/fr/", "block"),
)
#: Words of hosts that serve gambling, drugs, adult content, trackers and spam.
HOST_WORDS = ("casino", "bets", "pills", "adult", "spam", "ads-track")
PATTERN_RULES = tuple(host_word(w) for w in HOST_WORDS)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    raw = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(subject: Column) -> Column:
    return F.array_distinct(F.filter(F.split(subject, "[^A-Za-z0-9]+"), lambda t: t != ""))


def index_rules(tokens: DataFrame, rules: Sequence[UrlRule]) -> DataFrame:
    """A row per rule under its rarest token; ``tokens`` has a row per (url, token)."""
    spark = tokens.sparkSession
    needed = spark.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.tokens})], "token string")
    counted = tokens.join(F.broadcast(needed) if len(rules) <= BROADCAST_RULES else needed, "token").groupBy("token")
    seen = {r["token"]: r["n"] for r in counted.agg(F.count("*").alias("n")).collect()}  # at most a row per rule token
    rows = [
        (
            min(r.tokens, key=lambda t: (seen.get(t, 0), t)),
            r.name,
            r.action,
            r.pattern.replace("\\/", "/").replace("\\-", "-") if r.host_length else r.pattern,
            r.host_length,
        )
        for r in rules
    ]
    return spark.createDataFrame(rows, "token string, name string, action string, pattern string, host_length int")


def filter_urls(
    pages: DataFrame,
    host_rules: Sequence[UrlRule] = HOST_RULES,
    pattern_rules: Sequence[UrlRule] = PATTERN_RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """id, host, path, rule (the host rule that won, else null), verdict, pattern (the pattern rule that blocked)."""
    rows = pages.select(pages[id_col].alias(id_col), pages[url_col].cast("string").alias("url"))
    rules = [*host_rules, *pattern_rules]
    counted = written(rows.where("url is not null").groupBy("url").agg(F.count("*").alias("n")), "urls")
    parts = counted.select("url", F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("subject"))
    none = F.lit(None).cast("string")
    if rules:
        tokens = parts.select("url", "subject", F.explode(tokens_of(F.col("subject"))).alias("token"))
        index = index_rules(tokens.select("token"), rules)
        candidates = tokens.join(F.broadcast(index) if len(rules) <= BROADCAST_RULES else index, "token")
        fits = candidates.where(F.rlike("subject", "pattern"))
        rank = F.struct(F.length("name").alias("n"), "host_length", "name", "action")
        won = fits.groupBy("url").agg(
            F.max(F.when(F.col("host_length") > 0, rank)).alias("best"),
            F.min(F.when(F.col("host_length") == 0, F.col("name"))).alias("pattern"),
        )
        hot = counted.where(F.col("n") * HOT_URLS > rows.count())
        rows = joined_hot(rows, written(won, "verdicts"), ["url"], hot)
        rule, action, pattern = F.col("best.name"), F.col("best.action"), F.col("pattern")
    else:
        rule, action, pattern = none, none, none
    return rows.select(
        id_col,
        F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"),
        rule.alias("rule"),
        F.coalesce(action, F.when(pattern.isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(rule.isNull(), pattern).alias("pattern"),
    )
