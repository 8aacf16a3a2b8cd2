"""Quality rules as a short-circuit cascade.

The base statistics of a text are computed once, by array functions in the row itself; no
row meets another, so nothing is shuffled. The rules then run as one CASE: a rule is only
evaluated for texts that every rule before it let pass. Their order is found on a sample,
drawn evenly from all rows: each rule's rejection rate is counted and its cost is measured,
as the time that evaluating it on the sample takes, and rules run by rejection per cost,
highest first. The order changes what a run costs and which rule is named, never the verdict.

Defined cases: a null or empty text has no words and fails the base; ids may be null or
repeated; ties in rejection per cost go by rule name; a table of no rows has its rules by
name; any DataFrame will do, filtered or not and from any source, and the text column may
have any name; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import let, spaced, whole_text, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Rows that the estimate evaluates, about.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """``reject`` is SQL over the base statistics and ``text``; ``work`` is SQL for what judging a row costs.

    One is a comparison of numbers. A search for one character takes about a hundredth of that a character, a regular expression about four times as long.
    """

    name: str
    reject: str
    work: str = "1"


#: What the query runs. The last two read the text again, so they cost its length.
RULES = (
    Rule("symbols", "n_symbols * 10 > n_words * 6"),
    Rule("word_length", "word_chars < n_words * 2 or word_chars > n_words * 25"),
    Rule("duplicate_lines", "n_dup_lines * 2 > n_lines"),
    Rule("repeats", "n_repeat_words * 10 > n_words * 4"),
    Rule(
        "shouting",
        "length(regexp_replace(text, '[^A-Z]+', '')) * 2 > word_chars",
        "1 + length(text) / 25",
    ),
    Rule(
        "exclamations",
        "(length(text) - length(replace(text, '!', ''))) * 2 > n_words",
        "1 + length(text) / 100",
    ),
)


def repeated_word_count(found: Column) -> Column:
    """Words of the array ``found`` that lie in a 3-word window found twice or more in it.

    Windows are compared by 64-bit hash. Where all differ, as in most texts, that is all;
    else (hash, position) pairs are sorted, so that equal windows become neighbours.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            last = F.size(s) - 1

            def position(i: Column) -> Column:
                here = F.get(s, i)["h"]
                same = ((i > 0) & (F.get(s, i - 1)["h"] == here)) | ((i < last) & (F.get(s, i + 1)["h"] == here))
                return F.when(same, F.get(s, i)["i"])

            at = F.filter(F.transform(F.sequence(F.lit(0), last), position), lambda p: p.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, twice))

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        window = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(window, covered))

    return let(found, of)


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and the statistics every rule may use, one row per document."""
    text = docs.select(docs[id_col].alias(id_col), whole_text(docs, text_col).alias("text"))
    bare = spaced(F.col("text"))
    marks = F.length("text")
    unmarked = F.col("text")
    for c in SYMBOLS:
        unmarked = F.replace(unmarked, F.lit(c), F.lit(""))
    worded = F.filter(F.split("text", "\n"), lambda line: F.trim(spaced(line)) != "")
    with_arrays = text.withColumns({"__words": words(F.col("text")), "__lines": worded})
    return with_arrays.select(
        id_col,
        "text",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.replace(bare, F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (marks - F.length(unmarked)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        repeated_word_count(F.col("__words")).cast("long").alias("n_repeat_words"),
    )


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def order_rules(statistics: DataFrame, rules: Sequence[Rule] = RULES) -> list[Rule]:
    """The rules by rejection per cost, both estimated on ``statistics``, a bounded sample, in one aggregation.

    A cost is the mean of the rule's ``work``, so the same rows always give the same order.
    """
    if len(rules) < 2:
        return list(rules)
    rates = [F.avg(F.expr(f"cast(({r.reject}) as int)")).alias(f"r{i}") for i, r in enumerate(rules)]
    costs = [F.avg(F.expr(f"cast(({r.work}) as double)")).alias(f"c{i}") for i, r in enumerate(rules)]
    found = statistics.agg(*rates, *costs).first()

    def gain(i: int) -> tuple:
        cost = found[f"c{i}"] or 1.0
        return (-round((found[f"r{i}"] or 0.0) / cost, 12), round(cost, 6), rules[i].name)

    return [rules[i] for i in sorted(range(len(rules)), key=gain)]


def even_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 11) -> DataFrame:
    """About ``rows`` rows, each row of the frame as likely as any other."""
    return docs.sample(min(1.0, rows / max(1, docs.count())), seed)


def cascade(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, else null."""
    verdict = F.when(F.lit(False), F.lit(None).cast("string"))
    for r in rules:
        verdict = verdict.when(F.expr(r.reject), F.lit(r.name))
    return verdict


def judge(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, text, base statistics, base_failed, rejected_by (null when kept) and kept."""
    statistics = base_statistics(docs, id_col, text_col)
    ordered = order_rules(base_statistics(even_sample(docs.select(id_col, text_col)), id_col, text_col), rules)
    failed = F.expr(BASE_FAILED)
    return statistics.withColumn("base_failed", failed).withColumn(
        "rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(ordered))
    ).withColumn("kept", F.col("rejected_by").isNull())
