"""Source divergence audit: how far apart the sources of a language are in their words.

Every (lang, source) group and every language gives each kept term of the language a smoothed
share p = 1 + floor(UNIT * (count + PRIOR) / (N + PRIOR * V)), in whole numbers. A share depends
on a group and a count alone, so what two groups differ by is a sum over joint cells (count in
one, count in the other) of the number of terms in the cell times the difference of two shares.

Cells are counted on bitmaps. A term has a number in its language; for every (group, count above
zero) the set of its terms is a bitset over those numbers, stored in words of 64 bits. Two groups'
words at the same place are ANDed, and the set bits are the terms of the joint cell. Terms absent
from one group or both follow by complement from the sizes of the sets, so no zero is stored. Terms
are numbered by falling frequency: the counts in a word are alike, so a group has few sets there.

The pairs of groups are the result itself. Words of a place meet in a join on (lang, place, salt)
with as many salts as the language has sixty-fours of sources, so that a task holds few of them.

Defined cases: null text, lang or source count as empty strings, which are a language and a source
like any other; a group without terms, or a language without kept terms, takes part, and its
differences are 0 where no term is kept; repeated rows count each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.llm.common import drop_written, numbered, text_batches, whole_text, written

#: Documents of its language that a kept term is in at least; added to each count; shares are in these units; terms reported a group.
MIN_DOCS, PRIOR, UNIT, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Distinct terms that a task holds before it sends its counts on, and bytes of a text read at a time.
HELD_TERMS, PIECE = 1 << 19, 1 << 20
#: Sources whose bitmaps meet all others of their language under one salt.
SOURCES_PER_SALT = 64

#: Bytes of UTF-8: letters as they are, A-Z lower-cased, all other ASCII white; bytes above belong to other characters.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Runs of ASCII letters and other non-ASCII characters of a text in UTF-8, A-Z lower-cased, a piece of the text at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and _FOLD[text[end]] != 32:  # a piece ends where no term goes on
            end += 1
        yield text[at:end].translate(_FOLD).split()
        at = end


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; the term '' stands for every document of a group."""
    text_batches(docs.sparkSession)
    empty = F.lit("")
    rows = docs.select(
        F.coalesce(docs[lang_col].cast("string"), empty).alias("lang"),
        F.coalesce(docs[source_col].cast("string"), empty).alias("source"),
        whole_text(docs, text_col).cast("binary").alias("text"),
    )
    names = ["lang", "source", "term", "n", "docs"]

    def sent(held: dict) -> pa.RecordBatch:
        of = np.repeat(np.arange(len(held)), [len(docs) for _, docs in held.values()])
        groups = [pa.array([g[i] for g in held], pa.string()).take(pa.array(of)) for i in range(2)]
        terms = pa.array([t for _, docs in held.values() for t in docs], pa.binary()).cast(pa.string())
        n = pa.array([said[t] for said, docs in held.values() for t in docs], pa.int64())
        docs = pa.array([d for _, docs in held.values() for d in docs.values()], pa.int64())
        return pa.RecordBatch.from_arrays([*groups, terms, n, docs], names=names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0
        for b in batches:
            for lang, source, text in zip(*[b.column(i) for i in range(3)]):
                said, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                before, mine = len(docs), {b""}
                for some in terms_of(text.as_py()):
                    said.update(some)
                    mine.update(some)
                docs.update(mine)
                size += len(docs) - before
                if size >= HELD_TERMS:
                    yield sent(held)
                    held, size = {}, 0
        yield sent(held)

    return (
        rows.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a count among ``total``, exact for any count."""
    wide = "decimal(26,0)"
    above = F.lit(UNIT).cast("decimal(11,0)") * (count + PRIOR).cast(wide)
    below = (total + PRIOR * terms).cast(wide)
    return F.when(below > 0, F.call_function("div", above, below) + 1)


def bitmaps(counts: DataFrame) -> DataFrame:
    """(lang, source, n, place, bits) of (lang, source, number, n): words of 64 bits of the set of terms with count n."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("number") % 64).cast("int"))
    return counts.groupBy("lang", "source", "n", F.floor(F.col("number") / 64).alias("place")).agg(F.bit_or(bit).alias("bits"))


def _gap(p: str, q: str) -> Column:
    return F.abs(F.col(p) - F.col(q))


def pair_values(maps: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language.

    ``groups``: (lang, source, total, terms, p0), p0 the share of a count of zero. ``maps``: bitmaps
    with p, the share of their count. With J the joint cells of counts above zero, complement gives
      sum J(x, y) * (f(x, y) - f(x, 0) - f(0, y) + f(0, 0))
      + sum |x| * (f(x, 0) - f(0, 0)) + sum |y| * (f(0, y) - f(0, 0)) + V * f(0, 0).
    """
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.select("lang", "source", "terms", "p0").join(other, "lang").where("source <> item")
    at_zero = pairs.select("lang", "source", "item", (F.col("terms") * _gap("p0", "q0")).alias("value"))
    # sets of one count, a row per (group, count), against the zero of each other source
    sizes = maps.groupBy("lang", "source", "n", "p").agg(F.sum(F.bit_count("bits").cast("long")).alias("size"))
    alone = (
        sizes.join(pairs.drop("terms"), ["lang", "source"])
        .groupBy("lang", "source", "item")
        .agg(F.sum(F.col("size") * (_gap("p", "q0") - _gap("p0", "q0"))).alias("value"))
    )
    salts = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES_PER_SALT).cast("int").alias("salts"))
    base = maps.join(groups.select("lang", "source", "p0"), ["lang", "source"]).join(salts, "lang")
    a = base.withColumn("salt", F.pmod(F.xxhash64("source"), F.col("salts")).cast("int")).select("lang", "place", "salt", "source", "bits", "p", "p0")
    b = base.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(
        "lang", "place", "salt", F.col("source").alias("item"), F.col("bits").alias("bits_b"), F.col("p").alias("q"), F.col("p0").alias("q0")
    )
    both = F.bit_count(F.col("bits").bitwiseAND(F.col("bits_b"))).cast("long")
    joint = (
        a.join(b, ["lang", "place", "salt"])
        .where(F.col("source") < F.col("item"))
        .groupBy("lang", "source", "item")
        .agg(F.sum(both * (_gap("p", "q") - _gap("p", "q0") - _gap("p0", "q") + _gap("p0", "q0"))).alias("value"))
    )
    one_way = at_zero.where("source < item").unionByName(joint)
    mirrored = one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    marginal = alone.unionByName(alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    return one_way.unionByName(mirrored).unionByName(marginal).groupBy("lang", "source", "item").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS
) -> DataFrame:
    """(lang, source, part, item, value, rank) for part ``pair`` (all sources of the language) and ``term`` (first ``top_terms``)."""
    counts = written(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    kept = (
        counts.where("term <> ''")
        .groupBy("lang", "term")
        .agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs"))
        .where(F.col("lang_docs") >= min_docs)
        .drop("lang_docs")
    )
    # falling powers of two of the count, dealt by hash within each, so that no window holds a language
    cells = [-F.floor(F.log2("lang_n")), F.pmod(F.xxhash64("term"), F.lit(64))]
    terms = written(numbered(kept, ["lang"], cells, [F.col("term")], "number"), "kept-terms")
    mine = written(counts.where("term <> ''").join(terms, ["lang", "term"]).select("lang", "source", "term", "number", "n", "lang_n"), "kept-counts")
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    every = counts.where("term = ''").select("lang", "source")
    groups = (
        every.join(mine.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")])
    )
    groups = written(groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("terms"))), "groups")
    shared = mine.join(groups, ["lang", "source"])
    maps = bitmaps(mine).join(groups.select("lang", "source", "total", "terms"), ["lang", "source"])
    maps = written(maps.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"))).drop("total", "terms"), "bitmaps")
    over = (
        shared.select("lang", "source", F.col("term").alias("item"), (share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).alias("value"))
        .where("value > 0")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    rank = F.row_number().over(order)
    first = over.withColumn("rank", rank).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    pairs = written(pair_values(maps, groups), "pair-values").withColumn("rank", rank).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    result = written(first.select(*columns).unionByName(pairs.select(*columns)), "divergence")
    for done in (counts, terms, mine, groups, maps):
        drop_written(done)
    return result
