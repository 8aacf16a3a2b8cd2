"""Text functions as columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are dropped before statements are compared. Negations are not among them.
STOPWORDS = "a an the of to in on at for and or is are was were be been that this it as with".split()


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def without_code(body: Column) -> Column:
    """The body without fenced blocks and code spans."""
    fenced = F.regexp_replace(body, "(?s)```.*?```", "")
    return F.regexp_replace(fenced, "`[^`\n]*`", "")


def normal(text: Column) -> Column:
    """Lower case, anything but letters and numbers of any script to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def content_words(text: Column) -> Column:
    """Distinct words of the normalised text that are not stopwords."""
    return words_of_normal(normal(text))


def words_of_normal(said: Column) -> Column:
    """``content_words`` of a text that is in normal form."""
    words = F.array_distinct(F.split(said, " "))
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOPWORDS))


def content_id(stamp: Column, agent: Column, text: Column) -> Column:
    """Twelve hex digits that stand for a statement."""
    joined = F.concat(stamp, F.lit("\x01"), agent, F.lit("\x01"), normal(text))
    return F.left(F.sha2(joined, 256), F.lit(12))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 where both are empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; 0 for unequal lengths and zero vectors."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def when_chain(pairs, otherwise=None) -> Column:
    """CASE from (condition, value) pairs."""
    chain = None
    for condition, value in pairs:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise)
