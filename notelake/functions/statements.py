"""The grammar of short statements: attribute, negation, typed values and slots, as columns and for the fold.

The plain functions at the end decide one statement at a time, for the ordered fold; the columns
above them do the same inside the JVM. Word boundaries are those of ASCII words on both sides.
"""

from __future__ import annotations

import re
from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import STOPWORDS, content_words, let, normal

# -- fixed values: results depend on exactly these

#: Verbs that assign a value to an attribute of a subject.
PREDICATES = (
    "prefers", "prefer", "likes", "dislikes", "uses", "using", "runs", "lives in", "works at", "works on", "is called", "is named", "wants",
    "needs", "owns", "has", "avoids", "hates", "loves", "drives", "reads", "writes", "speaks", "believes", "chose", "chooses", "picked",
    "picks", "is", "was",
)
#: Phrases that retract, in normal form.
NEGATIONS = (
    "no longer", "not anymore", "no more", "stopped", "quit", "gave up", "doesn t", "does not", "doesnt", "isn t", "is not", "isnt", "never again",
)
#: Numbers in words, and words that count.
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17",
    "eighteen": "18", "nineteen": "19", "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70",
    "eighty": "80", "ninety": "90", "hundred": "100", "thousand": "1000", "once": "1", "twice": "2", "thrice": "3",
}
#: Words of a chat that name no slot.
SLOT_NOISE = (
    "the and but for with can you your please thanks know think want like just really some any get got about would could should was were "
    "been have has had there here what when how why which that this these those now then also still very much more most help tips give "
    "wondering recently currently around"
).split()
#: Units and light verbs: two statements may share them and be about different things.
GENERIC_TERMS = (
    "second seconds minute minutes hour hours day days week weeks month months year years morning evening night daily weekly monthly times "
    "time dollars bucks miles mile kilometers kilometres pounds kilos kilograms degrees percent points pages words steps cups litres liters "
    "grams ounces takes took taking spent spend spending made make making went going goes doing does done using used set setting total "
    "average end start started per each every another other thinking planning trying looking need needs needed way thing things bit lot "
    "little long good great new old first last next back over down across into from than before after during while"
).split()
#: Kinds of value in the order they are looked for, in ASCII patterns; what one has matched is masked for the next.
VALUE_PATTERNS = (
    ("money", r"[$£€]\s?\d[\d,]*(?:\.\d+)?|\b\d[\d,]*(?:\.\d+)?\s?(?:dollars?|usd|eur|euros?|gbp|pounds?)\b"),
    ("duration", r"\b\d{1,2}:\d{2}(?::\d{2})?\b"),
    ("percent", r"\b\d+(?:\.\d+)?\s?%|\b\d+(?:\.\d+)?\s?percent\b"),
    ("number", r"\b\d[\d,]*(?:\.\d+)?\b"),
)
YEAR = "^(19|20)[0-9]{2}$"
#: Similarity from which a statement repeats another, and from which a negation retracts it.
DUPLICATE, RETRACTION = 0.9, 0.45
#: What two statements of one slot share: slot words, of the shorter's share, and words that are not generic.
SHARED_TERMS, SLOT_OVERLAP, TELLING_TERMS = 3, 0.34, 1

# -- columns

_LONGEST = "|".join(sorted(PREDICATES, key=lambda p: (-len(p), p)))
#: The earliest predicate of a statement in normal form, the longest of those that start there.
ATTRIBUTE = rf"^(?:(.*?) )??({_LONGEST})(?: (.*))?$"
_ARTICLES = "^(?:(?:the|a|an)(?: |$))+"
NEGATION = "(?:^| )(?:" + "|".join(NEGATIONS) + ")(?: |$)"
NUMBER_WORD = r"\b(?:" + "|".join(NUMBER_WORDS) + r")\b"


def _java(pattern: str) -> str:
    """The pattern with boundaries of ASCII words, which Java's own are not; what begins with one goes on with a word."""
    pattern = re.sub(r"(^|\|)\\b", r"\1(?<![A-Za-z0-9_])", pattern)
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return pattern.replace(r"\b", edge)


def attribute(text: Column) -> Column:
    """struct(subject, predicate, value) of a statement; null without a predicate, a subject or a value."""
    return attribute_of_normal(normal(text))


def attribute_of_normal(said: Column) -> Column:
    """``attribute`` of a statement that is in normal form."""
    # one pass of the pattern; what does not match stays whole
    parts = F.split(F.regexp_replace(said, ATTRIBUTE, "$1\x01$2\x01$3"), "\x01")
    bare = lambda x: F.regexp_replace(x, _ARTICLES, "")

    def found(p: Column) -> Column:
        made = F.struct(bare(F.get(p, F.lit(0))).alias("subject"), F.get(p, F.lit(1)).alias("predicate"), bare(F.get(p, F.lit(2))).alias("value"))
        return F.when(F.size(p) == 3, let(made, lambda m: F.when((m["subject"] != "") & (m["value"] != ""), m)))

    return let(parts, found)


def is_negation(text: Column) -> Column:
    return normal(text).rlike(NEGATION)


def value_text(raw: Column) -> Column:
    """A literal without separators and marks: 1,200.0 and $1200 are 1200."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "[^0-9:.]", ""), r"\.$", ""), r"\.0$", "")


def values(text: Column) -> Column:
    """array of distinct (kind, text), kinds in order; bare years between 1900 and 2099 are no numbers."""
    of = lambda kind, texts: F.transform(texts, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))

    def look(i: int, rest: Column, found: Column) -> Column:
        """The kinds from the ``i``-th on; each sees the text as the one before has left it, masked once."""
        kind, pattern = VALUE_PATTERNS[i]
        hits = F.transform(F.regexp_extract_all(rest, F.lit(_java(pattern)), F.lit(0)), value_text)
        if kind == "number":
            hits = F.filter(hits, lambda x: ~x.rlike(YEAR))
            said = F.regexp_extract_all(rest, F.lit(_java(NUMBER_WORD)), F.lit(0))
            table = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
            hits = F.concat(hits, F.transform(said, lambda w: F.element_at(table, w)))
        found = F.concat(found, of(kind, F.filter(hits, lambda x: x != "")))
        if i + 1 == len(VALUE_PATTERNS):
            return F.array_distinct(found)
        return let(F.regexp_replace(rest, _java(pattern), " "), lambda r: look(i + 1, r, found))

    return let(F.lower(text), lambda r: look(0, r, F.array().cast("array<struct<kind:string,text:string>>")))


def slot_terms(words: Column) -> Column:
    """Of a statement's content words those that say what it is about: no fillers, short words and numbers."""
    return F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~w.isin(*SLOT_NOISE, *NUMBER_WORDS) & ~w.rlike("[0-9]"))


def with_value_update(rows: DataFrame, where: Column | None = None) -> DataFrame:
    """``rows`` (old, new, ...) with ``shared`` slot terms, their share of the shorter's (``overlap``), and whether the one value of
    a kind differs in the same slot (``update``); null where the condition does not hold.

    Each step is a column of its own, so that it is worked out once, and values are looked for only in statements of one slot.
    """
    when = (lambda v: v) if where is None else (lambda v: F.when(where, v))
    words = {f"{t}_words": content_words(F.col(t)) for t in ("old", "new") if f"{t}_words" not in rows.columns}
    slots = rows.withColumns(words).withColumns({f"{t}_slots": when(slot_terms(F.col(f"{t}_words"))) for t in ("old", "new")})
    both = slots.withColumns({"both": F.array_intersect("old_slots", "new_slots"), "least": F.least(F.size("old_slots"), F.size("new_slots"))})
    telling = F.size(F.filter("both", lambda w: ~w.isin(*GENERIC_TERMS)))
    overlap = F.when(F.col("least") == 0, F.lit(0.0)).otherwise(F.col("shared") / F.col("least"))
    counted = both.withColumn("shared", when(F.size("both"))).withColumn("overlap", when(overlap))
    same = counted.withColumn("same_slot", (F.col("shared") >= SHARED_TERMS) & (F.col("overlap") >= SLOT_OVERLAP) & (telling >= TELLING_TERMS))
    said = same.withColumns({f"{t}_values": F.when(F.col("same_slot"), values(F.col(t))) for t in ("old", "new")})
    differs = F.lit(False)
    for kind, _ in VALUE_PATTERNS:
        x, y = (F.filter(f"{t}_values", lambda e: e["kind"] == kind) for t in ("old", "new"))
        differs = differs | ((F.size(x) == 1) & (F.size(y) == 1) & (F.get(x, F.lit(0))["text"] != F.get(y, F.lit(0))["text"]))
    return said.withColumn("update", F.col("same_slot") & F.coalesce(differs, F.lit(False)))


# -- one statement at a time, for the fold

_PLAIN_ATTRIBUTE, _PLAIN_NEGATION = re.compile(ATTRIBUTE), re.compile(NEGATION)
_PLAIN_VALUES = [(kind, re.compile(p, re.ASCII)) for kind, p in VALUE_PATTERNS]
_PLAIN_NUMBER = re.compile(NUMBER_WORD, re.ASCII)
_STOP, _NOISE, _GENERIC = frozenset(STOPWORDS), frozenset([*SLOT_NOISE, *NUMBER_WORDS]), frozenset(GENERIC_TERMS)


class Statement:
    """What the fold needs to know of a statement, worked out once; slots and values only where they are asked for."""

    def __init__(self, text: str):
        self.text = text
        said = "".join([c if c.isalpha() or c.isnumeric() else " " for c in text.lower()]).split()
        n = " ".join(said)
        self.words = frozenset([w for w in said if w not in _STOP])
        m = _PLAIN_ATTRIBUTE.match(n)
        subject, value = (re.sub(_ARTICLES, "", m[i] or "") for i in (1, 3)) if m else ("", "")
        self.attribute = (subject, m[2], value) if subject and value else None
        self.negated = bool(_PLAIN_NEGATION.search(n))

    @cached_property
    def slots(self) -> frozenset:
        return frozenset(w for w in self.words if len(w.encode()) >= 3 and w not in _NOISE and not re.search("[0-9]", w))

    @cached_property
    def values(self) -> dict[str, list[str]]:
        return self._values(self.text.lower())

    @staticmethod
    def _values(rest: str) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {}
        for kind, pattern in _PLAIN_VALUES:
            hits = [re.sub(r"\.0$", "", re.sub(r"\.$", "", re.sub("[^0-9:.]", "", h))) for h in pattern.findall(rest)]
            if kind == "number":
                hits = [h for h in hits if not re.match(YEAR, h)] + [NUMBER_WORDS[w] for w in _PLAIN_NUMBER.findall(rest)]
            if own := list(dict.fromkeys(h for h in hits if h)):
                found[kind] = own
            rest = pattern.sub(" ", rest)
        return found

    def similarity(self, other: Statement) -> float:
        if not self.words or not other.words:
            return 0.0
        shared = len(self.words & other.words)
        return shared / (len(self.words) + len(other.words) - shared)

    def corrects(self, old: Statement) -> bool:
        """Whether it states another value for the slot of ``old``."""
        both = self.slots & old.slots
        if len(both) < SHARED_TERMS or len(both - _GENERIC) < TELLING_TERMS or len(both) < SLOT_OVERLAP * min(len(self.slots), len(old.slots)):
            return False
        return any(
            len(v) == 1 and len(self.values.get(kind, ())) == 1 and v[0] != self.values[kind][0] for kind, v in old.values.items()
        )


@lru_cache(maxsize=4096)
def statement(text: str) -> Statement:
    return Statement(text)
