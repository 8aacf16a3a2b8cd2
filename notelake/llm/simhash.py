"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

A fingerprint has 64 bits: bit i is set when it is set in over half of the XXH64 hashes
(seed 42) of the text's shingles, repeats included. Two fingerprints link when at most
``max_distance`` bits differ.

Links are found by multi-index hashing. The fingerprint is cut into two segments of 32
bits; if at most three bits differ, at most one differs in one of the segments. Every
distinct fingerprint stands in the table under its two segments, asks for the 33 values in
the ball of radius one around each of its segments, and the matches are verified by the
complete distance inside the join. Only distinct fingerprints take part, so copies cost
nothing. Groups need no more links than hold them together, so near_duplicates first links
every fingerprint with one or two centres of each segment value it meets, and then verifies
pairs between groups alone: a dense group leaves stars, not all its pairs.

``near_copies`` finds groups of texts whose sets of word shingles are alike, exactly and
completely. Fingerprints of the shingle sets give the first links, by the same multi-index
hashing; every link is verified on the sets. Pairs too far apart for their fingerprints are
met by a prefix filter, and verified alike.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and
links like any other; a text with fewer words than a shingle is one shingle; rows with a
null id get their group through their fingerprint, and a group without any id has a null
component_id; repeated rows repeat in the result; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from notelake.llm.common import drop_written, text_batches, whole_text, written
from notelake.llm.components import connected_components

SEED = 42
#: Shingles whose bits are counted at a time, so that a long text needs little memory.
BLOCK = 1 << 14


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words of the text with A-Z lower-cased."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes split at ASCII white space alone
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= size:
        return np.array([digest(joined, SEED)] if found else [], dtype=np.uint64)
    starts = [0]
    at = 0
    for w in found:
        at += len(w) + 1
        starts.append(at)
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:])], dtype=np.uint64)


def fingerprint_of(text: str | None, size: int = 3) -> int:
    return majority_bits(shingle_hashes(text or "", size))


def majority_bits(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = hashes[i : i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: Column, size: int = 3) -> Column:
    """The fingerprint as a signed 64-bit number."""

    @F.pandas_udf(T.LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, size) for t in texts], dtype="int64")

    return simhash(text)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _segments(n: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each of ``n`` segments of a fingerprint."""
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


#: A key holds a segment's bits, and the segment's number from this bit on.
NUMBER_AT = 33


def _table_and_probes(distinct: DataFrame, fp: str, max_distance: int, segments: int, *more: str) -> tuple[DataFrame, DataFrame, Column]:
    """Entries (b, key), probes (a, key) and the condition that a pair is within the distance and leaves in one segment alone."""
    if segments < 2 or not 0 <= max_distance < 2 * segments:
        raise ValueError("there must be two segments or more, and max_distance less than twice as many")
    cut = _segments(segments)
    keys = [
        F.shiftrightunsigned(F.col(fp), low).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(i << NUMBER_AT))
        for i, (low, width) in enumerate(cut)
    ]
    balls = F.concat(*[_ball(key, [0, *(1 << k for k in range(width))]) for key, (_, width) in zip(keys, cut)])
    entries = distinct.select(F.col(fp).alias("b"), *[F.col(c).alias(f"{c}_b") for c in more], F.explode(F.array(*keys)).alias("key"))
    probes = distinct.select(F.col(fp).alias("a"), *[F.col(c).alias(f"{c}_a") for c in more], F.explode(balls).alias("key"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    fits = F.bit_count(differ) <= max_distance
    for i, (low, width) in enumerate(cut[:-1]):
        apart = F.bit_count(F.shiftrightunsigned(differ, low).bitwiseAND(F.lit((1 << width) - 1))) > 1
        fits = fits & ((F.shiftright(F.col("key"), NUMBER_AT) <= i) | apart)
    return entries, probes, fits


def links(fingerprints: DataFrame, fp: str = "fp", max_distance: int = 3, segments: int = 2) -> DataFrame:
    """(a, b), once, for each pair of distinct fingerprints, a < b, at most ``max_distance`` bits apart.

    One flipped bit a segment must be enough, so ``max_distance`` is less than twice ``segments``.
    More segments have shorter, less selective keys. A pair that could meet in several segments
    leaves the join in the first of them alone. Spark sizes an exploded table as if it were not,
    so joins of probes and entries are never left to choose a broadcast.
    """
    distinct = fingerprints.select(fp).where(F.col(fp).isNotNull()).distinct()
    entries, probes, fits = _table_and_probes(distinct, fp, max_distance, segments)
    met = probes.withColumnRenamed("key", "asked").join(entries.hint("merge"), (F.col("asked") == F.col("key")) & (F.col("a") < F.col("b")) & fits)
    return met.select("a", "b")


def spanning_links(fingerprints: DataFrame, fp: str = "fp", max_distance: int = 3, segments: int = 2) -> DataFrame:
    """(a, b), a < b: enough of ``links`` to have the same components.

    First every probe meets two centres, the least and the greatest fingerprint, of the segment
    values in its balls. What these links leave apart is then joined in full, where only pairs
    between different groups pass.
    """
    distinct = fingerprints.select(fp).where(F.col(fp).isNotNull()).distinct()
    entries, probes, _ = _table_and_probes(distinct, fp, max_distance, segments)
    ends = entries.groupBy(F.col("key").alias("at")).agg(F.min("b").alias("low"), F.max("b").alias("high"))
    centres = ends.select("at", F.explode(F.array_distinct(F.array("low", "high"))).alias("c"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("c"))) <= max_distance
    met = probes.join(centres.hint("merge"), (F.col("key") == F.col("at")) & (F.col("a") != F.col("c")) & near)
    stars = written(met.select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct(), "stars")
    groups = connected_components(stars, "a", "b").withColumnRenamed("node", "member")
    rooted = distinct.join(groups.hint("merge"), distinct[fp] == groups["member"], "left").select(fp, F.coalesce("root", fp).alias("root"))
    rooted = written(rooted, "rooted")
    entries, probes, fits = _table_and_probes(rooted, fp, max_distance, segments, "root")
    apart = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & fits
    between = probes.withColumnRenamed("key", "asked").join(entries.hint("merge"), (F.col("asked") == F.col("key")) & apart)
    return stars.unionByName(between.select("a", "b"))


def _ball(key: Column, flips: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(f).cast("long") for f in flips]), lambda f: key.bitwiseXOR(f))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_distance: int = 3
) -> DataFrame:
    """(id, fp, component_id), a row per document; component_id is the smallest id reachable by links."""
    text_batches(docs.sparkSession)
    prints = written(
        docs.select(docs[id_col].alias(id_col), fingerprint(whole_text(docs, text_col), shingle).alias("fp")), "prints"
    )
    smallest = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    found = connected_components(spanning_links(prints, "fp", max_distance), "a", "b")
    rooted = (
        smallest.join(found.hint("merge"), smallest["fp"] == found["node"], "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = written(rooted.join(least.hint("merge"), "root").select(F.col("fp").alias("group_fp"), "component_id"), "groups")
    return prints.join(groups.hint("merge"), prints["fp"] == groups["group_fp"]).select(id_col, "fp", "component_id")


#: 64-bit words of a set's parity bits, which bound from above what two sets can share.
PARITY_WORDS = 8
#: Of 256 values of a shingle hash's low byte, those that the first look at a text takes.
SAMPLED = 77


def set_sample(text: Column, size: int = 5) -> Column:
    """struct(n, some): how many distinct shingles a text has, and those of them whose hash is sampled."""

    @F.pandas_udf("n int, some array<bigint>")
    def sampled(texts: pd.Series) -> pd.DataFrame:
        found = [np.unique(shingle_hashes(t or "", size)) for t in texts]
        some = [s[(s & np.uint64(255)) < SAMPLED].view(np.int64) for s in found]
        return pd.DataFrame({"n": [len(s) for s in found], "some": some})

    return sampled.asNondeterministic()(text)


def shingle_set(text: Column, size: int = 5) -> Column:
    """struct(s, fp, parity): a text's distinct shingles as 64-bit hashes, their fingerprint, and their parity bits."""

    @F.pandas_udf("s array<bigint>, fp bigint, parity array<bigint>")
    def shingles(texts: pd.Series) -> pd.DataFrame:
        found = [np.unique(shingle_hashes(t or "", size)) for t in texts]
        return pd.DataFrame(
            {"s": [s.view(np.int64) for s in found], "fp": [majority_bits(s) for s in found], "parity": [parity_bits(s) for s in found]}
        )

    return shingles.asNondeterministic()(text)


def parity_bits(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY_WORDS classes of hashes, whether it has an odd number of members."""
    width = 64 * PARITY_WORDS
    odd = np.bincount(((hashes >> np.uint64(32)) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, max_distance: int = 3
) -> DataFrame:
    """(id, component_id) of documents with a near copy: word shingles with a Jaccard similarity of ``similarity`` or more.

    Complete: every pair that reaches the similarity ends in one component. Documents that too
    few others share shingles with go first, by an exact bound (``_likely``). Equal sets form a
    class, of which one takes part. Classes whose fingerprints link by multi-index hashing are
    verified on their sets. The rest meets in shingles: with a set's shingles in order of rarity,
    two such sets share one of their prefixes' (``_rare_keys``). In a shingle every class is held
    against the most typical one; pairs that are not in one group by then are held against each
    other, where sizes and parity bits bound what they share before sets are compared.

    Rows that repeat an id are one document with several texts; rows with a null id and texts
    without words take no part; an empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), whole_text(docs, text_col).alias("text")).where("id is not null")
    likely = _likely(rows, shingle, similarity)
    told = rows.join(likely.hint("merge"), "id").select("id", shingle_set(F.col("text"), shingle).alias("p"))
    told = told.select("id", F.size("p.s").alias("n"), "p.fp", "p.parity", "p.s").where("n > 0")
    sets = written(told.withColumn("mark", F.struct(F.xxhash64("s"), F.hash("s"), F.size("s"))), "sets")
    marks = sets.groupBy("mark").agg(F.min("id").alias("class"))
    members = written(sets.select("id", "mark").join(marks.hint("merge"), "mark").select("id", "mark", "class"), "members")
    equal = members.where("id <> class").select(F.col("class").alias("x"), F.col("id").alias("y")).distinct()
    firsts = sets.groupBy("mark").agg(F.min_by(F.struct("id", "n", "fp", "parity", "s"), "id").alias("f")).select("f.*")
    firsts = written(firsts, "firsts")
    keys = written(_rare_keys(firsts, similarity), "keys")
    buckets = written(_meeting(keys, "id").join(firsts.select("id", "n", "parity").hint("merge"), "id"), "buckets")
    drop_written(keys)
    starts = _print_pairs(firsts, max_distance).unionByName(_star_pairs(buckets, similarity)).distinct()
    linked = written(_alike(starts, firsts, similarity), "linked")
    groups = connected_components(linked, "x", "y")
    rest = written(_alike(_pairs_between(buckets, groups, similarity), firsts, similarity), "rest")
    found = connected_components(equal.unionByName(linked).unionByName(rest), "x", "y")
    for done in (likely, sets, members, firsts, buckets, linked, rest):
        drop_written(done)
    return found.select(F.col("node").alias(id_col), F.col("root").alias("component_id"))


def _likely(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(id) without documents that nothing can be like.

    A document with a near copy has at most n - similarity * n shingles that no other document
    has. Of the shingles whose hash is sampled, the same for all documents, it can have no more
    than that either; what has more goes. Short texts with fewer sampled shingles than that all stay.
    """
    seen = rows.select("id", set_sample(F.col("text"), shingle).alias("p")).select("id", "p.n", "p.some").where("n > 0")
    spare = F.col("n") - F.ceil(F.col("n") * similarity - 1e-6)  # never too few by rounding
    looked = written(seen.withColumn("least", (F.size("some") - spare).cast("int")), "looked")
    held = looked.select("id", F.greatest("least", F.lit(0)).alias("least"), F.explode("some").alias("h"))
    held = held.withColumn("df", F.count("*").over(Window.partitionBy("h"))).where("df > 1 and least > 0")
    shared = held.groupBy("id").agg(F.count("*").alias("c"), F.min("least").alias("least")).where("c >= least")
    likely = written(shared.select("id").unionByName(looked.where("least <= 0").select("id")).distinct(), "likely")
    drop_written(looked)
    return likely


def _rare_keys(firsts: DataFrame, similarity: float) -> DataFrame:
    """(id, h, typical): each set's prefix of shingles in order of rarity, without those of one set.

    A set with fewer than ``similarity`` of its shingles in others has no key: nothing can be like it.
    ``typical`` is high where a set's shingles are in many others.
    """
    each = firsts.select("id", "n", F.explode("s").alias("h"))
    common = each.withColumn("df", F.count("*").over(Window.partitionBy("h"))).where("df > 1")
    of = Window.partitionBy("id")
    ranked = common.withColumns(
        {"m": F.count("*").over(of), "r": F.row_number().over(of.orderBy("df", "h")), "typical": F.sum(F.log("df")).over(of) / F.col("n")}
    )
    need = F.ceil(F.col("n") * similarity - 1e-6)  # never too many by rounding
    return ranked.where(F.col("r") <= F.col("m") - need + 1).select("id", "h", F.round("typical", 6).alias("typical"))


def _meeting(keys: DataFrame, by: str) -> DataFrame:
    """The rows whose key ``h`` has two values of ``by`` or more."""
    several = keys.groupBy("h").agg(F.min(by).alias("low"), F.max(by).alias("high")).where("low <> high").select("h")
    return keys.join(several.hint("merge"), "h")


def _possible(similarity: float) -> Column:
    """Whether two sets, by their sizes and parity bits, can reach the similarity.

    A shingle in both changes neither's parity against the other's, so each class of differing parity
    has a shingle that only one of them has.
    """
    both = F.col("n_x") + F.col("n_y")
    differ = F.lit(0)
    for i in range(PARITY_WORDS):
        differ = differ + F.bit_count(F.get("parity_x", F.lit(i)).bitwiseXOR(F.get("parity_y", F.lit(i))))
    sized = F.least("n_x", "n_y") >= F.greatest("n_x", "n_y") * similarity - 1e-6
    return sized & ((both - differ) / 2 >= both * similarity / (1 + similarity) - 1e-6)


def _print_pairs(firsts: DataFrame, max_distance: int) -> DataFrame:
    """(x, y), x < y: sets under one fingerprint, with the first of them, and first sets of linked fingerprints."""
    least = written(firsts.groupBy("fp").agg(F.min("id").alias("least")), "least")
    same = firsts.select("id", "fp").join(least.hint("merge"), "fp").where("id <> least").select(F.col("least").alias("x"), F.col("id").alias("y"))
    a, b = (least.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")) for c in ("a", "b"))
    met = spanning_links(least, "fp", max_distance).join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    return same.unionByName(met.select(F.least("least_a", "least_b").alias("x"), F.greatest("least_a", "least_b").alias("y")))


def _star_pairs(buckets: DataFrame, similarity: float) -> DataFrame:
    """(x, y), x < y: every member of a key with the most typical of its members."""
    member = F.struct(F.col("id").alias("c"), F.col("n").alias("n_y"), F.col("parity").alias("parity_y"))
    centres = buckets.groupBy("h").agg(F.max_by(member, F.struct("typical", "id")).alias("c")).select("h", "c.*")
    stars = buckets.withColumnsRenamed({"n": "n_x", "parity": "parity_x"})
    stars = stars.join(centres.hint("merge"), "h").where((F.col("id") != F.col("c")) & _possible(similarity))
    return stars.select(F.least("id", "c").alias("x"), F.greatest("id", "c").alias("y")).distinct()


def _pairs_between(buckets: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """(x, y), x < y: all pairs that meet in a key, are not in one group yet and can be alike.

    In each key, what is outside its largest group meets all of the key's members, so that the
    members of that group do not meet each other.
    """
    g = groups.withColumnRenamed("node", "member")
    rooted = buckets.join(g.hint("merge"), buckets["id"] == g["member"], "left").withColumn("root", F.coalesce("root", "id"))
    open_ = written(_meeting(rooted.select("h", "id", "n", "parity", "root"), "root"), "open")
    held = open_.groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(F.max_by("root", F.struct("c", "root")).alias("largest"))
    x, y = (open_.select("h", *[F.col(c).alias(f"{c}_{e}") for c in ("id", "n", "parity", "root")]) for e in ("x", "y"))
    outside = x.join(held.hint("merge"), "h").where("root_x <> largest")
    once = (F.col("root_y") == F.col("largest")) | (F.col("id_x") < F.col("id_y"))
    apart = (F.col("h") == F.col("h_y")) & (F.col("root_x") != F.col("root_y")) & once & _possible(similarity)
    pairs = outside.join(y.withColumnRenamed("h", "h_y").hint("merge"), apart)
    return pairs.select(F.least("id_x", "id_y").alias("x"), F.greatest("id_x", "id_y").alias("y")).distinct()


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets have the similarity, exactly."""
    of_x, of_y = (sets.select(F.col("id").alias(f"id_{c}"), F.col("s").alias(f"s_{c}")) for c in ("x", "y"))
    both = pairs.join(of_x.hint("merge"), pairs["x"] == of_x["id_x"]).join(of_y.hint("merge"), pairs["y"] == of_y["id_y"])
    shared = F.size(F.array_intersect("s_x", "s_y"))
    union = F.size("s_x") + F.size("s_y") - shared
    return both.where(shared >= F.lit(similarity) * union).select("x", "y").distinct()
