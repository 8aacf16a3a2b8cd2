"""Language-model scores: prediction by partial matching over the bytes of tokens.

A text is its tokens in order: words, each ended by a space, then one end mark. A byte of a word
is predicted from the up to ``order`` bytes before it, back to the space before the word; contexts
do not reach across words, so a word has one code length wherever it stands, and the model's work
grows with the words that differ, not with positions of the corpus.

The trie holds every context seen in training with the counts of the bytes after it. Where a
context has T counts over D distinct bytes, a byte seen there has share (2 * count - 1) / 2T and the
escape D / 2T. After an escape the next shorter context leaves out the bytes that the longer
one has seen: its T and D are less by theirs. When nothing is left there the escape is certain; below the
empty context all bytes never seen are equally likely. What is left out is always the set of the one longer
context, as sets of longer contexts lie within it, so each node needs three numbers: T, D, and E,
the counts that its bytes have in the next shorter context.

Counts, trie and scores are tables; nothing is held whole anywhere, and they grow with the
corpus. Texts are parsed once, into (row, words, counts). Words that make more than one in
``HOT_WORDS`` tokens meet their scores by broadcast, the others by a join. Logarithms are added as whole numbers of tiny parts, so sums
do not depend on their order.

Also given: the score of a plain unigram model, log10((c + ADD) / (N + ADD * (V + 1))) a token.

Defined cases: a null text counts as empty and has its end mark alone; a row with a null id is learned from;
without training rows the unigram model gives every token share 1, and bytes are all equally likely;
repeated rows count and repeat; very long texts are read in pieces; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.llm.common import drop_written, joined_hot, text_batches, whole_text, written

#: Bytes of context at most, and what is added to a count of the unigram model.
ORDER, ADD = 5, 0.1
#: One row in so many is held out.
HELD_OUT = 10
#: Words with more than one in so many tokens, and endings of words with more than one in so many, are joined by broadcast.
HOT_WORDS, HOT_ENDINGS = 400_000, 400_000
#: Bytes of a text read at a time.
PIECE = 1 << 20
#: A logarithm is kept as so many COARSE-ths and a rest in FINE-ths, both whole numbers.
COARSE, FINE = 1 << 20, 1 << 52

_END = b"\n"
_WHITE = b" \t\n\x0b\x0c\r"


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: a tenth of the ids by CRC-32; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in _WHITE:
            end += 1
        yield text[at:end].split()  # bytes split at ASCII white space alone
        at = end


def parsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, held_out, words, counts, first): one row or, for a long text, several; ``first`` marks one of them."""
    text_batches(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs[id_col].alias("id"),
        held_out(docs[id_col]).alias("held_out"),
        whole_text(docs, text_col).cast("binary").alias("text"),
    )
    kept = rows.schema.fields[:3]
    schema = T.StructType(
        [*kept, T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("first", T.BooleanType())]
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, words, counts, first = [], [], [], []
            for i, text in enumerate(b.column(3)):
                starts = True
                for some in pieces(text.as_py().lower()):  # A-Z alone
                    found = Counter(some)
                    at.append(i)
                    words.append(list(found.keys()))
                    counts.append(list(found.values()))
                    first.append(starts)
                    starts = False
                if starts:
                    at.append(i)
                    words.append([])
                    counts.append([])
                    first.append(True)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(k).take(take) for k in range(3)], pa.array(words, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64())), pa.array(first, pa.bool_())],
                names=[f.name for f in schema.fields],
            )

    return rows.mapInArrow(split, schema)


def exploded(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns``, word, n: a row per word of each row of ``parsed``."""
    pair = F.explode(F.arrays_zip("words", "counts")).alias("pair")
    return rows.select(*columns, pair).select(*columns, F.col("pair.words").alias("word"), F.col("pair.counts").alias("n"))


def endings(words: DataFrame, *columns: str, order: int = ORDER) -> DataFrame:
    """``columns``, ending: for each byte of each word and its final space, up to ``order`` bytes before it and itself."""
    padded = F.concat(F.lit(b" "), F.col("word"), F.lit(b" "))
    each = F.transform(
        F.sequence(F.lit(2), F.octet_length(padded)),
        lambda i: F.substring(padded, F.greatest(i - order, F.lit(1)), F.least(i, F.lit(order + 1))),
    )
    return words.select(*columns, F.explode(each).alias("ending"))


def _suffixes(gram: Column) -> Column:
    """The gram and all shorter ends of it, down to one byte."""
    return F.transform(F.sequence(F.lit(1), F.octet_length(gram)), lambda i: F.substring(gram, i, F.octet_length(gram) - i + 1))


def _context(gram: Column) -> Column:
    return F.substring(gram, F.lit(1), F.octet_length(gram) - 1)


def trie(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (ending, n): pairs (gram, c), a context and the byte after it; nodes (context, t, d, e)."""
    pairs = written(
        grams.select(F.explode(_suffixes(F.col("ending"))).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("c")), "trie"
    )
    shorter = pairs.select(F.col("gram").alias("short"), F.col("c").alias("below"))
    longer = pairs.withColumn("short", F.when(F.octet_length("gram") > 1, F.substring("gram", F.lit(2), F.octet_length("gram") - 1)))
    nodes = (
        longer.join(shorter, "short", "left")
        .groupBy(_context(F.col("gram")).alias("context"))
        .agg(F.sum("c").alias("t"), F.count("*").alias("d"), F.coalesce(F.sum("below"), F.lit(0)).alias("e"))
    )
    return pairs, written(nodes, "nodes")


def _found_share(levels: Column) -> Column:
    """log10 of the share of a byte, from its levels (length, c, t, d, e), longest context first.

    A level whose context was never seen has a null t. An accumulator walks down: log10 so far, what the
    longer context leaves out (its d and e), and whether the byte was found.
    """
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0).cast("long").alias("out_d"), F.lit(0).cast("long").alias("out_e"), F.lit(False).alias("found"))

    def step(s: Column, x: Column) -> Column:
        d, whole = x["d"] - s["out_d"], 2 * (x["t"] - s["out_e"])
        log = (
            F.when(x["c"].isNotNull(), F.log10((2 * x["c"] - 1) / whole))
            .when(d > 0, F.log10(d / whole))
            .otherwise(F.lit(0.0))
        )
        after = F.struct((s["log"] + log).alias("log"), x["d"].alias("out_d"), x["e"].alias("out_e"), x["c"].isNotNull().alias("found"))
        return F.when(s["found"] | x["t"].isNull(), s).otherwise(after)

    def end(s: Column) -> Column:
        return F.when(s["found"], s["log"]).otherwise(s["log"] - F.log10(F.lit(256.0) - s["out_d"]))

    return F.aggregate(levels, start, step, end)


def gram_scores(grams: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ending, log): log10 of the share of each ending's last byte after the bytes before it."""
    levels = grams.select("ending", F.explode(_suffixes(F.col("ending"))).alias("gram"))
    # once per distinct gram: a context has 256 of them at most, so no key is hot here
    known = levels.groupBy("gram").agg(F.count("*").alias("asked")).join(pairs.hint("merge"), "gram", "left")
    known = known.withColumn("context", _context(F.col("gram"))).join(nodes.hint("merge"), "context", "left")
    known = written(known.select("gram", "asked", "c", "t", "d", "e"), "grams")
    total = known.agg(F.coalesce(F.sum("asked"), F.lit(0))).first()[0]
    hot = known.where(F.col("asked") * HOT_ENDINGS > total)
    level = F.struct((-F.octet_length("gram")).alias("length"), "c", "t", "d", "e")  # longest first, order + 1 of them at most
    met = joined_hot(levels, known.drop("asked"), ["gram"], hot)
    logs = written(met.groupBy("ending").agg(_found_share(F.sort_array(F.collect_list(level))).alias("log")), "ending-scores")
    drop_written(known)
    return logs


def _whole(log: Column, name: str) -> dict[str, Column]:
    """A logarithm as two whole numbers."""
    coarse = F.floor(log * F.lit(float(COARSE)))
    rest = F.round((log - coarse / F.lit(float(COARSE))) * F.lit(float(FINE)))
    return {f"{name}_coarse": coarse.cast("long"), f"{name}_fine": rest.cast("long")}


def _summed(name: str, times: Column) -> list[Column]:
    return [F.sum(times * F.col(f"{name}_{part}")).alias(f"{name}_{part}") for part in ("coarse", "fine")]


def _as_log(name: str) -> Column:
    none = F.lit(0).cast("long")
    return F.coalesce(f"{name}_coarse", none) / COARSE + F.coalesce(f"{name}_fine", none) / FINE


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score, a row per row of ``docs``."""
    texts = written(parsed(docs, id_col, text_col), "parsed")
    learned = F.when(F.col("held_out"), F.lit(0)).otherwise(F.col("n"))
    words = exploded(texts, "held_out").groupBy("word").agg(F.sum(learned).alias("c"), F.sum("n").alias("n"))
    words = written(words.withColumn("number", F.monotonically_increasing_id()), "words")
    of_words = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count_if(F.col("c") > 0).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    ends = texts.where("first and not held_out").count()
    tokens, distinct = of_words["c"] + ends, of_words["v"] + int(ends > 0)

    end = docs.sparkSession.createDataFrame([(b" " + _END, ends)], "ending binary, n long")
    seen = endings(words.where("c > 0"), "c", order=order).groupBy("ending").agg(F.sum("c").alias("n"))
    pairs, nodes = trie(seen.unionByName(end.where("n > 0")))
    # endings of all words, the number of words each is in, and the end mark
    asked = endings(words, order=order).groupBy("ending").agg(F.count("*").alias("n"))
    asked = written(asked.unionByName(end.withColumn("n", F.lit(1).cast("long"))), "endings")
    logs = gram_scores(asked.select("ending"), pairs, nodes)
    of_end = logs.where(F.col("ending") == F.lit(b" " + _END)).first()["log"]
    places = asked.agg(F.sum("n")).first()[0]
    hot_endings = asked.where(F.col("n") * HOT_ENDINGS > places)
    spelled = joined_hot(endings(words, "number", order=order), logs, ["ending"], hot_endings).withColumns(_whole(F.col("log"), "log"))
    spelled = spelled.groupBy("number").agg(*_summed("log", F.lit(1)))

    def unigram(c: Column) -> Column:
        return F.log10((c + F.lit(ADD)) / F.lit(tokens + ADD * (distinct + 1)))

    scored = words.join(spelled.hint("merge"), "number").select("word", "c", F.col("n").alias("all"), "log_coarse", "log_fine")
    scored = written(scored.withColumns(_whole(unigram(F.col("c")), "base")), "word-scores")
    hot_words = scored.where(F.col("all") * HOT_WORDS > of_words["n"])
    met = joined_hot(exploded(texts, "row"), scored.drop("all"), ["word"], hot_words)
    sums = met.groupBy("row").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
        *_summed("base", F.col("n")),
        *_summed("log", F.col("n")),
    )
    none = F.lit(0).cast("long")
    every = texts.where("first").select("row", "id", "held_out").join(sums.hint("merge"), "row", "left")
    result = every.select(
        F.col("id").alias(id_col),
        "held_out",
        (F.coalesce("n", none) + 1).alias("n_tokens"),
        (F.coalesce("known", none) + int(ends > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (_as_log("base") + unigram(F.lit(ends))).alias("base_score"),
        (_as_log("log") + F.lit(of_end)).alias("score"),
    )
    result = written(result, "lm-scores")
    for done in (texts, words, pairs, nodes, asked, logs, scored):
        drop_written(done)
    return result
