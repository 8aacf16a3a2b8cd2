"""Embeddings: signed token hashing, means of rows of a token table behind word pieces, and chains of models."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.sources.notes import shared_folder, text_batches

BUCKETS = 256


#: Tokens whose bucket a worker remembers.
REMEMBERED = 200_000
_TOKEN = re.compile("[a-z0-9]+")


class _Codes(dict):
    """Token -> 2 * bucket + sign bit: the bucket is the last byte of its MD5, the sign the low bit of the one before."""

    def __missing__(self, token: str) -> int:
        digest = hashlib.md5(token.encode(), usedforsecurity=False).digest()
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = code = 2 * digest[15] + (digest[14] & 1)
        return code


_CODES = _Codes()


def hash_vector(text: str | None) -> np.ndarray | None:
    """The text's tokens as signed counts in ``BUCKETS`` places, of unit length; none without tokens or where all cancel out."""
    return hash_tokens(_TOKEN.findall((text or "").lower()))


def hash_tokens(said: Sequence[str]) -> np.ndarray | None:
    codes = [_CODES[t] for t in said]
    counts = np.bincount(np.array(codes, dtype=np.int64), minlength=2 * BUCKETS)
    x = (counts[1::2] - counts[::2]).astype(np.float64)
    norm = np.sqrt((x * x).sum())
    return x / norm if norm > 0 else None


def hash_token_rows(said: Sequence[Sequence[str]]) -> np.ndarray:
    """``hash_tokens`` of many texts, a row each; zeros where there is none."""
    codes = np.array([_CODES[t] for ts in said for t in ts], dtype=np.int64)
    row = np.repeat(np.arange(len(said)), np.array([len(ts) for ts in said], dtype=np.int64))
    counts = np.bincount(row * (2 * BUCKETS) + codes, minlength=len(said) * 2 * BUCKETS).reshape(len(said), 2 * BUCKETS)
    x = (counts[:, 1::2] - counts[:, ::2]).astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def hash_vectors(docs: DataFrame, id_col: str, text_col: str, out: str = "embedding", cancelled: bool = False) -> DataFrame:
    """(id, embedding) with ``BUCKETS`` doubles, in one pass over the texts; texts without a vector are left out, those
    whose tokens all cancel out have zeros with ``cancelled``."""

    def vector(text: str | None) -> np.ndarray | None:
        made = hash_vector(text)
        return np.zeros(BUCKETS) if made is None and cancelled and _TOKEN.search((text or "").lower()) else made

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series([vector(t) for t in texts], dtype=object)

    text_batches(docs.sparkSession)
    # else the optimizer may run it once for each use of its result
    made = docs.select(id_col, vectors.asNondeterministic()(F.col(text_col)).alias(out))
    return made.where(F.col(out).isNotNull())


def hash_weights(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bucket, weight): the places of ``hash_vectors`` that are not zero."""
    spread = hash_vectors(docs, id_col, text_col, "v").select(id_col, F.posexplode("v").alias("bucket", "weight"))
    return spread.where("weight <> 0")


# -- several models

def signature(name: str, version: int = 1) -> str:
    """What tells vectors of one model and row shape from those of another."""
    return f"{name}|v{version}"


def embed_chain(docs: DataFrame, id_col: str, text_col: str, models: Sequence[tuple[str, Callable]]) -> DataFrame:
    """(id, embedding, signature) by the first model that gives every text a vector.

    ``models``: (signature, function of (docs, id column, text column) -> (id, embedding)), in order of preference.
    A model that fails or leaves out a text is passed over, so that one corpus never mixes models; the last may
    leave texts out. The signature is that of the model that was used.
    """
    if not models:
        raise ValueError("a chain needs a model")
    spark = docs.sparkSession
    wanted = docs.count()
    for i, (name, model) in enumerate(models):
        path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
        try:
            made = model(docs, id_col, text_col).withColumn("signature", F.lit(name))
            made.write.parquet(path)
        except (PySparkException, OSError, ValueError):
            if i == len(models) - 1:
                raise
            continue
        written = spark.read.schema(made.schema).parquet(path)
        if i == len(models) - 1 or written.where("size(embedding) > 0").count() == wanted:
            return written
    raise AssertionError("unreachable")


def stale(stored: DataFrame, current: str) -> bool:
    """Whether any stored vector was made under another signature; all have to be made again then."""
    return not stored.where(~F.col("signature").eqNullSafe(F.lit(current))).isEmpty()


# -- word pieces

def word_pieces(word: str, vocabulary: dict[str, int], unknown: int, prefix: str = "##", longest: int = 100) -> list[int]:
    """Ids of the word cut greedily into the longest known pieces; one ``unknown`` for the whole word if that fails."""
    if len(word) > longest:
        return [unknown]
    ids, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = word[at:end] if at == 0 else prefix + word[at:end]
            if piece in vocabulary:
                ids.append(vocabulary[piece])
                at = end
                break
        else:
            return [unknown]
    return ids


def piece_ids(words: DataFrame, vocabulary: dict[str, int], unknown: int, word_col: str = "word") -> DataFrame:
    """``words``, a distinct vocabulary of a corpus, with the ids of their pieces in ``ids``. The pieces of a model, a
    few ten thousand, go to each worker."""
    held = words.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("array<int>")
    def pieces(w: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else word_pieces(x, held.value, unknown) for x in w], dtype=object)

    return words.withColumn("ids", pieces(F.col(word_col)))


def mean_of_pieces(
    docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[str, int], unknown: int, rows: DataFrame, key_col: str, vector_col: str
) -> DataFrame:
    """(id, dim, x): the unit mean of the table rows that the pieces of an id's words name, each as often as it occurs; unknown keys count for nothing.

    A text's pieces are counted and summed where it lies: only the rows that the vocabulary names go to the workers, few ten
    thousand at most whatever the table's size, and one pair of arrays a text is shuffled.
    """
    spark = docs.sparkSession
    keys = spark.createDataFrame([(k,) for k in sorted({*vocabulary.values(), unknown})], "__key long")
    named = rows.join(F.broadcast(keys), F.col(key_col) == F.col("__key"), "left_semi").where(F.col(vector_col).isNotNull())
    held = named.select(F.col(key_col).alias("k"), F.col(vector_col).cast("array<double>").alias("v")).distinct().collect()
    width = max([1, *(len(r["v"]) for r in held)])
    place = {k: i for i, k in enumerate(sorted({r["k"] for r in held}))}
    sums, times = np.zeros((len(place), width)), np.zeros((len(place), width))
    for r in held:
        sums[place[r["k"]], : len(r["v"])] += [0.0 if x is None else x for x in r["v"]]
        times[place[r["k"]], : len(r["v"])] += 1
    sent = spark.sparkContext.broadcast((vocabulary, unknown, place, sums, times))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, missing, at, table, often = sent.value
        remembered: dict[str, list[int]] = {}
        for b in batches:
            ids, s, w = [], [], []
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                places: list[int] = []
                for word in _TOKEN.findall(text or ""):
                    own = remembered.get(word)
                    if own is None:
                        if len(remembered) >= REMEMBERED:
                            remembered.clear()
                        remembered[word] = own = [at[i] for i in word_pieces(word, known, missing) if i in at]
                    places += own
                if places:
                    n = np.bincount(places, minlength=len(at))
                    said = np.flatnonzero(n)
                    ids.append(id_)
                    s.append(n[said] @ table[said])
                    w.append(n[said] @ often[said])
            arrays = [pa.array(ids, b.schema.field(0).type), pa.array(s, pa.list_(pa.float64())), pa.array(w, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "s", "w"])

    text_batches(spark)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    each = texts.mapInArrow(count, f"id {dict(docs.dtypes)[id_col]}, s array<double>, w array<double>")
    added = each.groupBy("id").agg(*[F.array(*[F.sum(F.col(c)[d]) for d in range(width)]).alias(c) for c in ("s", "w")])
    means = added.select("id", F.zip_with("s", "w", lambda x, n: F.when(n > 0, x / n)).alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda t, x: t + F.coalesce(x * x, F.lit(0.0))))
    unit = means.withColumn("norm", norm).where("norm > 0").select(F.col("id").alias(id_col), "norm", F.posexplode("m").alias("dim", "v"))
    return unit.where("v IS NOT NULL").select(id_col, "dim", (F.col("v") / F.col("norm")).alias("x"))
