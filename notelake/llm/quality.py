"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is a linear score of features of its whole text. The weights are
learned from preference pairs (a document labelled 1 beats one labelled 0) by logistic loss
on the difference of the two feature vectors, so only the order within pairs counts. The
threshold is a quantile of the strengths of the labelled rows: the share of rows labelled
0. A logistic curve, its slope fitted on the same rows, maps strengths to (0, 1) so that
the threshold lands on ``cut``.

The fit uses every labelled row. Rows are numbered within their label and dealt to small
buckets that hold both labels in the same shares; a bucket's pairs are all of its rows labelled 1
with all labelled 0. A label with fewer rows than there are buckets has its rows in several.
Feature vectors are written once, a row per bucket; each Newton step adds up gradient and Hessian
where they lie, so that the driver gets one sum a task. Scoring is per row, without a shuffle.

Defined cases: a null text counts as empty, and an empty text has a score like any other;
labels that are null, or that contradict each other for one id, are not used; of documents
that repeat a labelled id the least text is learned from; without rows of both labels every
score is 0.5; copies score alike, and scores may tie; a column named as the output is
replaced, others pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.llm.common import drop_written, numbered, text_batches, whole_text, written

#: Rows of a bucket, about; buckets in one product of matrices; tasks, and so sums, of one step at most.
BUCKET, CHUNK, TASKS = 16, 128, 64
#: Labelled ids, two numbers each, that are broadcast to the texts; rows of strengths that are sorted at once.
BROADCAST_ROWS, SORTED_ROWS = 1_000_000, 10_000
#: Ridge for a thousand pairs, Newton steps at most, the change that ends them, and the score at the threshold.
RIDGE, STEPS, SETTLED, CUT = 3.0, 12, 1e-9, 0.3
#: Characters whose share among a text's words is a feature of its own.
MARKS = b"|!#*$%&<>"


def features(text: str) -> np.ndarray:
    """Byte frequencies, and shares that describe length, repetition, case and marks."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    seen = raw.split()
    k = max(1, len(seen))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = list(zip(seen, seen[1:], seen[2:]))
    packed = 0
    if raw:
        squeeze = zlib.compressobj(1)
        packed = len(squeeze.compress(raw)) + len(squeeze.flush())
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    style = [
        np.log1p(n),
        np.log1p(len(seen)),
        len(raw) / k,
        len(set(seen)) / k,
        len(set(triples)) / max(1, len(triples)),
        len(set(lines)) / max(1, len(lines)),
        len(lines) / k,
        packed / n,
        counts[65:91].sum() / n,
        counts[48:58].sum() / n,
        *(min(1.0, counts[m] / k) for m in MARKS),
    ]
    return np.concatenate([np.array(style), np.sqrt(counts / n)]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(slope * (weights . features - threshold) + logit(cut))))."""

    weights: np.ndarray
    threshold: float
    slope: float
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.slope:
            return np.full(len(x), 0.5)
        z = self.slope * (x.astype(np.float64) @ self.weights - self.threshold) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pairs(z: np.ndarray, y: np.ndarray, bucket: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient, Hessian and number of all pairs within buckets, as one array; rows are sorted by bucket, whole buckets only.

    A pair's Hessian is that of a difference, so those of a bucket are three products over its rows.
    """
    pull, weight, mixed, n = np.zeros(len(z)), np.zeros(len(z)), np.zeros_like(z), 0
    strength = z @ w
    ends = np.flatnonzero(np.diff(bucket)) + 1
    for start, end in zip([0, *ends], [*ends, len(z)]):
        high, low = start + np.flatnonzero(y[start:end] == 1), start + np.flatnonzero(y[start:end] == 0)
        p = _sigmoid(strength[high][:, None] - strength[low])
        curve = p * (1 - p)
        pull[high], pull[low] = (p - 1).sum(axis=1), (1 - p).sum(axis=0)
        weight[high], weight[low] = curve.sum(axis=1), curve.sum(axis=0)
        mixed[high] = curve @ z[low]
        n += p.size
    cross = z.T @ mixed
    hessian = z.T @ (z * weight[:, None]) - cross - cross.T
    return np.concatenate([pull @ z, hessian.ravel(), [n]])


def _dealt(rank: np.ndarray, y: np.ndarray, n_low: int, n_high: int) -> Iterator[tuple[int, int]]:
    """(row, bucket) of rows that are numbered within their label."""
    buckets = _buckets(n_low, n_high)
    for i, (r, label) in enumerate(zip(rank.tolist(), y.tolist())):
        own = n_high if label else n_low
        yield from ((i, b) for b in ([r % buckets] if own >= buckets else range(r, buckets, own)))


def _buckets(n_low: int, n_high: int) -> int:
    return max(1, (n_low + n_high) // BUCKET)


class _Arrays:
    """Labelled rows in memory, dealt to buckets."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rank = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0)) - 1
        dealt = sorted(_dealt(rank, y, int((y == 0).sum()), int((y == 1).sum())), key=lambda d: (d[1], y[d[0]], d[0]))
        at, bucket = (np.array(v, dtype=np.int64) for v in zip(*dealt))
        seen = np.zeros(len(y), dtype=bool)
        own = np.zeros(len(at), dtype=bool)
        for i, row in enumerate(at.tolist()):
            own[i], seen[row] = not seen[row], True
        self.parts = (x[at], y[at], bucket, own)
        self.x, self.y = x, y

    def total(self, f: Callable) -> np.ndarray:
        return f(*self.parts)

    def curve(self, w: np.ndarray, shift: float, at: int) -> tuple[float, float]:
        strength = self.x.astype(np.float64) @ w - shift
        threshold = float(np.sort(strength)[at])

        def sums(slope: float) -> tuple[float, float]:
            d = strength - threshold
            p = _sigmoid(slope * d)
            return float(d @ (p - self.y)), float((d * d) @ (p * (1 - p)))

        return threshold, _slope(sums)


def _slope(sums: Callable[[float], tuple[float, float]]) -> float:
    """Logistic regression on one number without a constant; ``sums``: gradient and curvature at a slope."""
    slope = 0.0
    for _ in range(STEPS):
        gradient, curvature = sums(slope)
        change = (gradient + 1e-3 * slope) / (curvature + 1e-3)
        slope -= change
        if abs(change) < SETTLED:
            break
    return slope


class _Table:
    """Labelled rows as a written table, a row per bucket: (bucket, ys, own, xs)."""

    def __init__(self, table: DataFrame, width: int):
        self.table, self.width = table.coalesce(TASKS), width

    def _run(self, f: Callable, each: Callable) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        width = self.width

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def chunks():
                for b in batches:
                    for start in range(0, len(b), CHUNK):
                        part = b.iloc[start : start + CHUNK]
                        x = np.frombuffer(b"".join(v for xs in part["xs"] for v in xs), dtype=np.float32).reshape(-1, width)
                        bucket = np.repeat(part["bucket"].to_numpy(), part["ys"].map(len).to_numpy())
                        yield f(x, np.concatenate(part["ys"].to_list()), bucket, np.concatenate(part["own"].to_list()).astype(bool))

            yield from each(chunks())

        return run

    def total(self, f: Callable) -> np.ndarray:
        def add(chunks: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
            whole = None
            for c in chunks:
                whole = c if whole is None else whole + c
            if whole is not None:
                yield pd.DataFrame({"sums": [whole.tobytes()]})

        # in the order of partitions, so that reruns add up alike
        rows = self.table.mapInPandas(self._run(f, add), "sums binary").collect()
        return np.sum([np.frombuffer(r["sums"], dtype=np.float64) for r in rows], axis=0)

    def curve(self, w: np.ndarray, shift: float, at: int) -> tuple[float, float]:
        def strengths(x, y, bucket, own):
            return pd.DataFrame({"y": y[own], "s": x[own].astype(np.float64) @ w - shift})

        held = written(self.table.mapInPandas(self._run(strengths, iter), "y int, s double"), "quality-strengths")
        threshold = _at(held, "s", at)
        d = F.col("s") - threshold

        def sums(slope: float) -> tuple[float, float]:
            p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), d * slope))))
            return held.agg(F.sum(d * (p - F.col("y"))), F.sum(d * d * p * (1 - p))).first()

        slope = _slope(sums)
        drop_written(held)
        return threshold, slope


def _at(rows: DataFrame, name: str, at: int) -> float:
    """The value at position ``at`` from 0 of ``name`` in ascending order, by ever narrower histograms."""
    low, high, n = rows.agg(F.min(name), F.max(name), F.count(name)).first()
    while n > SORTED_ROWS and low < high:
        place = F.least(F.floor((F.col(name) - low) / (high - low) * 1000), F.lit(999))
        for _, low, high, n in sorted(tuple(r) for r in rows.groupBy(place).agg(F.min(name), F.max(name), F.count("*")).collect()):
            if at < n:
                break
            at -= n
        rows = rows.where(F.col(name).between(low, high))
    return low if low == high else sorted(r[0] for r in rows.select(name).collect())[at]


def _train(held: _Arrays | _Table, width: int, n: int, share_low: float, cut: float) -> Model:
    """Newton steps on all pairs within buckets, over features of zero mean and unit scale."""
    mean = held.total(lambda x, y, bucket, own: x[own].astype(np.float64).sum(axis=0)) / n
    scale = np.sqrt(held.total(lambda x, y, bucket, own: ((x[own] - mean) ** 2).sum(axis=0)) / n)
    scale[scale < 1e-9] = np.inf  # a constant feature says nothing
    w = np.zeros(width)
    for _ in range(STEPS):
        sums = held.total(lambda x, y, bucket, own: _pairs((x - mean) / scale, y, bucket, w))
        gradient, hessian, ridge = sums[:width], sums[width:-1].reshape(width, width), RIDGE * sums[-1] / 1000
        change = np.linalg.solve(hessian + ridge * np.eye(width), gradient + ridge * w)
        w = w - change
        if np.abs(change).max() < SETTLED:
            break
    shift = float(mean @ (w / scale))
    at = min(max(int(np.ceil(share_low * n - 1e-9)) - 1, 0), n - 1)
    threshold, slope = held.curve(w / scale, shift, at)
    return Model(w / scale, threshold + shift, max(slope, 1e-6), cut)


def fit(x: np.ndarray, y: np.ndarray, cut: float = CUT, share_low: float | None = None) -> Model:
    """Learns from feature rows ``x`` with labels ``y``; share_low: where the threshold lies in the order of strengths, the share of label 0 if not given."""
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(x.shape[1]), 0.0, 0.0, cut)
    return _train(_Arrays(x, y), x.shape[1], len(y), float((y == 0).mean()) if share_low is None else share_low, cut)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: a fifth of the ids by CRC-32; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    cut: float = CUT,
) -> Model:
    """Fits on all labelled rows outside ``held_out``."""
    text_batches(docs.sparkSession)
    usable = (
        labels.where(labels[label_col].isin(0, 1) & labels[id_col].isNotNull() & ~held_out(labels[id_col]))
        .groupBy(labels[id_col].alias("__id"))
        .agg(F.min(label_col).cast("int").alias("__y"), F.max(label_col).cast("int").alias("__most"))
        .where("__y = __most")
        .join(docs.select(docs[id_col].alias("__id")), "__id", "left_semi")
        .select("__id", "__y")
    )
    ranged = written(usable.repartitionByRange("__y", "__id").withColumn("__part", F.spark_partition_id()), "quality-labels")
    counts = {r["__y"]: r["n"] for r in ranged.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    width = len(features(""))
    n_low, n_high = counts.get(0, 0), counts.get(1, 0)
    if not n_low or not n_high:
        return Model(np.zeros(width), 0.0, 0.0, cut)
    buckets = _buckets(n_low, n_high)
    ranks = numbered(ranged, ["__y"], [F.col("__part")], [F.col("__id")], "__rank").drop("__part")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "rank": b["rank"], "x": [features(t).tobytes() for t in b["text"]]})

    own = F.when(F.col("y") == 1, F.lit(n_high)).otherwise(F.lit(n_low)).cast("long")
    dealt = F.when(own >= buckets, F.array(F.col("rank") % buckets)).otherwise(F.sequence(F.col("rank"), F.lit(buckets - 1).cast("long"), own))
    each = (
        docs.select(docs[id_col].alias("id"), whole_text(docs, text_col).alias("text"))
        .join(F.broadcast(ranks) if n_low + n_high <= BROADCAST_ROWS else ranks.hint("merge"), F.col("id") == F.col("__id"))
        .groupBy("id", F.col("__y").alias("y"), F.col("__rank").alias("rank"))  # combined before the shuffle, so a repeated id is a text per task
        .agg(F.min("text").alias("text"))
        .mapInPandas(vectors, f"id {dict(docs.dtypes)[id_col]}, y int, rank long, x binary")
        .select("*", F.posexplode(dealt).alias("copy", "bucket"))
    )
    # a few rows of about a kilobyte each
    packed = each.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("y", "rank", (F.col("copy") == 0).cast("int").alias("own"), "x"))).alias("rows"))
    table = written(packed.select("bucket", F.col("rows.y").alias("ys"), F.col("rows.own").alias("own"), F.col("rows.x").alias("xs")).sortWithinPartitions("bucket"), "quality-vectors")
    model = _train(_Table(table, width), width, n_low + n_high, n_low / (n_low + n_high), cut)
    drop_written(table)
    drop_written(ranged)
    return model


def score(text: Column, model: Model) -> Column:
    """Score of each whole text under the model."""

    @F.pandas_udf(T.DoubleType())
    def quality_score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(model.scores(np.stack([features(t or "") for t in texts])))

    return quality_score(text)


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    text_batches(docs.sparkSession)
    return docs.withColumn(out, score(whole_text(docs, text_col), model))
