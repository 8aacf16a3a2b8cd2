"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry.

A component x becomes the integer floor(scale * x); all arithmetic after that is exact. Vectors
are cut into equal consecutive parts. Each part position has a codebook that starts as that part
of the vectors with the smallest ids and is refined by rounds of "assign every part to its
nearest entry, replace each entry by the componentwise floored mean of its parts".

The nearest entry is found through memoised grid cells. A part falls into a coarse cell, the box
of all points that agree with it but for their last ``shift`` bits. An entry whose smallest
distance to the box is above another entry's largest distance to it is nearest for no point of
the box; the entries that are left are remembered under the cell, and only those are evaluated
exactly. The cell's width never changes a result. It is chosen for each part on ``TRIAL_ROWS``
vectors drawn by hash, as the one with the fewest evaluations of bounds and distances.

Tasks send only sums per entry, combined before the shuffle; the driver holds the codebooks,
whose size is fixed by parts, entries and dimensions.

Defined cases: rows whose vector is null, empty, or holds null or non-finite components are
dropped, as are vectors whose length is no multiple of the number of parts or differs from that of
the usable vector with the smallest id; ids that are equal stand in the order of their vectors,
a null id stands last; repeated rows repeat in the result; with fewer vectors than entries the
codebook is smaller; an unused entry stays as it is; distances that tie go to the lower index;
integers beyond ``limit`` (for parts of 16 components 2**28) are moved to it, so that every
distance fits 64 bits; a sum of errors beyond 64 bits becomes the largest such number; an empty
table gives an empty result; other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.llm.common import drop_written, joined_hot, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Cells that a task remembers for a part at most; bounds worked out for so many cells, distances for so many parts at a time.
MAX_CELLS, CELL_BLOCK, PAIR_BLOCK = 1 << 14, 64, 1 << 16
#: Vectors on which the width of the cells is chosen, and the widths in bits that are tried.
TRIAL_ROWS, SHIFTS = 256, range(2, 30, 2)
#: Labels on more than one in so many rows meet their sum by broadcast; there are fewer than so many of them.
HOT_LABELS = 1_000


def limit(width: int) -> int:
    """The largest magnitude of an integer component, for parts of ``width`` components."""
    return 1 << ((61 - width.bit_length()) // 2)


class Cells:
    """Nearest entries of one codebook through memoised grid cells of ``1 << shift`` integers a side."""

    def __init__(self, entries: np.ndarray, shift: int):
        self.entries, self.shift, self.memo = entries, shift, {}
        self.bounded = self.evaluated = 0

    def _undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries, ascending, that may be nearest to a point of its box."""
        out = []
        for at in range(0, len(cells), CELL_BLOCK):
            low = cells[at : at + CELL_BLOCK] << self.shift
            high = low + (1 << self.shift) - 1
            near = np.zeros((len(low), len(self.entries)), dtype=np.int64)
            far = near.copy()
            for i in range(low.shape[1]):
                below, above = np.subtract.outer(low[:, i], self.entries[:, i]), np.subtract.outer(high[:, i], self.entries[:, i])
                gap = np.maximum(np.maximum(below, -above), 0)
                near += gap * gap
                reach = np.maximum(np.abs(below), np.abs(above))
                far += reach * reach
            kept = near <= far.min(axis=1, keepdims=True)
            out += [np.flatnonzero(k) for k in kept]
        self.bounded += len(cells) * len(self.entries)
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry."""
        cells = np.ascontiguousarray(parts >> self.shift)
        keys = cells.view(np.dtype((np.void, cells.dtype.itemsize * cells.shape[1]))).ravel()
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        names = [k.tobytes() for k in distinct]
        new = [i for i, k in enumerate(names) if k not in self.memo]
        if new:
            if len(self.memo) + len(new) > MAX_CELLS:
                self.memo.clear()
                new = list(range(len(names)))
            self.memo.update(zip((names[i] for i in new), self._undominated(cells[first[new]])))
        chosen = [self.memo[k] for k in names]
        index, error = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
        counts = np.array([len(c) for c in chosen], dtype=np.int64)[which]
        ends = np.cumsum(counts)
        at = 0
        while at < len(parts):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + PAIR_BLOCK, side="right")))
            many = counts[at:to]
            entry = np.concatenate([chosen[w] for w in which[at:to]])
            row = np.repeat(np.arange(to - at), many)
            differ = parts[at:to][row] - self.entries[entry]
            distance = np.einsum("ij,ij->i", differ, differ)
            best = np.minimum.reduceat(distance, np.concatenate([[0], np.cumsum(many)[:-1]]))
            ties = np.flatnonzero(distance == best[row])
            _, lowest = np.unique(row[ties], return_index=True)  # entries ascend within a row
            index[at:to], error[at:to] = entry[ties[lowest]], best
            self.evaluated += len(entry)
            at = to
        return index, error


def fitting_shift(entries: np.ndarray, parts: np.ndarray) -> int:
    """The width that costs least on some parts: two bounds an entry and new cell, a distance an entry left."""
    best, least = SHIFTS[0], None
    for shift in SHIFTS:
        cells = Cells(entries, shift)
        cells.nearest(parts)
        cost = 2 * cells.bounded + cells.evaluated
        if least is None or cost < least:
            best, least = shift, cost
    return best


@dataclass(frozen=True)
class Codebooks:
    """Integer entries by part, entry and position: shape (parts, entries, width); the cells' width by part."""

    entries: np.ndarray
    shifts: tuple[int, ...]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for x in self.entries.ravel().tolist()).encode()).hexdigest()


def integers(vector: Column, scale: int = SCALE) -> Column:
    """Each component as floor(scale * x); null unless all components are finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")), F.lit(False)) & ~F.isnan(x.cast("double")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int, scale: int) -> DataFrame:
    """(__id, __label, __v): the vectors that take part, as integers of one length."""
    rows = vectors.select(
        vectors[id_col].alias("__id"), vectors[label_col].alias("__label"), integers(vectors[vector_col], scale).alias("__v")
    ).where((F.size("__v") > 0) & (F.size("__v") % parts == 0))
    first = rows.orderBy(F.col("__id").asc_nulls_last(), "__v").select(F.size("__v").alias("n")).limit(1).collect()
    if not first:
        return rows.limit(0)
    edge = limit(first[0]["n"] // parts)
    within = F.transform("__v", lambda x: F.greatest(F.least(x, F.lit(edge)), F.lit(-edge)).cast("int"))
    return rows.where(F.size("__v") == first[0]["n"]).withColumn("__v", within)


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index("__v")).flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _assigner(books: Codebooks):
    """A function from whole vectors to (indexes, distances) by part, with cells kept for the task."""
    parts, _, width = books.entries.shape
    cells = [Cells(*part) for part in zip(books.entries, books.shifts)]

    def assign(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [cells[k].nearest(v[:, k * width : (k + 1) * width]) for k in range(parts)]
        return np.stack([i for i, _ in found], axis=1), np.stack([e for _, e in found], axis=1)

    return assign


def _means(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round."""
    old = books.entries
    parts, size, width = old.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _assigner(books)
        counts, sums = np.zeros((parts, size), dtype=np.int64), np.zeros((parts, size, width), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                v = _matrix(b, parts * width)
                index, _ = assign(v)
                for k in range(parts):
                    counts[k] += np.bincount(index[:, k], minlength=size)
                    np.add.at(sums[k], index[:, k], v[:, k * width : (k + 1) * width])
        k, e = np.nonzero(counts)
        columns = [pa.array(k.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[k, e])]
        yield pa.RecordBatch.from_arrays(
            columns + [pa.array(sums[k, e, i]) for i in range(width)], names=["part", "entry", "n", *[f"s{i}" for i in range(width)]]
        )

    schema = "part int, entry int, n long, " + ", ".join(f"s{i} long" for i in range(width))
    totals = rows.select("__v").mapInArrow(partial, schema).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]
    )
    new = old.copy()
    for r in totals.collect():  # a row per part and entry at most
        new[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return Codebooks(new, books.shifts)


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of the vectors in ``rows`` (from ``usable``); None without any."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits")
    first = [r["__v"] for r in rows.orderBy(F.col("__id").asc_nulls_last(), "__v").select("__v").limit(entries).collect()]
    if not first:
        return None
    trial = [r["__v"] for r in rows.orderBy(F.xxhash64("__id", "__v"), "__v").select("__v").limit(TRIAL_ROWS).collect()]

    def by_part(v: list) -> np.ndarray:
        return np.ascontiguousarray(np.array(v, dtype=np.int64).reshape(len(v), parts, -1).transpose(1, 0, 2))

    start = by_part(first)
    books = Codebooks(start, tuple(fitting_shift(e, p) for e, p in zip(start, by_part(trial))))
    for _ in range(rounds):
        books = _means(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` with code (two hex digits a part) and error (squared distances summed) in place of __v."""
    parts, _, width = books.entries.shape
    kept = [f for f in rows.schema.fields if f.name != "__v"]
    schema = T.StructType([*kept, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _assigner(books)
        for b in batches:
            if b.num_rows:
                index, error = assign(_matrix(b, parts * width))
                code = pa.array([bytes(r).hex() for r in index.astype(np.uint8)], pa.string())
                total = pa.array(error.sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(b.schema.get_field_index(f.name)) for f in kept], code, total], names=[f.name for f in schema.fields]
                )

    return rows.mapInArrow(coded, schema)


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code", out: str = "vector", scale: int = SCALE) -> DataFrame:
    """Adds ``out``: the vector that a code stands for, each integer x as (x + 0.5) / scale."""
    table = F.array(*[F.array(*[F.array(*[F.lit((x + 0.5) / scale) for x in e]) for e in part]) for part in books.entries.tolist()])
    digit = [F.conv(F.substring(code_col, 2 * k + 1, 2), 16, 10).cast("int") for k in range(len(books.entries))]
    return codes.withColumn(out, F.concat(*[table[k][digit[k]] for k in range(len(digit))]))


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks | None]:
    """(rows of ``id_col``, ``label_col``, code, error and label_error; the codebooks).

    label_error is error summed over the rows of equal labels, nulls together.
    """
    rows = written(usable(vectors, id_col, vector_col, label_col, parts, scale), "vectors")
    books = learn(rows, parts, entries, rounds)
    names = {"__id": id_col, "__label": label_col}
    if books is None:
        empty = rows.withColumns({"code": F.lit(None).cast("string"), "error": F.lit(None).cast("long"), "label_error": F.lit(None).cast("long")})
        return empty.drop("__v").withColumnsRenamed(names), None
    keyed = encode(rows, books).withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col("__label").cast("string")), F.lit("")))
    coded = written(keyed, "codes")
    drop_written(rows)
    sums = written(coded.groupBy("__key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("__sum"), F.count("*").alias("__n")), "label-errors")
    total = sums.agg(F.sum("__n")).first()[0] or 0
    most = F.lit((1 << 63) - 1)
    label_error = sums.select("__key", F.least(F.col("__sum"), most.cast("decimal(38,0)")).cast("long").alias("label_error"))
    hot = sums.where(F.col("__n") * HOT_LABELS > total)
    joined = joined_hot(coded, label_error, ["__key"], hot)
    return joined.select("__id", "__label", "code", "error", "label_error").withColumnsRenamed(names), books
