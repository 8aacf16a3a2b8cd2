import hashlib
import random
import struct

import numpy as np
import pytest

from notelake.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def brute_force(rows):
    """The contract in plain Python over (vec_id, vector, label)."""
    kept = []
    for i, v, label in rows:
        if v and len(v) % 4 == 0 and all(x is not None and abs(x) < float("inf") for x in v):
            kept.append((i, tuple(int(np.floor(1024 * struct.unpack("f", struct.pack("f", x))[0])) for x in v), label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // 4
    cut = lambda v, k: v[k * width : (k + 1) * width]
    books = [[cut(v, k) for _, v, _ in kept[:256]] for k in range(4)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))

    for _ in range(4):
        for k in range(4):
            members = {}
            for _, v, _ in kept:
                members.setdefault(nearest(cut(v, k), books[k])[1], []).append(cut(v, k))
            for j, parts in members.items():
                books[k][j] = tuple(sum(x) // len(parts) for x in zip(*parts))
    out, errors = [], {}
    for i, v, label in kept:
        found = [nearest(cut(v, k), books[k]) for k in range(4)]
        error = sum(d for d, _ in found)
        errors[label] = errors.get(label, 0) + error
        out.append((i, "".join(f"{j:02x}" for _, j in found), error, label))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, c, e, errors[label]) for i, c, e, label in out), key=str), digest


def check(spark, rows):
    wide = [(i, v, label, "x", "y") for i, v, label in rows]
    coded, books = codes.compress(spark.createDataFrame(wide, SCHEMA))
    got = sorted((tuple(r) for r in coded.select("vec_id", "code", "error", "label_error").collect()), key=str)
    want, digest = brute_force(rows)
    assert got == want and books.digest() == digest


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)], rng.choice([1, 2, None])) for i in range(40)]
    rows += [rows[0], rows[1], (0, [0.5] * 8, 1), (None, [0.25] * 8, 9)]
    rows += [(50, None, 1), (51, [], 1), (52, [1.0] * 7, 1), (53, [1.0] * 4, 1), (54, [None] + [1.0] * 7, 2), (55, [float("nan")] * 8, 2), (56, [float("inf")] * 8, 2)]
    check(spark, rows)


def test_more_vectors_than_entries(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i * 3 % 701, [x + rng.choice([0.0, 0.0, 0.01, -0.02]) for x in centres[i % 5]], i % 3) for i in range(700)]
    check(spark, rows)


def test_nothing_usable(spark):
    coded, books = codes.compress(spark.createDataFrame([(1, None, 1, "x", "y")], SCHEMA))
    assert books is None and coded.count() == 0
    assert coded.columns == ["vec_id", "label", "code", "error", "label_error"]


def test_components_beyond_the_limit(spark):
    coded, books = codes.compress(spark.createDataFrame([(1, [3e38] * 4, 1, "", ""), (2, [-3e38] * 4, 1, "", ""), (3, [0.0] * 4, None, "", "")], SCHEMA), entries=1)
    assert abs(books.entries).max() <= codes.limit(1)
    assert all(r.error >= 0 and r.label_error >= r.error for r in coded.collect())


@pytest.mark.parametrize("shift", [1, 3, 5, 8, 20])
def test_cells_find_the_nearest(shift, monkeypatch):
    rng = np.random.default_rng(1)
    entries = rng.integers(-60, 60, (50, 3))
    entries[7] = entries[3]
    parts = np.concatenate([rng.integers(-90, 90, (400, 3)), entries])
    distance = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    monkeypatch.setattr(codes, "PAIR_BLOCK", 100)
    cells = codes.Cells(entries, shift)
    for _ in range(2):
        index, error = cells.nearest(parts)
        assert (index == distance.argmin(axis=1)).all() and (error == distance.min(axis=1)).all()
    if shift < 5:
        assert cells.evaluated < distance.size  # most entries are dominated in a small box
    bounded = cells.bounded
    cells.nearest(parts)
    assert cells.bounded == bounded  # all cells are remembered
    monkeypatch.setattr(codes, "MAX_CELLS", 10)
    assert (cells.nearest(parts)[0] == distance.argmin(axis=1)).all()


def test_decoding(spark):
    rows = [(i, [i / 10, -i / 10, 0.5, 1.0], 1, "", "") for i in range(20)]
    coded, books = codes.compress(spark.createDataFrame(rows, SCHEMA))
    for r in codes.decode(coded, books).collect():
        assert r.error == 0 and r.vector == pytest.approx(rows[r.vec_id][1], abs=1 / 1024)
