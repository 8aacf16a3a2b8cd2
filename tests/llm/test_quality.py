import zlib

import numpy as np
from pyspark.sql import functions as F

from notelake.llm import quality


def _corpus(filed, n=240):
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        body = " ".join(f"plain{(i * 7 + j) % 97}" for j in range(30 + i % 50))
        rows.append((i, body if good else body.upper().replace(" ", "!! ") + " ###"))
        labels.append((i, int(good)))
    return filed(rows, "doc_id long, text string"), labels


def test_learns_the_labels(spark, filed):
    docs, labels = _corpus(filed)
    model = quality.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    scored = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    assert all(0 <= s <= 1 for s in scored.values())
    right = sum((scored[i] >= model.cut) == bool(y) for i, y in labels)
    assert right / len(labels) > 0.97


def test_labels_that_cannot_be_used(spark, filed):
    docs, labels = _corpus(filed, 120)
    clean = quality.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    noise = [(None, 1), (3, None), (10_000, 1), (5, 0), (5, 1), (6, 7)]
    kept = [x for x in labels if x[0] != 5]
    again = quality.learn(docs, spark.createDataFrame(kept + noise + kept, "doc_id long, quality int"))
    without = quality.learn(docs, spark.createDataFrame(kept, "doc_id long, quality int"))
    assert np.allclose(again.weights, without.weights)
    assert clean.slope > 0


def test_repeated_ids_teach_once(spark, filed):
    docs, labels = _corpus(filed, 120)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    again = filed(rows + [(7, f"zz {i}") for i in range(300)] + [(7, rows[7][1])] * 50, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    a, b = quality.learn(docs, lab), quality.learn(again, lab)
    least = min(t for i, t in rows if i == 7)
    assert least < "zz" and np.array_equal(a.weights, b.weights)


def test_equals_the_model_row_by_row_on_small_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    teach = sorted((r.doc_id, r.quality) for r in labels.collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5)
    x = np.stack([quality.features(texts[i] or "") for i, _ in teach])
    y = np.array([q for _, q in teach])
    slow = quality.fit(x, y, share_low=float((y == 0).mean()))
    assert np.allclose(slow.weights, model.weights) and np.isclose(slow.threshold, model.threshold)
    got = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    want = model.scores(np.stack([quality.features(t or "") for t in texts.values()]))
    assert np.allclose([got[i] for i in texts], want)
    held = [(r.doc_id, r.quality) for r in labels.collect() if not zlib.crc32(str(r.doc_id).encode()) % 5]
    assert sum((got[i] >= model.cut) == bool(q) for i, q in held) / len(held) >= 0.93


def test_one_class_or_no_labels(spark, odd_docs):
    for rows in ([], [(1, 1), (2, 1)]):
        model = quality.learn(odd_docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        scored = quality.score_documents(odd_docs, model).collect()
        assert len(scored) == odd_docs.count() and {r.score for r in scored} == {0.5}
    assert quality.score_documents(odd_docs.where(F.lit(False)), model).count() == 0


def test_held_out_rows_do_not_teach(spark, filed):
    docs, labels = _corpus(filed, 120)
    flags = {r.doc_id: r.h for r in docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()}
    turned = [(i, 1 - y if flags[i] else y) for i, y in labels]
    a = quality.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    b = quality.learn(docs, spark.createDataFrame(turned, "doc_id long, quality int"))
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_ids_of_any_type(spark, filed):
    rows = [(f"d{i}", ("clear words here " if i % 2 else "x1 $$ ## ") * 20) for i in range(60)]
    docs = filed(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(40)], "doc_id string, quality int")
    scored = quality.score_documents(docs, quality.learn(docs, labels)).collect()
    by_label = [[r.score for r in scored if int(r.doc_id[1:]) % 2 == y] for y in (0, 1)]
    assert max(by_label[0]) < min(by_label[1])


def test_features_of_any_text():
    for text in ("", " ", "a", "é" * 10, "word " * 1000, "\ud800"):
        assert np.isfinite(quality.features(text)).all()


def test_every_labelled_row_teaches(spark, filed):
    # more rows a label than were once learned from: turning any one of them round moves the weights
    n = 7000
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["aa", "b1", "C", "dd!"], 4))) for i in range(n)]
    labels = [(i, i % 2) for i in range(n)]
    docs = filed(rows, "doc_id long, text string")
    flags = {r.doc_id: r.h for r in docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()}
    used = [(t, i % 2) for i, t in rows if not flags[i]]
    model = quality.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    x, y = np.stack([quality.features(t) for t, _ in used]), np.array([q for _, q in used])
    assert len(y) > 5000
    seen = []
    quality._Arrays(x, y).total(lambda a, b, bucket, own: seen.append((own.sum(), len(set(bucket.tolist())))))
    assert seen == [(len(y), len(y) // quality.BUCKET)]
    assert np.allclose(model.weights, quality.fit(x, y).weights)


def test_scarce_labels_are_in_every_bucket(spark, filed):
    docs, _ = _corpus(filed, 200)
    labels = [(i, int(i not in (4, 8, 20))) for i in range(200)]
    model = quality.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert np.isfinite(model.weights).all() and model.slope > 0


def test_a_value_by_its_place(spark, monkeypatch):
    monkeypatch.setattr(quality, "SORTED_ROWS", 3)
    values = [float(x) for x in [*range(50), *[7.0] * 20, 1e9, -1e-9]]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    for at in (0, 1, 8, 20, 40, len(values) - 1):
        assert quality._at(df, "s", at) == sorted(values)[at]
