"""The index that follows edits against one built anew from the newest contents."""

import random

from pyspark.sql import functions as F

from notelake.functions.text import tokens
from notelake.operators import extract
from notelake.streaming import index

EDITS = "path string, content string, last long"


def rebuilt(spark, contents):
    notes = spark.createDataFrame([(p, c) for p, c in contents.items() if c is not None], "path string, body string")
    postings = notes.select("path", F.explode(tokens(F.col("body"))).alias("term")).groupBy("path", "term").agg(F.count("*").alias("tf"))
    return {
        "notes": {(r.path, r.body) for r in notes.collect()},
        "links": {(r.src, r.target, r.alias, r.pos) for r in extract.links(notes).collect()},
        "postings": {tuple(r) for r in postings.collect()},
        "frequencies": {tuple(r) for r in postings.groupBy("term").agg(F.count("*")).collect()},
    }


def held(spark, root):
    now = index.current(spark, root)
    return {
        "notes": {(r.path, r.content) for r in now["notes"].collect()},
        "links": {(r.path, r.target, r.alias, r.pos) for r in now["links"].collect()},
        "postings": {(r.path, r.term, r.tf) for r in now["postings"].collect()},
        "frequencies": {(r.term, r.df) for r in now["frequencies"].collect()},
    }


def test_every_batch_equals_a_rebuild(spark, tmp_path):
    rng, root, contents = random.Random(1), str(tmp_path / "index"), {}
    words = ["cat", "dog", "[[a]]", "[[b|bee]]", "sun", "sun"]
    for n in range(4):
        edits = [(f"p{rng.randrange(6)}", None if rng.random() < 0.2 else " ".join(rng.choices(words, k=4)), t) for t in range(5)]
        edits.append(edits[0][:2] + (9,))  # one path twice
        for p, c, _ in sorted(edits, key=lambda e: e[2]):
            contents[p] = c
        batch = spark.createDataFrame(edits, EDITS)
        index.merge(root, batch, n)
        assert held(spark, root) == rebuilt(spark, contents)
        index.merge(root, batch, n)  # run again after a failure
        assert held(spark, root) == rebuilt(spark, contents)
    index.merge(root, spark.createDataFrame([(p, c, 1) for p, c in contents.items()], EDITS), 4)
    assert spark.read.parquet(f"{root}/notes/batch=4").count() == 0  # nothing differs, nothing is read again
    index.compact(spark, root, str(tmp_path / "new"))
    assert held(spark, str(tmp_path / "new")) == rebuilt(spark, contents)
    index.merge(str(tmp_path / "new"), spark.createDataFrame([("p0", "dog", 1)], EDITS), 5)
    assert held(spark, str(tmp_path / "new")) == rebuilt(spark, contents | {"p0": "dog"})


def test_bursts_reach_the_index_once(spark, tmp_path):
    at = lambda m: F.timestamp_seconds(F.lit(1_700_000_000) + m * 60).cast("timestamp_ntz")
    rows = [("a", 0, 1, "one"), ("a", 2, 2, "two"), ("b", 3, 3, "bee"), ("a", 200, 4, "three [[b]]"), ("b", 400, 5, None), ("", 4000, 6, None)]
    edits = spark.createDataFrame(rows, "path string, m long, seq long, content string").withColumn("at", at(F.col("m"))).drop("m")
    seen = []
    index.follow(edits, str(tmp_path / "f"), "10 minutes", "1 minute", 3, lambda n: seen.append(n))
    assert held(spark, str(tmp_path / "f" / "index")) == rebuilt(spark, {"a": "three [[b]]"})
    written = spark.read.parquet(str(tmp_path / "f" / "index" / "notes"))
    assert "one" not in {r.content for r in written.collect()} and len(seen) >= 2
