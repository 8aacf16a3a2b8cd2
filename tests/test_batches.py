import random

import numpy as np
from pyspark.sql import functions as F

from notelake.operators import retrieval, search
from notelake.operators.embed import hash_tokens, hash_vectors

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _texts(spark, n=3000):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(n)]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    return docs, spark.createDataFrame([(q, " ".join(rng.choices(words, k=3))) for q in range(5)], "qid long, text string")


def test_workers_hold_few_texts_whatever_a_task_reads(spark):
    docs, asked = _texts(spark, 20)
    terms = asked.select("qid", F.explode(F.split("text", " ")).alias("term"))
    for run in (
        lambda: retrieval.hybrid_search(docs, asked, 3, embed=hash_tokens),
        lambda: search.lexical(docs, terms, 3),
        lambda: hash_vectors(docs, "id", "text"),
    ):
        spark.conf.set(KEY, "10000")
        run()
        assert int(spark.conf.get(KEY)) <= 1000


def test_rows_below_what_is_held_change_nothing(spark, monkeypatch):
    docs, asked = _texts(spark)
    monkeypatch.setattr(retrieval, "HELD", 1)
    monkeypatch.setattr(retrieval, "RRF_K", 2)
    by = ["qid", "rank", "id", "score"]
    spark.conf.set(KEY, "100")
    small = retrieval.hybrid_search(docs, asked, 3, embed=hash_tokens).select(*by).orderBy(*by).collect()
    monkeypatch.setattr(retrieval, "HELD", 1 << 40)
    assert small and small == retrieval.hybrid_search(docs, asked, 3, embed=hash_tokens).select(*by).orderBy(*by).collect()
    spark.conf.set(KEY, "1000")


def test_ends_of_earlier_batches_hold_back_later_rows():
    qids, ends = np.array([1]), np.zeros((1, 1))
    first = search._hits(qids, np.arange(3), np.array([[3.0, 2.0, 1.0]]), 2, 0.0, "lex", ends)
    later = search._hits(qids, np.arange(3, 6), np.array([[1.5, 2.0, 4.0]]), 2, 0.0, "lex", ends)
    assert first["id"].tolist() == [0, 1] and later["id"].tolist() == [4, 5]  # what ties with the last stays


def test_tasks_keep_no_more_rows_than_the_first_can_come_from(spark, monkeypatch):
    docs, asked = _texts(spark, 600)
    monkeypatch.setattr(retrieval, "RRF_K", 6)
    by, seen, candidates = ["qid", "rank", "id", "score"], [], retrieval._candidates

    def counted(table, views, questions, pairs, reach, least):
        seen.append(reach)
        return candidates(table, views, questions, pairs, reach, least)

    monkeypatch.setattr(retrieval, "_candidates", counted)
    few = retrieval.hybrid_search(docs, asked, 4, embed=hash_tokens).select(*by).orderBy(*by).collect()
    many = retrieval.hybrid_search(docs, asked, 300, embed=hash_tokens).where("rank < 4").select(*by).orderBy(*by).collect()
    assert len(few) == 20 and few == many and seen == [14, 606]
