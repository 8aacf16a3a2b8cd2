import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from notelake.llm import lm


def held(doc_id):
    import zlib

    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def spelled(text):
    """(context, byte) of each byte of the tokens, contexts as long as they get."""
    for word in [*(w + b" " for w in (text or "").encode().lower().split()), b"\n"]:
        padded = b" " + word
        for i in range(1, len(padded)):
            yield padded[max(0, i - lm.ORDER) : i], padded[i]


class Plain:
    """Prediction by partial matching with explicit sets of what is left out."""

    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for t in texts:
            for context, byte in spelled(t):
                for k in range(len(context) + 1):
                    self.seen[context[k:]][byte] += 1

    def share(self, context, byte):
        out, share = set(), 1.0
        for k in range(len(context) + 1):
            counts = {b: n for b, n in self.seen.get(context[k:], {}).items() if b not in out}
            if not counts:
                continue
            whole = 2 * sum(counts.values())
            if byte in counts:
                return share * (2 * counts[byte] - 1) / whole
            share *= len(counts) / whole
            out |= set(counts)
        return share / (256 - len(out))

    def score(self, text):
        return sum(math.log10(self.share(c, b)) for c, b in spelled(text))


def brute_force(rows):
    train = [t for i, t in rows if not held(i)]
    model = Plain(train)
    counts = Counter(w for t in train for w in [*(t or "").encode().lower().split(), "end"])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), "end"]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out.append((str(i), held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, base, model.score(t)))
    return sorted(out, key=str)


def check(docs):
    got = sorted(((str(r[0]), *r[1:]) for r in lm.score_documents(docs).collect()), key=str)
    want = brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-6) and g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-6)


def test_odd_rows(odd_docs):
    check(odd_docs)
    empty = lm.score_documents(odd_docs.where("doc_id > 1000"))
    assert empty.count() == 0
    assert empty.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_documents(spark):
    """The query's own numbers over the smallest table."""
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(100) if held(i)][:2]
    check(spark.createDataFrame([(ids[0], "ab Ab"), (ids[1], None)], "doc_id long, text string"))


def test_string_ids_and_pieces(spark, monkeypatch):
    rows = [(f"d{i}", f"Some words{i} \t here\nand there" * (i + 1)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    check(docs)
    monkeypatch.setattr(lm, "PIECE", 7)
    assert [w for some in lm.pieces(b" one two\nthree  four-and-more x ") for w in some] == b"one two three four-and-more x".split()


def test_shares_sum_to_one(spark):
    """After any context the model gives all bytes together a share of one."""
    texts = ["the then them", "that thin the a", "b"]
    model = Plain(texts)
    words = spark.createDataFrame([(bytearray(w.encode()), 1) for t in texts for w in t.split()], "word binary, c long")
    end = spark.createDataFrame([(bytearray(b" \n"), 3)], "ending binary, n long")
    pairs, nodes = lm.trie(lm.endings(words, "c").groupBy("ending").agg(F.sum("c").alias("n")).unionByName(end))
    for context in (b" ", b" th", b" the", b"xq"):
        asked = spark.createDataFrame([(bytearray(context + bytes([b])),) for b in range(256)], "ending binary")
        logs = {bytes(r.ending)[-1]: r.log for r in lm.gram_scores(asked, pairs, nodes).collect()}
        assert sum(10**x for x in logs.values()) == pytest.approx(1)
        for b in (ord("t"), ord("e"), ord(" "), 200):
            assert logs[b] == pytest.approx(math.log10(model.share(context, b)))


def test_held_out_texts_are_nearer_than_shuffled_letters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    turned = docs.where(lm.held_out(F.col("doc_id"))).select("doc_id", F.reverse("text").alias("text"))
    got = lm.score_documents(docs.unionByName(turned)).where("held_out").groupBy("doc_id").agg(F.max("score").alias("best"), F.min("score").alias("worst"))
    plain = lm.score_documents(docs).select("doc_id", "score")
    rows = got.join(plain, "doc_id").where("best > worst").collect()
    assert len(rows) > 5 and sum(abs(r.best - r.score) < 1e-6 for r in rows) >= 0.9 * len(rows)
