"""Hybrid retrieval under visibility, against the full fusion of both legs over what a principal sees."""

import random

import pytest
from pyspark.sql import functions as F

from notelake.functions.text import tokens
from notelake.operators import retrieval as V
from notelake.operators import search as R
from notelake.operators.embed import hash_tokens, hash_vectors
from notelake.operators.query import visible_to

MARKS = "id long, note long, text string, space string, private boolean, untrusted boolean, readers array<string>"
USERS = "user string, spaces array<string>, include_private boolean, trusted_only boolean"
WORDS = [f"{a}{b}" for a in "bdfgklm" for b in ("an", "or", "it", "us", "ed")]


def texts(rng, n):
    return [" ".join(rng.choice(WORDS[: rng.choice([4, 12, 35])]) for _ in range(rng.randint(0, 12))) or None for _ in range(n)]


def marked(spark, rng, n=90):
    rows = [(i, i // 3, t, rng.choice("ab"), rng.random() < 0.3, rng.random() < 0.3, rng.choice([[], [], ["u1"], ["u2", "u1"], ["u1", "u2"]])) for i, t in enumerate(texts(rng, n))]
    return spark.createDataFrame(rows, MARKS)


def users(spark):
    rows = [("u1", None, True, False), ("u2", ["a"], True, False), ("u3", ["a", "b", "a"], False, True), ("u4", [], True, False), ("u5", None, True, False), ("u6", None, False, True), ("u7", ["zz"], True, False)]
    return spark.createDataFrame(rows, USERS)


def full(rows, queries, k):
    """Every row on both legs, ranked whole."""
    asked = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    q = queries.join(hash_vectors(queries, "qid", "text"), "qid", "left")
    return R.fuse(R.bm25_texts(rows, asked), R.dense(hash_vectors(rows, "id", "text"), q), ["qid"]).where(F.col("rank") < k)


def keyed(found, *more):
    return sorted((*[r[c] for c in more], r.qid, r["rank"], r.id, round(r.lex, 6), round(r.cos, 6), round(r.score, 9)) for r in found.collect())


@pytest.mark.parametrize("k,pairs,scores", [(5, 4096, 2_000_000), (2, 3, 40), (1, 5, 1), (20, 4096, 500)])
def test_first_rows_equal_the_full_fusion(spark, monkeypatch, k, pairs, scores):
    rng = random.Random(8)
    d = spark.createDataFrame(list(enumerate(texts(rng, 90))), "id long, text string")
    q = spark.createDataFrame(list(enumerate(texts(rng, 12))), "qid long, text string")
    for name, value in (("PAIRS", pairs), ("BLOCK_SCORES", scores), ("HELD", 50)):
        monkeypatch.setattr(V, name, value)
    for module in (R, V):
        monkeypatch.setattr(module, "RRF_K", 2)  # so that few rows are candidates
    want = keyed(full(d, q, k))
    assert keyed(V.hybrid_search(d, q, k, embed=hash_tokens)) == want
    given = q.join(hash_vectors(q, "qid", "text"), "qid", "left")
    assert keyed(V.hybrid_search(d, given, k, vectors=hash_vectors(d, "id", "text"))) == want
    monkeypatch.setattr(V, "QUESTIONS", 5)
    assert keyed(V.hybrid_search(d, q, k, embed=hash_tokens)) == want


def test_string_ids(spark):
    d = spark.createDataFrame([(f"n{i % 7}/{i}", "ban kor" if i % 2 else "kor") for i in range(30)], "id string, text string")
    q = spark.createDataFrame([("q", "ban")], "qid string, text string")
    assert keyed(V.hybrid_search(d, q, 4, embed=hash_tokens)) == keyed(full(d, q, 4))


def test_each_principal_finds_what_a_search_over_its_own_rows_finds(spark):
    rng = random.Random(3)
    rows, people = marked(spark, rng), users(spark)
    q = spark.createDataFrame(list(enumerate(texts(rng, 6))), "qid long, text string")
    asks = people.select("user").crossJoin(q.select("qid")).unionByName(spark.createDataFrame([("nobody", 1)], "user string, qid long"))
    got = keyed(V.search_as(rows, q, asks, people, 3, embed=hash_tokens), "user")
    want = []
    for user in [r.user for r in people.collect()]:
        own = visible_to(rows, people.where(F.col("user") == user), readers="readers", untrusted="untrusted").select("id", "text")
        want += [(user, *r) for r in keyed(full(own, q, 3))]
    assert got == sorted(want) and {r[0] for r in got} == {"u1", "u2", "u3", "u5", "u6"}


def test_hidden_rows_move_no_score(spark):
    rng = random.Random(4)
    rows, people = marked(spark, rng, 40), users(spark)
    q = spark.createDataFrame(list(enumerate(texts(rng, 5))), "qid long, text string")
    asks = q.select(F.lit("u3").alias("user"), "qid")
    hidden = spark.createDataFrame([(1000 + i, 900, "ban bor bit ban", "a", True, False, []) for i in range(50)] + [(2000 + i, 901, "ban bor", "a", False, True, []) for i in range(50)] + [(3000 + i, 902, "bus", "b", False, False, ["u9"]) for i in range(50)], MARKS)
    before = keyed(V.search_as(rows, q, asks, people, 10, embed=hash_tokens), "user")
    assert before and keyed(V.search_as(rows.unionByName(hidden), q, asks, people, 10, embed=hash_tokens), "user") == before


def test_statistics_as(spark):
    rows, people = marked(spark, random.Random(5)), users(spark)
    # notes have one mark here
    rows = rows.withColumns({"space": F.when(F.col("note") % 2 == 0, "a").otherwise("b"), "private": F.col("note") % 3 == 0, "untrusted": F.lit(False), "readers": F.array().cast("array<string>")})
    seen = visible_to(rows, people, readers="readers", untrusted="untrusted")
    n = F.size(tokens(F.col("text")))
    want = seen.groupBy("user").agg(F.count("*"), F.count_distinct("note"), F.sum(F.length("text")), F.sum(n), F.avg(n))
    assert sorted(map(tuple, V.statistics_as(rows, people).collect())) == sorted(map(tuple, want.collect()))
    asked = people.select("user").crossJoin(spark.createDataFrame([("ban",), ("kor",), ("none",)], "term string"))
    said = seen.select("user", "id", F.explode(tokens(F.col("text"))).alias("term")).join(asked, ["user", "term"], "left_semi")
    df = said.groupBy("user", "term").agg(F.count_distinct("id"), F.count("*"))
    assert sorted(map(tuple, V.frequencies_as(rows, people, asked).collect())) == sorted(map(tuple, df.collect()))


def test_principals_with_one_view_share_it(spark):
    rows, people = marked(spark, random.Random(6)), users(spark)
    cells = V.cells_of(rows).select("cell", *V.CELL).dropDuplicates(["cell"])
    seen, _ = V.views_of(cells, people.withColumn("user", F.concat("user", F.lit("x"))))
    views = {r.user: r.view for r in seen.collect()}
    assert views["u1x"] == views["u5x"] != views["u3x"] and "u4x" not in views


def test_no_questions_no_rows(spark):
    d = spark.createDataFrame([(1, "ban")], "id long, text string")
    q = spark.createDataFrame([(1, "ban"), (2, ""), (3, None)], "qid long, text string")
    assert V.hybrid_search(d, q.where("qid > 5"), 5, embed=hash_tokens).count() == 0
    assert V.hybrid_search(d.where("id > 5"), q, 5, embed=hash_tokens).count() == 0
    assert {r.qid for r in V.hybrid_search(d, q, 5, embed=hash_tokens).collect()} <= {1}


def plain_passages(order, chunks, k):
    """``order``: (note, chunk_idx, score) of one question, best first; ``chunks``: {(note, idx): text}."""
    seen, primary, extra = set(), [], []
    for hit in order:
        (extra if hit[0] in seen else primary).append(hit)
        seen.add(hit[0])
    out, covered = [], set()
    for note, idx, score in primary[: 2 * k + 9] + extra[: 2 * k + 9]:
        if len(out) == k:
            break
        if (note, idx) in covered:
            continue
        parts = {idx}
        if len(out) < 3:
            for n, i, _ in order:
                if len(parts) < 3 and n == note:
                    parts.add(i)
            parts |= {idx - 1, idx + 1}
        parts = sorted(p for p in parts if (note, p) in chunks)
        covered |= {(note, p) for p in parts}
        text = ""
        for a, b in zip([None, *parts], parts):
            text += ("" if a is None else "\n" if b == a + 1 else "\n[…]\n") + chunks[note, b]
        out.append((len(out) + 1, note, idx, round(score, 9), text))
    return out


@pytest.mark.parametrize("k,notes", [(4, 9), (6, 2), (5, 1), (2, 30)])
def test_merged_passages_equal_a_plain_version(spark, k, notes):
    rng = random.Random(k)
    said = [t or "" for t in texts(rng, 60)]
    rows, at = [], {}
    for i, t in enumerate(said):
        note = f"n{rng.randrange(notes)}" if i % 5 else "n0"  # one long note
        at[note] = at.get(note, -1) + 1
        rows.append((i, note, at[note], t))
    chunks = spark.createDataFrame(rows, "id long, note string, chunk_idx int, text string")
    q = spark.createDataFrame(list(enumerate(texts(rng, 6))), "qid long, text string")
    order = {}
    place = {i: (note, idx) for i, note, idx, _ in rows}
    for r in full(chunks.select("id", "text"), q, 1000).orderBy("rank").collect():
        order.setdefault(r.qid, []).append((*place[r.id], r.score))
    want = {(qid, *x) for qid, hits in order.items() for x in plain_passages(hits, {(n, i): t for _, n, i, t in rows}, k)}
    got = {(r.qid, r.place, r.note, r.chunk_idx, round(r.score, 9), r.passage) for r in V.merged_passages(chunks, q, k, hash_tokens).collect()}
    assert got == want
