import itertools
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from notelake.functions.statements import statement
from notelake.functions.stem import stem_terms
from notelake.functions.text import tokens
from notelake.operators import evaluate as E
from notelake.operators import extract as X
from notelake.operators import memory as M
from notelake.operators import search as R
from notelake.sources import notes as N
from notelake.operators.embed import embed_chain, hash_token_rows, hash_vector, hash_vectors, mean_of_pieces, piece_ids, signature, stale, word_pieces


def _bm25(spark, docs, queries):
    d = spark.createDataFrame(docs, "id long, text string")
    q = spark.createDataFrame(queries, "qid long, text string").select("qid", F.explode(tokens(F.col("text"))).alias("term"))
    out = R.bm25(R.terms(d, ["id"], "text"), d.select("id", F.size(tokens(F.col("text"))).alias("n_tokens")), q)
    return {(r.qid, r.id): r.lex for r in out.collect()}


def test_bm25(spark):
    docs = [(1, "cat sat"), (2, "cat cat mat ran"), (3, "dog")]
    got = _bm25(spark, docs, [(1, "Cat cat"), (2, "absent")])
    avg = 7 / 3
    want = lambda tf, n: round(math.log(3 / 2) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg)), 6)
    assert got == {(1, 1): want(1, 2), (1, 2): want(2, 4)}


def test_a_term_in_every_row_scores_nothing(spark):
    assert _bm25(spark, [(1, "a b"), (2, "a c")], [(1, "a")]) == {}


def test_dense_guards(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, 1.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(7, [2.0, 0.0])], "qid long, embedding array<double>")
    assert {r.id: r.cos for r in R.dense(rows, q).collect()} == {1: 1.0, 5: 0.707107}


def test_fusion_ranks_from_zero_with_ties_in_corpus_order(spark):
    lex = spark.createDataFrame([(1, 2, 1.0), (1, 1, 1.0)], "qid long, id long, lex double")
    cos = spark.createDataFrame([(1, 3, 0.5)], "qid long, id long, cos double")
    got = [(r.id, round(r.score, 9)) for r in R.fuse(lex, cos, ["qid"]).orderBy("rank").collect()]
    # the cosine leg ranks 3 first, then 1 and 2 in corpus order; the lexical leg 1, 2, then 3
    assert got == [(1, round(1 / 60 + 1 / 61, 9)), (3, round(1 / 62 + 1 / 60, 9)), (2, round(1 / 61 + 1 / 62, 9))]


def test_hidden_rows_move_no_score(spark):
    docs = [(1, "cat sat"), (2, "dog"), (3, "cat ran far")]
    seen = _bm25(spark, docs, [(1, "cat")])
    assert seen == _bm25(spark, [d for d in [*docs, (9, "cat cat")] if d[0] != 9], [(1, "cat")])


def test_fence_breaks_inner_markers(spark):
    r = spark.range(1).select(R.fence(F.lit("a untrusted>>> b"), F.lit(True)).alias("t")).first()
    assert r.t.count(R.FENCE_CLOSE) == 1


@pytest.mark.parametrize(
    "text,held,want",
    [
        ("Ana prefers tea", [], ("ADD", -1)), ("Ana prefers tea", ["Ana prefers Tea!"], ("NOOP", 0)), ("Ana prefers coffee", ["x y z", "Ana prefers tea"], ("UPDATE", 1)),
        ("the Ana prefers a tea", ["Ana prefers tea"], ("NOOP", 0)), ("Ana no longer uses vim", ["Ana uses vim"], ("DELETE", 0)),
        ("We never again deploy on late Friday evenings", ["We deploy on late Friday evenings"], ("DELETE", 0)), ("quarterly report sent", ["report quarterly sent"], ("NOOP", 0)),
        ("the deploy pipeline takes 20 minutes end to end", ["the nightly backup takes 11 minutes end to end"], ("ADD", -1)),
        ("my best 5K race time came down to 25:50", ["my best 5K race time came down to 27:12"], ("UPDATE", 0)),
        ("Zoé préfère le thé vert", ["Zoé préfère le thé vert!"], ("NOOP", 0)),
    ],
)
def test_decisions(text, held, want):
    got = M.decide(text, 1, [{"id": str(i), "text": t, "authority": 1, "immutable": False} for i, t in enumerate(held)])
    assert got == (*want, False)


def test_authority_and_immutability():
    held = lambda rank, fixed: [{"id": "a", "text": "Ana prefers tea", "authority": rank, "immutable": fixed}]
    assert M.decide("Ana prefers milk", 0, held(1, False)) == ("ADD", 0, True)
    assert M.decide("Ana prefers milk", 1, held(1, True)) == ("ADD", -1, False)
    assert M.decide("Ana prefers tea", 0, held(2, True)) == ("NOOP", 0, False)
    assert M.decide("Ana prefers milk", 2, held(2, False)) == ("UPDATE", 0, False)
    assert M.decide("Ana doesn't prefers tea", 0, held(2, False)) == ("ADD", 0, True)


WORDS = ["Ana", "the user", "a", "prefers", "uses", "is", "was called", "is called", "no longer", "tea", "green tea", "$20", "20%", "twice", "7 days", "1997", "5:07", "budget", "hosting", "yearly", "team", "was", "island", "Zoé", "isn't", "takes", "minutes"]


def _said(rng, n):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 7))) for _ in range(n)]


def test_pair_decisions_equal_the_folds_step(spark):
    rng = random.Random(4)
    pairs = [(i, a, b, rng.randint(0, 2), rng.randint(0, 2), rng.random() < 0.2) for i, (a, b) in enumerate(zip(_said(rng, 1500), _said(rng, 1500)))]
    pairs += [(len(pairs) + i, a, a.replace("tea", "milk"), 1, 1, False) for i, a in enumerate(_said(rng, 300))]
    df = spark.createDataFrame(pairs, "i int, new string, old string, new_authority int, old_authority int, old_immutable boolean")
    got = {r.i: (r.op, r.challenge) for r in M.decide_pairs(df).collect()}
    for i, new, old, na, oa, fixed in pairs:
        op, _, challenged = M.decide(new, na, [{"id": "x", "text": old, "authority": oa, "immutable": fixed}])
        assert got[i] == (op, challenged), (new, old, na, oa, fixed)
    assert {op for op, _ in got.values()} == {"ADD", "NOOP", "UPDATE", "DELETE"}


def slow_fold(facts):
    """Every live fact is ranked for every new one; the twelve best are decided on in order."""
    live, log = [], []
    for f in facts:
        new = statement(f["text"])

        def order(old):
            said = statement(old["text"])
            same = bool(new.attribute and said.attribute and new.attribute[:2] == said.attribute[:2])
            return (not same, -new.similarity(said), -live.index(old))

        open_ = [o for o in live if (o["expires"] is None or o["expires"] > f["stamp"])]
        near = sorted(open_, key=order)[:12]
        op, at, challenged = M.decide(f["text"], f["authority"], near)
        target = near[at]["id"] if at >= 0 else None
        if op in ("UPDATE", "DELETE"):
            live = [o for o in live if o["id"] != target]
        if op in ("ADD", "UPDATE"):
            live.append(f)
        log.append((f["id"], op, None if challenged else target, target if challenged else None))
    return log


def _facts(rng, n):
    return [
        {"id": f"i{i:04}", "stamp": f"2024-{i // 28 % 12 + 1:02}-{i % 28 + 1:02} 00:00:00", "text": t, "authority": rng.randint(0, 2), "immutable": rng.random() < 0.1,
         "expires": f"2024-{(i // 28 + 2) % 12 + 1:02}-01 00:00:00" if rng.random() < 0.2 else None}
        for i, t in enumerate(_said(rng, n))
    ]


def test_fold_takes_the_best_matches_of_many_live_facts():
    facts = [{"id": f"i{i}", "stamp": f"{i:03}", "text": f"Person{i} prefers tea", "authority": 1, "immutable": False, "expires": None} for i in range(40)]
    facts.append(facts[0] | {"id": "last", "stamp": "900", "text": "Person0 prefers coffee"})
    log, live = M.fold(facts)
    assert log[-1] == ("last", "UPDATE", "i0", None) and len(live.facts) == 40
    for seed in range(4):
        rows = sorted(_facts(random.Random(seed), 250), key=lambda f: (f["stamp"], f["id"]))
        assert M.fold(rows)[0] == slow_fold(rows)


def test_reconcile_with_authority_by_scope(spark):
    rows = [(f"s{i % 3}", f) for i, f in enumerate(_facts(random.Random(9), 200))]
    df = spark.createDataFrame([(s, *[f[k] for k in M.FOLDED]) for s, f in rows], "scope string, id string, stamp string, text string, authority int, immutable boolean, expires string")
    got = {(r.scope, r.id): (r.op, r.target, r.challenges) for r in M.reconcile(df, "scope").collect()}
    for scope in ("s0", "s1", "s2"):
        own = sorted((f for s, f in rows if s == scope), key=lambda f: (f["stamp"], f["id"]))
        assert {(scope, i): (o, t, c) for i, o, t, c in slow_fold(own)} == {k: v for k, v in got.items() if k[0] == scope}


def test_late_and_empty_facts():
    f = {"authority": 1, "immutable": False, "expires": None}
    log, live = M.fold([f | {"id": "b", "stamp": "2", "text": "Ana prefers tea"}, f | {"id": "a", "stamp": "1", "text": "Ana prefers milk"}, f | {"id": "c", "stamp": "3", "text": " "}])
    assert log == [("b", "ADD", None, None), ("a", "LATE", "b", None), ("c", "NOOP", None, None)] and set(live.facts) == {"b"}


def test_fold_reads_few_of_many_live_facts(monkeypatch):
    """all facts of a topic share words; a new one was held against every one of them."""
    read = []
    alike = M.LiveFacts._alike
    monkeypatch.setattr(M.LiveFacts, "_alike", lambda self, words: (read.append(i) or i for i in alike(self, words)))
    kinds = ("tea", "milk", "coffee")
    facts = [{"id": f"i{i:05}", "stamp": f"{i:05}", "text": f"Customer {i % 1500} prefers {kinds[i // 7 % 3]}", "authority": i % 3, "immutable": i % 11 == 0, "expires": None} for i in range(3000)]
    log, live = M.fold(facts)
    assert len(log) == 3000 and len(live.facts) > 900 and 0 < len(read) <= 12 * 3000
    assert M.fold(facts[:400])[0] == slow_fold(facts[:400])


def test_scopes_are_folded_in_one_pass(spark):
    """scopes go over batches in order of stamp and id, a null scope and a null stamp among them."""
    rows = [(None if i % 40 == 0 else i % 40, f"i{i:04}", None if i == 77 else f"2024-01-01 {i // 60 % 24:02}:{i % 60:02}:00", f"Ana prefers {'tea' if i % 3 else 'milk'}") for i in range(1200)]
    df = spark.createDataFrame(rows, "scope long, id string, stamp string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.scope, r.id): (r.op, r.target, r.challenges) for r in M.reconcile(df, "scope").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 1200
    for scope in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == scope), key=lambda r: (r[2] is None, r[2] or "", r[1]))
        log, _ = M.fold([{"id": i, "stamp": s, "text": t, "authority": 1, "immutable": False, "expires": None} for _, i, s, t in own])
        assert {i: rest for i, *rest in log} == {i: list(v) for (s, i), v in got.items() if s == scope}


def test_similar_statements_are_all_pairs(spark):
    texts = _said(random.Random(2), 300)
    got = {(r.a, r.b): r.similarity for r in M.similar_statements(spark.createDataFrame([(t,) for t in texts], "text string"), 0.5).collect()}
    want = {(a, b): statement(a).similarity(statement(b)) for a, b in itertools.combinations(sorted(set(texts)), 2)}
    assert got == {p: s for p, s in want.items() if s >= 0.5} and len(got) > 100


@pytest.mark.parametrize("kind", ["long", "string"])
def test_dense_in_blocks_equals_the_broadcast_form(spark, monkeypatch, kind):
    rng = random.Random(1)
    of = lambda i: i if kind == "long" else f"r{i}"
    vectors = [(of(i), [rng.gauss(0, 1) for _ in range(6 if i % 9 else 5)]) for i in range(200)]
    rows = spark.createDataFrame(vectors, f"id {kind}, embedding array<double>")
    q = rows.limit(60).withColumnRenamed("id", "qid")
    whole = sorted(tuple(r) for r in R.dense(rows, q).collect())
    best = sorted(tuple(r) for r in R.dense(rows, q, best=7).collect())
    assert len(best) <= 60 * 7 < len(whole) and set(best) <= set(whole)
    monkeypatch.setattr(R, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(R, "QUERY_BLOCK", 16)
    monkeypatch.setattr(R, "ROW_CHUNK", 50)
    assert sorted(tuple(r) for r in R.dense(rows, q).collect()) == whole
    assert sorted(tuple(r) for r in R.dense(rows, q, best=7).collect()) == best


def test_bm25_from_texts_equals_the_postings_form(spark):
    rng = random.Random(6)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(_said(rng, 80))], "id long, text string")
    q = spark.createDataFrame([(i, t) for i, t in enumerate(_said(rng, 10))], "qid long, text string").select("qid", F.explode(tokens(F.col("text"))).alias("term"))
    a = R.bm25(R.terms(d, ["id"], "text"), d.select("id", F.size(tokens(F.col("text"))).alias("n_tokens")), q)
    rows = lambda df: sorted((r.qid, r.id, round(r.lex, 5)) for r in df.select("qid", "id", "lex").collect())
    want = rows(a.where("lex > 0"))
    assert rows(R.bm25_texts(d, q)) == want and rows(R.lexical(d, q)) == want
    best = rows(R.lexical(d, q, 3))
    assert set(best) <= set(want) and len(best) == sum(min(3, sum(w[0] == i for w in want)) for i in range(10))


def test_embed_chain(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string")

    def fails(docs, id_col, text_col):
        raise ValueError("no model")

    def partial(docs, id_col, text_col):
        return hash_vectors(docs.where("id = 1"), id_col, text_col)

    made = embed_chain(d, "id", "text", [("x|v1", fails), ("p|v1", partial), (signature("hash"), hash_vectors)])
    assert {(r.id, r.signature, len(r.embedding)) for r in made.collect()} == {(1, "hash|v1", 256), (2, "hash|v1", 256)}
    assert stale(made, signature("hash", 2)) and not stale(made, signature("hash"))
    with pytest.raises(ValueError):
        embed_chain(d, "id", "text", [("x|v1", fails)])


def test_word_pieces(spark):
    known = {"un": 1, "##aff": 2, "##able": 3, "a": 4, "##f": 5, "[UNK]": 0}
    assert word_pieces("unaffable", known, 0) == [1, 2, 3] and word_pieces("unx", known, 0) == [0] and word_pieces("a" * 101, known, 0) == [0]
    words = spark.createDataFrame([("unaff",), (None,), ("af",)], "word string")
    assert {r.word: r.ids for r in piece_ids(words, known, 0).collect()} == {"unaff": [1, 2], None: None, "af": [4, 5]}


def test_stems(spark):
    known = {
        "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled",
        "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss",
        "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc",
        "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal", "sensibiliti": "sensibl", "triplicate": "triplic",
        "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt",
        "communism": "commun", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
        "généralités": "general", "Ⅷ": "Ⅷ", "as": "as",
    }
    got = {r.term: r.stem for r in stem_terms(spark.createDataFrame([(w,) for w in known], "term string")).collect()}
    assert {w: s for w, s in got.items() if s != known[w]} == {"généralités": "generalit"}


def test_phrases(spark):
    d = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "on the cat"), (3, "cat the on"), (4, "")], "id long, text string")
    q = spark.createDataFrame([(1, "the cat"), (2, "cat"), (3, "on the mat"), (4, "absent cat"), (5, "")], "qid long, text string")
    assert {(r.qid, r.id) for r in R.phrase_search(d, q).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 1)}


def test_fold_equals_the_native_path(spark):
    rows = [("s", f"i{i:02}", f"2024-01-{i + 1:02}", f"Ana prefers {v}") for i, v in enumerate(["tea", "tea", "milk", "tea", "tea"])]
    facts = spark.createDataFrame(rows, "scope string, id string, stamp string, text string").withColumn("stamp", F.col("stamp").cast("timestamp_ntz"))
    fold = {r.id: r.op for r in M.reconcile(facts, "scope").collect()}
    assert fold == {r.id: r.op for r in M.reconcile_attributes(facts, "scope").collect()} == {"i00": "ADD", "i01": "NOOP", "i02": "UPDATE", "i03": "UPDATE", "i04": "NOOP"}


def test_belief_edges(spark):
    rows = [("a", "2024-01-01", None, None, None), ("b", "2024-01-01", "2024-01-05", None, None), ("c", "2024-01-01", None, "x", None), ("d", "2024-01-01", None, "x", "2024-01-06")]
    f = spark.createDataFrame(rows, "id string, stamp string, expires string, superseded_by string, superseded_at string").withColumn("text", F.lit("t"))
    for c in ("stamp", "expires", "superseded_at"):
        f = f.withColumn(c, F.col(c).cast("timestamp_ntz"))
    at = spark.createDataFrame([("2024-01-05",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("as_of"))
    assert {r.id for r in M.believed_at(f, at).collect()} == {"a", "d"}  # expired exactly then; superseded without a time


def test_auc_and_mcnemar(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.9, 1)], "s double, y int")
    assert E.auc(rows, "s", "y").first().auc == 0.875
    pairs = spark.createDataFrame([(True, False)] * 9 + [(False, True)] * 2 + [(True, True)] * 5, "a boolean, b boolean")
    r = E.mcnemar(pairs.withColumn("k", F.lit(1)), "k").first()
    assert (r.only_a, r.only_b) == (9, 2) and abs(r.p - 2 * sum(math.comb(11, i) for i in range(3)) / 2**11) < 1e-9


def test_learned_combination(spark):
    rows = spark.createDataFrame([(float(i % 2) + (i % 7) / 20, float(i % 2), i % 3 == 0) for i in range(90)], "x double, y double, held boolean")
    assert {r.part: r.auc for r in E.learned_combination(rows, ["x"], "y", "held").collect()} == {"train": 1.0, "held_out": 1.0}


def test_mcnemar_of_many_pairs(spark):
    """the work of the tail grew with the square of the discordant pairs."""
    sizes = [(0, 0), (0, 5), (3, 9), (40, 40), (990, 1100), (30000, 30300), (100, 30000)]
    ids = spark.createDataFrame([(i, *s) for i, s in enumerate(sizes)], "arm int, x int, y int")
    rows = ids.select("arm", F.explode(F.sequence(F.lit(0), F.col("x") + F.col("y"))).alias("i"), "x", "y")
    paired = rows.select("arm", (F.col("i") < F.col("x")).alias("a"), ((F.col("i") >= F.col("x")) & (F.col("i") < F.col("x") + F.col("y"))).alias("b"))
    got = {r.arm: r for r in E.mcnemar(paired, "arm").collect()}
    for arm, (x, y) in enumerate(sizes):
        n, term, tail = x + y, 1, 1  # C(n, 0)
        for i in range(1, min(x, y) + 1):
            term = term * (n - i + 1) // i
            tail += term
        want = min(1.0, float(2 * Fraction(tail, 2**n))) if n else 1.0
        assert (got[arm].only_a, got[arm].only_b) == (x, y) and got[arm].p == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_static_vectors_shuffle_a_pair_of_arrays_a_text(spark):
    """pieces of all words met their rows by joins and were spread over dimensions before any sum."""
    docs = spark.createDataFrame([(1, "ab ab zz"), (2, "AB"), (3, "zz"), (4, None), (5, "b"), (1, "c")], "id long, text string")
    rows = spark.createDataFrame([(0, [3.0, 0.0]), (1, [0.0, 4.0]), (9, [1.0, 1.0]), (77, [9.0, 9.0]), (1, [0.0, 4.0])], "key long, v array<float>")
    made = mean_of_pieces(docs, "id", "text", {"ab": 0, "c": 1, "b": 2}, 9, rows, "key", "v")
    got = {(r.id, r.dim): round(r.x, 6) for r in made.collect()}
    one = math.hypot(2 * 3 + 1, 4 + 1)
    half = round(math.sqrt(0.5), 6)
    assert got == {(1, 0): round(7 / one, 6), (1, 1): round(5 / one, 6), (2, 0): 1.0, (2, 1): 0.0, (3, 0): half, (3, 1): half}
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()


def test_chain_gives_zeros_where_all_tokens_cancel(spark):
    """a text whose two tokens share a bucket with opposite signs was left out of the last model's rows."""
    docs = spark.createDataFrame([(1, "w5 w37"), (2, "w5"), (3, "--"), (4, None)], "id long, text string")
    last = lambda d, i, t: hash_vectors(d, i, t, cancelled=True)
    got = {r.id: r.embedding for r in embed_chain(docs, "id", "text", [("m|v1", last)]).collect()}
    assert set(got) == {1, 2} and got[1] == [0.0] * 256 and any(got[2])
    assert {r.id for r in hash_vectors(docs, "id", "text").collect()} == {2}


def test_word_sets_are_looked_for_where_the_texts_lie(spark, monkeypatch):
    """F8: every word of every text met every question that asks for it."""
    rng = random.Random(5)
    said = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    docs = spark.createDataFrame([(f"n{i % 9}", t) for i, t in enumerate(said)] + [("n1", None)], "note string, text string")
    sets = sorted({tuple(sorted(set(rng.sample("abcdefgh", rng.randint(1, 3))))) for _ in range(30)})
    frame = spark.createDataFrame([(list(w),) for w in sets], "words array<string>")
    want = {(w, f"n{i % 9}") for w in sets for i, t in enumerate(said) if set(w) <= set(t.split())}
    for most, seen in ((1 << 20, 100), (20, 1)):
        monkeypatch.setattr(R, "SETS_BYTES", most)
        monkeypatch.setattr(R, "SEEN", seen)
        made = R.holding(docs, frame)
        got = [(tuple(r.words), r.note) for r in made.collect()]
        assert set(got) == want and len(got) == len(want)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()


def test_answers_are_cut_at_spaces_and_line_feeds_alone(spark):
    texts = ["aaaa bb\n more", "aaaa b\tcc more", "aaaa bb more", "aaaaa\n\n bbbb"]
    rows = spark.createDataFrame([(1, i, t, False) for i, t in enumerate(texts)], "qid long, rank int, text string, untrusted boolean")
    got = R.extractive_answer(rows, ["qid"], most=8).first().answer
    assert got == "[1] aaaa bb…\n[2] aaaa…\n[3] aaaa bb…\n[4] aaaaa…"


def _tea_facts(spark):
    names = ["Ann", "Bob", "Cid"]
    rows = [(f"f{i:03}", f"{names[i % 3]} likes tea {i % 7}" if i % 10 else None, i // 4, i % 4, i % 3) for i in range(200)]
    facts = spark.createDataFrame(rows, "id string, text string, d int, helpful int, unhelpful int").repartition(3)
    facts = facts.withColumn("stamp", F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(d)")).drop("d")
    asked = spark.createDataFrame([(1, "Does Ann like tea"), (2, "Bob coffee 3"), (3, "nothing known"), (4, "likes")], "qid long, text string")
    return facts, asked


def _slow_keywords(facts, asked):
    held = {r.id: set((r.text or "").lower().split()) for r in facts.collect()}
    weight = lambda t: math.log(1 + (len(held) - d + 0.5) / (d + 0.5)) if (d := sum(t in h for h in held.values())) else 1.0
    out = {}
    for q in asked.collect():
        ws = {t: weight(t) for t in set(q.text.lower().split())}
        out |= {(q.qid, i): sum(w for t, w in ws.items() if t in h) / sum(ws.values()) for i, h in held.items() if h & set(ws)}
    return out


@pytest.mark.parametrize("bytes_", [R.BROADCAST_BYTES, 100])
def test_keywords_are_scored_where_the_facts_lie(spark, monkeypatch, bytes_):
    monkeypatch.setattr(M, "BROADCAST_BYTES", bytes_)
    facts, asked = _tea_facts(spark)
    facts = facts.localCheckpoint()
    got = M.keyword_scores(facts, asked)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    got = {(r.qid, r.id): r.keyword for r in got.collect()}
    assert got == pytest.approx(_slow_keywords(facts, asked)) and len(got) > 200


@pytest.mark.parametrize("bytes_, held", [(R.BROADCAST_BYTES, 250_000), (3000, 1)])
def test_first_facts_leave_a_task(spark, monkeypatch, bytes_, held):
    facts, asked = _tea_facts(spark)
    keyword, now = _slow_keywords(facts, asked), F.lit("2026-03-01").cast("timestamp_ntz")
    priors = facts.select("id", "text", "stamp", X.entities(F.col("text")).alias("e"), M.recency(F.col("stamp"), now).alias("r"), M.usefulness(F.col("helpful"), F.col("unhelpful")).alias("u")).collect()
    want = []
    for q in asked.withColumn("e", X.entities(F.col("text"))).collect():
        scored, v = [], hash_vector(q.text)
        for f in priors:
            x = hash_vector(f.text)
            cos, word = max(0.0, round(float(v @ x), 6)) if x is not None else 0.0, keyword.get((q.qid, f.id), 0.0)
            if cos or word:
                overlap = sum(a in (f.e or ()) or (len(a) > 2 and any(a in h for h in f.e or ())) for a in q.e) / len(q.e) if q.e else 0.0
                scored.append((round(0.42 * cos + 0.28 * word + 0.18 * overlap + 0.04 * f.r + 0.08 * f.u, 6), f.stamp, f.id))
        scored.sort(key=lambda s: s[2])
        scored.sort(key=lambda s: s[:2], reverse=True)
        want += [(q.qid, i, s, rank + 1) for rank, (s, _, i) in enumerate(scored[:5])]
    monkeypatch.setattr(M, "BROADCAST_BYTES", bytes_)
    monkeypatch.setattr(M, "HELD", held)
    monkeypatch.setattr(M, "BLOCK_SCORES", 40)
    got = M.rank_facts(facts, asked, hash_token_rows, now, 5)
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[3])) == [(q, i, pytest.approx(s, abs=2e-6), r) for q, i, s, r in want]


def test_more_queries_than_a_broadcast_holds_shuffle_no_rows(spark, monkeypatch):
    rng = random.Random(3)
    vectors = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(600)]  # many ties, some zeros
    rows = spark.createDataFrame(vectors, "id long, embedding array<double>").repartition(3)
    q = rows.where("id % 5 = 0").withColumnRenamed("id", "qid")
    want = sorted(tuple(r) for r in R.dense(rows, q, best=4).collect())
    unit = {i: [x / (math.sqrt(sum(y * y for y in v)) or 1) for x in v] for i, v in vectors}
    slow = []
    for i in range(0, 600, 5):
        found = [(-round(sum(a * b for a, b in zip(unit[i], v)), 6), j) for j, v in unit.items()]
        slow += [(i, j, -c) for c, j in sorted(x for x in found if x[0] < 0)[:4]]
    assert want == sorted(slow)
    monkeypatch.setattr(R, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(R, "QUERY_BLOCK", 20)
    monkeypatch.setattr(R, "ROW_CHUNK", 3)
    monkeypatch.setattr(N, "BATCH_ROWS", 50)
    try:
        got = R.dense(rows, q, best=4)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CoGroup" not in plan and plan.count("Exchange") == 1 and sorted(tuple(r) for r in got.collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
