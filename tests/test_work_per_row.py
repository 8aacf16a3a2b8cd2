"""Costly expressions are worked out once a row, and results stay those of the plain rule."""

import re

from pyspark.sql import functions as F

from notelake.operators import memory as M
from notelake.operators import search as R
from notelake.plans.registry import COSTLY, table


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _plain_snippet(text, first, width=12):
    words = re.split("[ \n]+", text)
    bare = [re.sub("[^a-z0-9]", "", w.lower()) for w in words]
    if first not in bare:
        return None
    at = bare.index(first)
    start = max(at - 3, 0)
    return " ".join(f"[{w}]" if i == at else w for i, w in enumerate(words[start : start + width], start))


def test_snippet_equals_the_plain_rule(spark):
    long = " ".join(f"w{i}" for i in range(40))
    texts = ["the", " the end", "\n\n(The) x", "a b", "", f"{long} T-h.e {long}", f"{long} them there", "é𝄞 İ the  \n 𝄞 z ", "a\tthe b the c", f"{long} the"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.s for r in rows.select("id", R.snippet(F.col("text"), F.lit("the")).alias("s")).collect()}
    assert got == {i: _plain_snippet(t, "the") for i, t in enumerate(texts)}


def test_snippet_looks_at_a_text_once(spark):
    rows = spark.createDataFrame([("the", 1)], "text string, id long")
    assert _plan(rows.select(R.snippet(F.col("text"), F.lit("the")).alias("s"))).count("lower(") <= 2


def test_pairs_are_normalised_once_a_text(spark):
    pairs = spark.createDataFrame([("the budget is $5", "the budget is $7", 1, 1, False)], "new string, old string, new_authority int, old_authority int, old_immutable boolean")
    assert _plan(M.decide_pairs(pairs)).count(r"[^\p{L}\p{N}]+") == 2
    # five masks and looks of the four kinds a side, and values only where the slot is the same
    plan = _plan(M.value_updates(pairs.select("new", "old")))
    assert plan.count("regexp_extract_all") == 10


def test_costly_tables_are_dealt_in_small_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("notelake.plans.registry.COSTLY", 64 << 10)
    spark.range(200_000).select(F.rand(1).alias("x")).write.parquet(f"{tmp_path}/t.parquet")
    parts = table(spark, str(tmp_path), "t", costly=True).rdd.getNumPartitions()
    assert parts >= 20 > spark.sparkContext.defaultParallelism and COSTLY == 8 << 20


def test_sharding_rounds_run_over_cells_and_keep_counts():
    from notelake.llm import shards

    # 15 groups across the ends of 16 shards; lone rows only on some
    cells = {g: {g % 16: 40 + g, g % 16 + 1: 30 + g} for g in range(15)}
    lone = {s: 60 for s in range(0, 16, 2)}
    after, filled = shards.settle(cells, lone, 16)
    sizes = lambda c, own: [sum(x.get(s, 0) for x in c.values()) + own.get(s, 0) for s in range(16)]
    assert sizes(after, filled) == sizes(cells, lone) and min(filled.values()) >= 0
    assert {g: sum(c.values()) for g, c in after.items()} == {g: sum(c.values()) for g, c in cells.items()}
    assert shards._apart(after) < shards._apart(cells)
    for g in cells:
        moves = shards._moves(cells[g], after[g])
        for s, n in cells[g].items():
            assert n - sum(e - f for at, f, e, _ in moves if at == s) + sum(e - f for _, f, e, to in moves if to == s) == after[g].get(s, 0)


def test_merging_replicas_shuffles_once_into_tasks_of_bounded_size(spark, monkeypatch):
    from notelake.operators import sync

    monkeypatch.setattr(sync, "MERGED_ATOMS", 100)
    atoms = spark.range(2000).select((F.col("id") % 50).alias("doc"), F.array(F.col("id").cast("int")).alias("key"), F.lit("a").alias("site"), F.col("id").alias("clock"), F.lit("x").alias("ch"))
    merged = sync.crdt_merge(atoms.unionByName(atoms.where("id % 2 = 0")), atoms.where("clock % 5 = 0"))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(doc" in plan and ", 34)" in plan
    assert {r.doc: (r.text, r.atoms) for r in merged.collect()} == {d: ("x" * n, n) for d in range(50) if (n := sum(i % 5 != 0 for i in range(d, 2000, 50)))}


def test_a_reconciled_scope_is_read_as_plain_rows(spark):
    from pyspark.sql import Row

    from notelake.streaming.state import _Reconciler

    class Held(dict):
        def iterator(self):
            return iter([])

        def updateValue(self, k, v):
            self[k] = v

    r = _Reconciler()
    r.facts = Held()
    base = dict(authority=1, immutable=False, expires=None, until=None)
    rows = [Row(id="b", stamp="2", text="Ann prefers tea", **base), Row(id="a", stamp="1", text="Ann prefers milk", **base)]
    got = [tuple(x) for x in r.handleInputRows(("s",), iter(rows), None)]
    assert [g[1:4] for g in got] == [("a", "ADD", None), ("b", "UPDATE", "a")] and list(r.facts) == [("b",)]


def test_similar_statements_shuffle_no_pairs(spark, monkeypatch):
    texts = [f"{' '.join(f'w{(i * k) % 23}' for k in range(1, 2 + i % 6))} s{i}x" for i in range(120)] + ["w1 w2 w3", "w3 w2 w1.", "the"]
    said = spark.createDataFrame([(t,) for t in texts], "text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = M.similar_statements(said, 0.5)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = sorted(tuple(r) for r in found.collect())
        monkeypatch.setattr(M, "BROADCAST_BYTES", 0)  # the vocabulary is joined
        assert rows == sorted(tuple(r) for r in M.similar_statements(said, 0.5).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    bags = {t: set(t.rstrip(".").split()) - {"the"} for t in texts}
    want = [(a, b, len(bags[a] & bags[b]) / len(bags[a] | bags[b])) for a in sorted(bags) for b in sorted(bags) if a < b and bags[a] and bags[b]]
    assert rows == [w for w in want if w[2] >= 0.5] and len(rows) > 20
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("hashpartitioning(k#") == 2  # statements, by a word
