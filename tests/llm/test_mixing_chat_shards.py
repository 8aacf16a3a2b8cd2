import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.llm import chat, mixing, shards


def slow_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s] + 1e-9]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = float(cap * sizes[s])
            open_.discard(s)
        left = sum(sizes.values()) - sum(target.values())
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 1000, "c": 10, "d": 70, None: 300}, {"a": 7}, {"a": 0, "b": 10}, {"a": 1, "b": 1, "c": 1, "d": 900}])
def test_targets(spark, sizes):
    rows = [(s, n // 2) for s, n in sizes.items()] + [(s, n - n // 2) for s, n in sizes.items()]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = slow_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_settle_keeps_words_and_expectation():
    size = np.array([9.0, 7.0, 5.0, 3.0, 2.0, 1.0])
    share = np.array([0.3, 0.8, 0.5, 0.25, 0.6, 0.4])
    total = np.zeros(len(size))
    runs = 4000
    for seed in range(runs):
        p, left = mixing.settle(share, size, np.random.default_rng(seed))
        assert abs(float(p @ size) - float(share @ size)) < 1e-9
        assert sum(0 < x < 1 for x in p) <= 1 and (left < 0) == all(x in (0, 1) for x in p)
        total += p
    assert np.abs(total / runs - share).max() < 0.04


def test_word_count(spark):
    texts = [None, "", " ", "a", " a  b\tc\n", "a\u00a0b c", "\x0b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.word_count(F.coalesce("text", F.lit(""))).alias("n"))
    assert [r.n for r in df.collect()] == [len((t or "").encode().split()) for t in texts]


def _mixed(docs, **more):
    return {(r["__file"], r["__row"]): (r.doc_id, r.source, r.size, r.target, r.copies) for r in mixing.mix(docs, **more).collect()}


def test_mixture(filed):
    rows = [(i, "w " * (i % 17 + 1), f"s{i % 3}" if i % 3 else "hot") for i in range(900)]
    docs = filed(rows, "doc_id long, text string, source string", files=4)
    got = _mixed(docs, block_rows=40)
    assert got == _mixed(docs, block_rows=40) and len(got) == 900
    for source, group in itertools.groupby(sorted(got.values(), key=lambda v: v[1]), key=lambda v: v[1]):
        group = list(group)
        assert all(0 <= v[4] <= 3 for v in group)
        assert abs(sum(v[2] * v[4] for v in group) - group[0][3]) <= 10, source


@pytest.mark.parametrize("kind", ["string", "null"])
def test_mixture_without_number_ids(filed, kind):
    rows = [(f"doc {i}" if kind == "string" else None, " ".join(f"w{i}x{j}" for j in range(i % 17 + 1)), f"s{i % 2}") for i in range(400)]
    docs = filed(rows, "doc_id string, text string, source string", files=4)
    got = _mixed(docs, block_rows=40)
    assert len(got) == 400 and got == _mixed(docs, block_rows=40)
    for source in ("s0", "s1"):
        own = [v for v in got.values() if v[1] == source]
        assert abs(sum(v[2] * v[4] for v in own) - own[0][3]) <= 10


def test_rows_of_one_null_id_spread_over_blocks(filed, monkeypatch):
    seen = []
    level = mixing._level
    monkeypatch.setattr(mixing, "_level", lambda rows, seed, k: seen.append(rows.groupBy("block").count().agg(F.max("count")).first()[0]) or level(rows, seed, k))
    docs = filed([(None, "one and the same text", "a") for _ in range(1000)], "doc_id long, text string, source string")
    assert mixing.mix(docs, block_rows=50).count() == 1000
    assert seen[0] < 120


def test_mixture_on_small_tables(spark):
    """Every document within its cap and every source within one document of its target, by brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {}
    sizes = {r.doc_id: (r.source, len((r.text or "").encode().split())) for r in docs.collect()}
    for source, n in sizes.values():
        want[source] = want.get(source, 0) + n
    target = slow_targets(want)
    got = mixing.mix(docs).collect()
    assert {r.doc_id: (r.source, r.size) for r in got} == sizes
    for source in want:
        own = [r for r in got if r.source == source]
        assert all(0 <= r.copies <= 3 and abs(r.target - target[source]) < 1e-6 for r in own)
        assert abs(sum(r.size * r.copies for r in own) - target[source]) <= max(r.size for r in own)


def test_mixture_of_odd_rows(odd_docs):
    got = _mixed(odd_docs)
    assert len(got) == odd_docs.count()
    assert mixing.mix(odd_docs.where(F.lit(False))).count() == 0


TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi # there"), (1, 2, "assistant", "\\### Assistant: </turn> ok"),
    (2, 0, "user", None), (2, 1, "assistant", ""), (2, 2, "user", "again"),
    (3, 0, "assistant", "first"), (3, 1, "judge:#", "x"), (4, 1, None, "y"), (4, 1, "user", "a"), (4, 1, "user", "a"),
    (None, 0, "user", "\\b\\h\\l\\c"), (None, None, "user", "z"), (5, 0, "user", "</turn>\n### User: x"), (5, 1, "assistant", "\\\\l \ud7ff"),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    out = {
        r.conv_id: r
        for r in chat.format_conversations(turns)
        .withColumns({"read": chat.read_back(F.col("formatted")), "learned": chat.learned_text(F.col("segments"))})
        .collect()
    }
    for conv in {t[0] for t in TURNS}:
        own = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] is not None, t[2] or "", t[3] or ""))
        r = out[conv]
        assert [(x.role, x.text) for x in r.read] == [(t[2] or "", t[3] or "") for t in own]
        assert r.learned == "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
    assert {c: out[c].valid for c in out} == {1: True, 2: False, 3: False, 4: False, None: False, 5: True}
    assert chat.format_conversations(turns.where("false")).count() == 0


def test_chat_of_very_long_texts(spark):
    long = "a # b < c : \\\\ é" * 60_000
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(turns).withColumn("read", chat.read_back(F.col("formatted"))).first()
    assert [x.text for x in r.read] == [long, long] and r.valid


def check_shards(got, n):
    rows = got.collect()
    counts = {}
    for r in rows:
        counts.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == n and all(sorted(s) == list(range(len(s))) for s in counts.values())
    sizes = [len(counts.get(i, [])) for i in range(16)]
    assert set(counts) <= set(range(16)) and max(sizes) - min(sizes) <= 1
    return rows


def test_shards_keep_groups_together(filed):
    rows = [(i, f"text {i // 3}" if i < 300 else "hot" if i < 600 else f"lone {i}") for i in range(1000)]
    got = check_shards(shards.shard_documents(filed(rows, "doc_id long, text string", files=3)), 1000)
    where = {}
    for r in got:
        if r.doc_id < 300:
            where.setdefault(r.doc_id // 3, set()).add(r.shard)
    assert sum(len(w) == 1 for w in where.values()) >= 95
    # the group of 300 is more than four shards' worth, and only linked neighbours and lone rows give way
    hot = [r.shard for r in got if 300 <= r.doc_id < 600]
    held = sorted((hot.count(s) for s in set(hot)), reverse=True)
    assert sum(held[:5]) > len(hot) / 2


def test_groups_alone_stay_together_but_at_the_ends_of_shards(filed):
    rows = [(i, f"text {i // 5}") for i in range(1000)]
    placed = shards.shard_documents(filed(rows, "doc_id long, text string", files=3))
    check_shards(placed, 1000)
    groups, split, _ = shards.cut(placed).first()
    assert groups == 200 and split <= 15


def test_large_groups_are_ranked_in_slices(filed, monkeypatch):
    monkeypatch.setattr(shards, "PART_ROWS", 10)
    rows = [(i, "hot" if i < 300 else f"text {i // 4}") for i in range(800)]
    placed = shards.shard_documents(filed(rows, "doc_id long, text string", files=3))
    check_shards(placed, 800)
    assert shards.cut(placed).first().split <= 15


def test_cut_counts_groups_on_several_shards(spark):
    rows = [(1, 0), (1, 0), (1, 3), (2, 4), (2, 4), (3, 5)]
    assert tuple(shards.cut(spark.createDataFrame(rows, "by_group long, shard int")).first()) == (2, 1, 1)


def test_shards_of_odd_rows(odd_docs):
    got = check_shards(shards.shard_documents(odd_docs), odd_docs.count())
    assert {r.size for r in got if r.doc_id in (3, 4)} == {1}
    assert shards.shard_documents(odd_docs.where(F.lit(False))).count() == 0


def test_exchanges_along_a_cycle_of_shards_go_on_to_their_end():
    # every group has rows on two neighbours and there are no lone rows, so no two shards alone can exchange
    for n in (3, 5, 16, 40):
        cells = {g: {g: 7, (g + 1) % n: 4} for g in range(n)}
        settled, lone = shards.settle(cells, {}, n)
        assert all(len(c) == 1 for c in settled.values()) and not any(lone.values())
        assert sorted(s for c in settled.values() for s in c) == list(range(n))


def test_no_change_and_no_swap_of_shards_gathers_more():
    rng = random.Random(5)
    for _ in range(60):
        n, groups = rng.choice([2, 3]), rng.randint(2, 4)
        cells = {g: {s: rng.randint(1, 6) for s in range(n)} for g in range(groups)}
        lone = {s: rng.choice([0, 2]) for s in range(n)}
        room = [lone[s] + sum(c[s] for c in cells.values()) for s in range(n)]
        settled, left = shards.settle(cells, lone, n)
        size = {g: sum(c.values()) for g, c in cells.items()}
        assert {g: sum(c.values()) for g, c in settled.items()} == size
        assert [left.get(s, 0) + sum(c.get(s, 0) for c in settled.values()) for s in range(n)] == room
        # homes from which no change and no swap gathers more rows
        gathered = lambda home: sum(min(room[s], sum(size[g] for g in size if home[g] == s)) for s in range(n))
        home = {g: min(c, key=lambda s: (-c[s], s)) for g, c in settled.items()}
        held = sum(max(c.values()) for c in settled.values())
        for g in home:
            assert all(gathered({**home, g: s}) <= held for s in range(n))
            assert all(gathered({**home, g: home[h], h: home[g]}) <= held for h in home)
