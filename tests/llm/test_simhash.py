import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from notelake.llm import components, simhash
from notelake.llm.common import written
from notelake.llm.components import connected_components


def slow_fingerprint(text, size=3):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def unsigned(x):
    return x & (2**64 - 1)


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one TWO", "a b c d e f É é", "x " * 40_000 + "y z"])
def test_fingerprint(text):
    assert unsigned(simhash.fingerprint_of(text)) == slow_fingerprint(text)


@pytest.mark.parametrize("distance,segments", [(3, 2), (5, 3), (0, 2), (7, 4)])
def test_links_are_all_pairs_within_the_distance(spark, distance, segments):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(80)]
    for f in prints[:40]:
        g = f
        for b in rng.sample(range(64), rng.randint(1, 6)):
            g ^= 1 << b
        prints.append(g)
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in prints} | {0, 1, 3, 7, 15})
    found = simhash.links(spark.createDataFrame([(x,) for x in signed * 2], "fp long"), "fp", distance, segments)
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if unsigned(a ^ b).bit_count() <= distance}
    assert {(r.a, r.b) for r in found.collect()} == want and found.count() == len(want)


def test_too_few_segments(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), "fp", 4, 2)


def test_groups_of_odd_rows(odd_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {(r.doc_id, r.fp): r.component_id for r in got}
    assert {v for (k, _), v in by.items() if k in (1, 2)} == {1}
    assert {v for (k, _), v in by.items() if k in (3, 4, 7)} == {3}  # no words: fingerprint zero
    assert simhash.near_duplicates(odd_docs.where(F.lit(False))).count() == 0


def test_near_copies(filed):
    base = " ".join(f"w{i}" for i in range(300))
    other = " ".join(f"v{i}" for i in range(300))
    changed = base.replace("w150", "changed")
    rows = [(1, base), (2, changed), (3, other), (4, None), (None, base), (5, ""), (6, base + " more"), (7, " ".join(reversed(base.split())))]
    docs = filed(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == {1: 1, 2: 1, 6: 1}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame([*edges, (None, 4)], "x long, y long"), "x", "y").collect()
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert {r.node: r.root for r in got} == {n: root(n) for n in nodes} and len(got) == len(nodes)


def edited_copies(rng, kinds=12):
    """Texts with copies that have a word replaced, text appended or half of it repeated."""
    texts = []
    for _ in range(kinds):
        for n in (50, 200):
            base = [f"w{rng.randrange(100_000)}" for _ in range(n)]
            other = [*base]
            other[rng.randrange(n)] = "changed"
            texts += [base, other]
            for more in (0.1, 0.15, 0.2):
                base = [f"w{rng.randrange(100_000)}" for _ in range(n)]
                texts += [base, base + [f"w{rng.randrange(100_000)}" for _ in range(int(n * more))]]
            base = [f"w{rng.randrange(100_000)}" for _ in range(n)]
            texts += [base, base + base[: n // 2] * 3]
    return [" ".join(t) for t in texts]


def brute_components(texts, similarity=0.8):
    """Smallest position of each text's component, for the texts that have a near copy."""
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    root, linked = list(range(len(texts))), set()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        shared = len(sets[i] & sets[j])
        if shared >= similarity * (len(sets[i]) + len(sets[j]) - shared):
            a, b = sorted((find(i), find(j)))
            root[b] = a
            linked |= {i, j}
    return {i: find(i) for i in linked}


def test_near_copies_of_edited_texts_are_all_found(filed):
    texts = edited_copies(random.Random(11))
    want = brute_components(texts)
    assert len(want) > len(texts) // 2
    got = simhash.near_copies(filed(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_copies_under_one_fingerprint(filed):
    passage = " ".join(f"p{i}" for i in range(41))
    tails = [" ".join(f"{c}{i}" for i in range(40)) for c in "ab"]
    texts = [f"{(passage + ' ') * 60}{t}" for t in (*tails, tails[1].replace("b39", "changed"))]
    assert len({simhash.fingerprint_of(t, 2) for t in texts}) == 1  # the passage alone decides it
    assert brute_components(texts) == {1: 1, 2: 1}
    got = simhash.near_copies(filed(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1}


def test_tables_that_grow_are_never_broadcast(spark, monkeypatch):
    plans = []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    for module in (simhash, components):
        monkeypatch.setattr(module, "written", seen)
    monkeypatch.setattr(components, "BROADCAST_EDGES", 0)
    said = "one two three four five six seven eight nine ten"
    rows = [(i, f"{said} {i // 3}" if i % 2 else f"{said} {said} x{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for found in (simhash.near_duplicates(docs), simhash.near_copies(docs), simhash.links(docs.select(F.col("doc_id").alias("fp")))):
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        assert found.count()
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
