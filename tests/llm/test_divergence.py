import random
import re
from collections import Counter

import pytest

from notelake.llm import divergence


def brute_force(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    terms = [[lower(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)] for text, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(r[2], t) for r, t in zip(rows, terms) if r[1] == lang]
        kept = {t for t, n in Counter(t for _, ts in own for t in set(ts)).items() if n >= min_docs}
        count = lambda lists: Counter(t for ts in lists for t in ts if t in kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q = share(count(ts for _, ts in own))
        groups = {s: count(ts for x, ts in own if x == s) for s in {s for s, _ in own}}
        shares = {s: share(c) for s, c in groups.items()}
        for s, p in shares.items():
            found = {"pair": [(sum(abs(p[t] - o[t]) for t in kept), other) for other, o in shares.items() if other != s]}
            found["term"] = [(p[t] - q[t], t) for t in kept if groups[s][t] and p[t] > q[t]]
            for part, items in found.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items) if part == "pair" or i < top]
    return sorted(out)


def check(spark, rows, min_docs=30, top=50):
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "text string, lang string, source string, n int, item string, p0 string")
    got = divergence.audit(docs, min_docs=min_docs, top_terms=top)
    assert sorted(map(tuple, got.collect())) == brute_force(rows, min_docs, top)


def test_odd_rows(spark):
    rows = [("the cat the dog Été", "en", "a"), ("The CAT ate", "en", "b"), ("the cat the dog Été", "en", "a"), (None, None, None), ("", "en", "c"), ("été cat", "en", None)]
    rows += [("12 34 !", "xx", "a"), ("q", "xx", "b"), ("alone alone", "yy", "z"), ("dog " * 5000, "en", "b")]
    check(spark, rows, min_docs=1)
    check(spark, rows, min_docs=2, top=2)
    check(spark, rows, min_docs=50)


def test_many_terms_and_groups(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES_PER_SALT", 2)
    rng = random.Random(7)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = [(" ".join(rng.choice(words[: 20 + 30 * (i % 7)]) for _ in range(60)), rng.choice(["en", "de"]), f"s{i % 7}") for i in range(150)]
    check(spark, rows, min_docs=3)
    divergence_rows = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"), min_docs=3).where("part = 'pair'")
    assert divergence_rows.count() == 2 * 7 * 6


def test_empty_table(spark):
    out = divergence.audit(spark.createDataFrame([], "text string, lang string, source string"))
    assert out.count() == 0 and out.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "one Two thrée\u2028four,five\x7fsix " * 50
    whole = [t for some in divergence.terms_of(text.encode()) for t in some]
    assert whole == [t.encode() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.replace("T", "t"))]
    for size in (1, 3, 10, 64):
        monkeypatch.setattr(divergence, "PIECE", size)
        assert [t for some in divergence.terms_of(text.encode()) for t in some] == whole


def test_counts_sent_on_early(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    check(spark, [("a b c", "en", "a"), ("a d", "en", "b"), ("a b", "en", "a")], min_docs=1)


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total = 9 * 10**15, 10**16
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(7)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 35)


@pytest.mark.parametrize("count", [0, 1, 63])
def test_bitmaps_hold_each_term_once(spark, count):
    from pyspark.sql import functions as F

    rows = [("en", "a", i, count) for i in range(130)]
    maps = divergence.bitmaps(spark.createDataFrame(rows, "lang string, source string, number long, n long"))
    assert maps.count() == 3 and maps.agg(F.sum(F.bit_count("bits"))).first()[0] == 130
