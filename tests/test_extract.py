import random

import pytest
from pyspark.sql import functions as F

from notelake.functions.stem import stem
from notelake.functions.text import content_words, cosine, jaccard, normal
from notelake.operators import extract as X
from notelake.operators.chunk import chunk_text, chunks
from notelake.operators.corpus import build_corpus
from notelake.operators.embed import hash_vectors

BODY = """---
title: Alpha
tags: [red, blue]
title: Second
aliases: [first one]
---
# Heading [[Not/here]]

See [[Beta#part|the beta]] and [[beta]] and `[[code]]` #green #red/dark
status:: open
```
key:: fenced
- [ ] fenced task
[[fenced]]
```
## Tasks
- [x] done
  - [ ] nested
- plain
"""


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame([("n/alpha.md", BODY), ("n/empty.md", ""), ("n/none.md", "no blank line")], "path string, body string")


def test_frontmatter_and_title(notes):
    r = {x.path: x for x in notes.select("path", X.frontmatter(F.col("body")).alias("fm"), X.derived_title(F.col("body"), F.lit("stem")).alias("t")).collect()}
    assert r["n/alpha.md"].fm == {"title": "Alpha", "tags": "[red, blue]", "aliases": "[first one]"} and r["n/alpha.md"].t == "Alpha"
    assert r["n/empty.md"].fm == {} and r["n/empty.md"].t == "stem"


def test_links_keep_the_first_spelling_outside_code(notes):
    got = [(r.target, r.alias) for r in X.links(notes).orderBy("pos").collect()]
    assert got == [("Not/here", None), ("Beta", "the beta")]


def test_tags(notes):
    assert {r.tag for r in X.tags(notes).collect()} == {"red", "blue", "green", "red/dark"}


def test_facts_skip_fences(notes):
    assert [(r.key, r.value) for r in X.facts(notes).collect()] == [("status", "open")]


def test_blocks(notes):
    got = [(r.kind, r.level, r.text, r.checked, r.parent) for r in X.blocks(notes).orderBy("line").collect()]
    assert got == [
        ("heading", 1, "Heading [[Not/here]]", None, None),
        ("heading", 2, "Tasks", None, "Heading [[Not/here]]"),
        ("task", 0, "done", True, "Tasks"),
        ("task", 1, "nested", False, "Tasks"),
        ("item", 0, "plain", None, "Tasks"),
    ]


def test_corpus(notes):
    parts = build_corpus(notes)
    assert {k: v.count() for k, v in parts.items()} == {"notes": 3, "links": 2, "tags": 4, "facts": 1, "blocks": 5, "chunks": parts["chunks"].count()}


def test_chunks_lose_nothing():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "Sentence. ", "\n", "\n\n", "x" * rng.randint(1, 900)]) for _ in range(rng.randint(0, 40)))
        got = chunk_text(text, 100)
        assert "".join("".join(got).split()) == "".join(text.split())
        assert all(len(c) <= 150 for c in got)


def test_chunk_table(spark):
    df = spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, " ")], "note long, body string")
    assert [(r.note, r.chunk_idx, r.text) for r in chunks(df).collect()] == [(1, 0, "a\nb")]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Budget is $1,200 for 3 days in 1999, 40% of 7", [("money", "1200"), ("percent", "40"), ("number", "3"), ("number", "7")]),
        ("27:12, then 1:05:33; twelve euros or 12.0 EUR, three times, twice", [("money", "12"), ("duration", "27:12"), ("duration", "1:05:33"), ("number", "12"), ("number", "3"), ("number", "2")]),
        ("nothing", []),
    ],
)
def test_values(spark, text, want):
    row = spark.range(1).select(X.values(F.lit(text)).alias("v")).first()
    assert [(v.kind, v.text) for v in row.v] == want


def test_attribute_negation_entities(spark):
    row = spark.range(1).select(
        X.attribute(F.lit("Ana Diaz lives in New York")).alias("a"), X.attribute(F.lit("hm")).alias("none"), X.is_negation(F.lit("We NO LONGER do")).alias("n"),
        X.entities(F.lit("The Deploy Runbook names @ana, `AIServer` and src/main.py in NASA")).alias("e"),
    ).first()
    assert tuple(row.a) == ("ana diaz", "lives in", "new york") and row.none is None and row.n
    assert set(row.e) >= {"deploy runbook", "ana", "aiserver", "src/main.py", "nasa"} or "the deploy runbook" in row.e


def test_bullet_round_trip(spark):
    line = X.format_bullet(F.lit("2024-01-01"), F.lit("bot"), F.lit("likes: tea"), F.lit(True), F.lit("abc"))
    p = spark.range(1).select(X.parse_bullet(line).alias("p"), X.parse_bullet(F.lit("- plain")).alias("q")).first()
    assert (p.p.stamp, p.p.agent, p.p.text, p.p.struck, p.p.id) == ("2024-01-01", "bot", "likes: tea", True, "abc") and p.q is None


def test_html(spark):
    html = "<html><script>x</script><h2>A &amp; B</h2><ul><li>one<li>two</ul><nav>menu</nav><p>end</p></html>"
    r = spark.range(1).select(X.html_to_markdown(F.lit(html)).alias("m"), X.readable(F.lit(html), 8).alias("r")).first()
    assert r.m.startswith("## A & B") and "- one" in r.m and "x" not in r.m.split("A")[0]
    assert r.r == "A & B on"


def test_text_functions(spark):
    d = F.array(F.lit(1.0), F.lit(0.0))
    r = spark.range(1).select(
        normal(F.lit("  A-b,C ")).alias("n"), content_words(F.lit("the cat and the hat")).alias("w"), jaccard(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("j"),
        cosine(d, d).alias("c"), cosine(d, F.array(F.lit(0.0), F.lit(0.0))).alias("z"), cosine(d, F.array(F.lit(1.0))).alias("l"), stem(F.lit("running")).alias("s"), stem(F.lit("glass")).alias("g"), stem(F.lit("ponies")).alias("p"),
    ).first()
    assert (r.n, r.w, r.j, r.c, r.z, r.l, r.s, r.g, r.p) == ("a b c", ["cat", "hat"], 0.5, 1.0, 0.0, 0.0, "run", "glass", "poni")


def test_hash_vectors_are_unit(spark):
    v = hash_vectors(spark.createDataFrame([(1, "a b a"), (2, "")], "id long, text string"), "id", "text").collect()
    assert len(v) == 1 and abs(sum(x * x for x in v[0].embedding) - 1) < 1e-9
