import pytest
from pyspark.sql import functions as F

from notelake.operators import links as L
from notelake.operators import query as Q
from notelake.functions.ranks import numbered


@pytest.fixture(scope="module")
def props(spark):
    rows = [("alpha", {"status": "active", "prio": "3", "due": "2026-09-01"}), ("beta", {"status": "Done", "prio": "10"}), ("gamma", {"status": "active", "prio": "high"}), ("delta", {})]
    return spark.createDataFrame(rows, "path string, fm map<string,string>")


@pytest.mark.parametrize(
    "key,op,operand,want",
    [
        ("status", "=", "ACTIVE", {"alpha", "gamma"}), ("status", "!=", "active", {"beta", "delta"}), ("prio", ">", 5, {"beta"}), ("prio", "<=", "3", {"alpha"}),
        ("status", "contains", "ON", {"beta"}), ("due", "exists", None, {"alpha"}), ("due", "missing", None, {"beta", "gamma", "delta"}), ("prio", "!=", 3, {"beta", "gamma", "delta"}),
    ],
)
def test_predicates(props, key, op, operand, want):
    value = F.element_at("fm", F.lit(key))
    assert {r.path for r in props.where(Q.property_predicate(value, op, operand)).collect()} == want


@pytest.mark.parametrize(
    "spec",
    [
        {"source": "pages"}, {"filters": {"kind": "task"}}, {"source": "blocks", "filters": {"pinned": True}}, {"limit": 0}, {"limit": 201}, {"sort": "body"},
        {"filters": {"where": [("a", "~", 1)]}}, {"formulas": {"x": ("eval", "path")}},
    ],
)
def test_bad_specs(spec):
    with pytest.raises(ValueError):
        Q.Spec(**spec)


def test_visibility(spark):
    rows = spark.createDataFrame(
        [("a", "s1", False, [], False), ("b", "s1", True, [], False), ("c", "s2", False, ["ann"], False), ("d", "s2", False, [], True)],
        "path string, space string, private boolean, readers array<string>, untrusted boolean",
    )
    people = spark.createDataFrame(
        [("ann", ["s1", "s2"], False, False), ("bob", None, True, True), ("eve", [], True, False)],
        "user string, spaces array<string>, include_private boolean, trusted_only boolean",
    )
    got = {(r.user, r.path) for r in Q.visible_to(rows, people, readers="readers", untrusted="untrusted").collect()}
    assert got == {("ann", "a"), ("ann", "c"), ("ann", "d"), ("bob", "a"), ("bob", "b")}


def test_group_puts_the_empty_bucket_last(spark):
    rows = spark.createDataFrame([(1, None), (2, "b"), (3, "a"), (4, "b")], "i long, k string")
    got = [(r.bucket, r.n, r["items"]) for r in Q.group_rows(rows, "k", ["i"], "i").orderBy("place").collect()]
    assert got == [("b", 2, [2, 4]), ("a", 1, [3]), ("", 1, [1])]


def test_link_tiers(spark):
    notes = spark.createDataFrame([("x/beta.md", "Gamma", "al"), ("y/gamma.md", "Beta", "gamma"), ("z/beta.md", "Beta", "AL")], "path string, title string, alias string")
    links = spark.createDataFrame([("x/beta.md", t) for t in ("beta", "GAMMA", "x/Beta", "z/beta.md", "al", "nobody")], "src string, target string")
    got = {r.target: r.dst for r in L.resolve(links, notes).collect()}
    # a title wins over a stem, the last of two equal titles, the first of two aliases
    assert got == {"beta": "z/beta.md", "GAMMA": "x/beta.md", "x/Beta": "x/beta.md", "z/beta.md": "z/beta.md", "al": "x/beta.md", "nobody": None}


def test_spaces_by_longest_prefix(spark):
    paths = spark.createDataFrame([("a/b/c.md",), ("a/d.md",), ("e.md",), ("ab/c.md",)], "path string")
    spaces = spark.createDataFrame([("a/", "one"), ("a/b/", "two")], "prefix string, id string")
    assert {r.path: r.space for r in L.assign_spaces(paths, spaces).collect()} == {"a/b/c.md": "two", "a/d.md": "one", "e.md": "commons", "ab/c.md": "commons"}


def test_mentions_are_whole_words(spark):
    docs = spark.createDataFrame([("d1", "x\nThe Red  Fox ran"), ("d2", "redfox and foxes"), ("d3", "a fox")], "doc string, body string")
    names = spark.createDataFrame([("red fox", "n1"), ("fox", "n2"), ("a", "n3")], "name string, dst string")
    linked = spark.createDataFrame([("d3", "n2")], "doc string, dst string")
    assert {(r.name, r.doc, r.line) for r in L.mentions(docs, names, linked).collect()} == {("red fox", "d1", 1), ("fox", "d1", 1)}


def test_chains(spark):
    rows = [(f"f{i}", f"f{i + 1}" if i < 9 else None) for i in range(10)] + [("lone", None)]
    got = {r.id: (r["last"], r.length) for r in L.chains(spark.createDataFrame(rows, "id string, superseded_by string")).collect()}
    assert got == {f"f{i}": ("f9", 9 - i) for i in range(10)} | {"lone": ("lone", 0)}


def test_neighbourhood_depths(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "c"), (3, "d")], "fact long, entity string")
    got = {(r.entity, r.depth) for r in L.neighbourhood(m, spark.createDataFrame([("a",)], "seed string"), 2).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}


def test_numbered_is_one_window(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 101).alias("x"), (F.col("id") % 3).alias("g"), "id")
    got = numbered(df, ["g"], [F.floor(F.col("x") / 10)], [F.col("x"), F.col("id")], "n").collect()
    for g in range(3):
        own = sorted((r for r in got if r.g == g), key=lambda r: (r.x, r.id))
        assert [r.n for r in own] == list(range(len(own)))


def test_graph_around_partial_seeds(spark):
    said = {"f1": ["priya sharma", "acme"], "f2": ["priya sharma", "acme", "rome"], "f3": ["rome", "tiber"], "f4": ["priya sharma jr", "x1"], "f5": ["tiber", "sea"], "f6": ["日本", "kyoto 日本"]}
    m = spark.createDataFrame([(f, e) for f, es in said.items() for e in es], "fact string, entity string")
    seeds = spark.createDataFrame([("Priya",), ("acme",), ("zz",), ("nobody",), (" harm",), ("本",)], "asked string")
    got = {r.asked: r.seed for r in L.resolve_seeds(m, seeds).collect()}
    assert got == {"Priya": "priya sharma", "acme": "acme", "zz": "zz", "nobody": "nobody", " harm": "priya sharma", "本": "日本"}
    nodes, edges = L.entity_graph(m, seeds.where("asked in ('Priya', 'nobody')"), 2, 4)
    assert [(r.asked, r.entity, r.depth, r.facts) for r in nodes.orderBy("asked", "place").collect()] == [
        ("Priya", "priya sharma", 0, 2), ("Priya", "acme", 1, 2), ("Priya", "rome", 1, 2), ("Priya", "tiber", 2, 2), ("nobody", "nobody", 0, 0)
    ]
    assert {(r.a, r.b, tuple(r.facts)) for r in edges.collect()} == {("acme", "priya sharma", ("f1", "f2")), ("priya sharma", "rome", ("f2",)), ("acme", "rome", ("f2",)), ("rome", "tiber", ("f3",))}
