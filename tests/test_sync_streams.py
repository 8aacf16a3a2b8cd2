import pytest
from pyspark.sql import functions as F

from notelake.operators import access_log as A
from notelake.operators import memory as M
from notelake.operators import sync as Y
from notelake.sources import exports
from notelake.sources.notes import note_tree, read_jsonl
from notelake.streaming import jobs, state


def test_crdt_merge_is_commutative_and_idempotent(spark):
    atoms = spark.createDataFrame([("d", [1], "a", 1, "h"), ("d", [1, 5], "b", 1, "i"), ("d", [2], "a", 2, "!"), ("d", [3], "a", 3, "x")], "doc string, key array<int>, site string, clock int, ch string")
    tombs = spark.createDataFrame([("d", "a", 3)], "doc string, site string, clock int")
    a, b = atoms.where("clock < 3"), atoms.where("site = 'a'")
    texts = {Y.crdt_merge(x, tombs).first().text for x in (atoms, a.unionByName(b), b.unionByName(a).unionByName(a))}
    assert texts == {"hi!"}


def test_incomplete_pages_delete_nothing(spark):
    known = spark.createDataFrame([("c", "1"), ("c", "2"), ("k", "1")], "connector string, external_id string")
    docs, seen = known.where("external_id = '9'"), known.where("external_id = '2'")
    complete = spark.createDataFrame([("c", True), ("k", False)], "connector string, complete boolean")
    assert [(r.connector, r.external_id) for r in Y.reap(known, docs, seen, complete).collect()] == [("c", "1")]


def test_conflicts(spark):
    current = spark.createDataFrame([("a.md", "1"), ("b.md", "2"), ("c.md", "3")], "path string, hash string")
    changes = spark.createDataFrame([("a.md", "1", "9", False), ("b.md", "0", "8", False), ("c.md", "0", None, True), ("d.md", None, "7", False), ("b.md", "0", "9", False)], "path string, base_hash string, hash string, deleted boolean")
    got = sorted((r.path, r.status, r.final_path) for r in Y.apply_changes(current, changes).collect())
    assert got == [("a.md", "ok", "a.md"), ("b.md", "conflict", "b.conflict-2.md"), ("b.md", "conflict", "b.conflict.md"), ("c.md", "conflict-keep", "c.md"), ("d.md", "created", "d.md")]


def _burst(spark, n, gap, allowed=True):
    rows = [(i, i * gap, "u", f"hr/{i}", allowed) for i in range(n)]
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).cast("timestamp_ntz")
    return spark.createDataFrame(rows, "id long, s long, caller string, path string, allowed boolean").withColumn("at", at)


def test_bursts_at_the_edge(spark):
    assert A.breadth_bursts(_burst(spark, 15, 21)).first().n == 15  # the last is 294 s after the first
    assert A.breadth_bursts(_burst(spark, 15, 22)).count() == 0
    assert A.denial_bursts(_burst(spark, 5, 75, False)).first().n == 5
    assert A.denial_bursts(_burst(spark, 5, 76, False)).count() == 0


@pytest.mark.parametrize("windows", [1, 2, 12])
def test_bursts_equal_a_search_from_every_event(spark, monkeypatch, windows):
    import datetime
    import random

    monkeypatch.setattr(A, "WINDOWS_PER_SLICE", windows)
    rng = random.Random(windows)
    rows = [(i, rng.choice("ab") if i % 3 else "hot", f"p{rng.randrange(30)}", rng.random() < 0.7, rng.randrange(4000)) for i in range(600)]
    base = datetime.datetime(2024, 1, 1)
    e = spark.createDataFrame([(i, c, p, ok, base + datetime.timedelta(seconds=s)) for i, c, p, ok, s in rows], "id long, caller string, path string, allowed boolean, at timestamp_ntz")
    for breadth, found in ((True, A.breadth_bursts(e, 300, 3)), (False, A.denial_bursts(e, 300, 3))):
        want = set()
        for caller in {r[1] for r in rows}:
            own = sorted((s, i, p, ok) for i, c, p, ok, s in rows if c == caller)
            best = None
            for k, (s, _, _, ok) in enumerate(own):
                inside = [x for x in own[k:] if x[0] <= s + 300 and x[3] == breadth]
                paths = list(dict.fromkeys(x[2] for x in inside)) if breadth else [x[2] for x in inside]
                if (breadth or not ok) and len(paths) >= 3 and (best is None or len(paths) > best[0]):
                    best = (len(paths), s, inside[-1][0], ",".join(paths[:8]))
            want |= {(caller, *best)} if best else set()
        got = {(r.caller, r.n, (r["first"] - base).seconds, (r["last"] - base).seconds, ",".join(r.documents)) for r in found.collect()}
        assert got == want and want


def test_stream_of_facts_equals_the_fold(spark):
    rows = [(f"s{i % 2}", f"i{i:02}", f"2024-01-{i + 1:02}", f"Ana prefers {'tea' if i % 4 else 'milk'}") for i in range(12)]
    facts = spark.createDataFrame(rows, "scope string, id string, stamp string, text string")
    got = jobs.deliver(facts, "stamp", lambda s: state.reconcile_stream(s, "scope"), "append", "t", 4)
    assert got.select("batch").distinct().count() >= 4
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select("scope", "id", "op", "target", "challenges").collect())) == sorted(map(key, M.reconcile(facts, "scope").collect()))


def test_expired_facts_leave_the_state(spark):
    rows = [("s", "a", "2024-01-01", "Ana prefers tea", "2024-01-05"), ("s", "b", "2024-01-09", "x y z", None), ("s", "c", "2024-02-01", "Ana prefers tea", None)]
    facts = spark.createDataFrame(rows, "scope string, id string, stamp string, text string, expires string")
    got = {r.id: r.op for r in jobs.deliver(facts, "stamp", lambda s: state.reconcile_stream(s, "scope"), "append", "t", 4).collect()}
    assert got == {"a": "ADD", "b": "ADD", "c": "ADD"}


def test_expired_facts_leave_by_timer_and_others_stay_as_they_were_written(spark, tmp_path):
    rows = [("s", f"f{i:02}", f"2024-01-{i + 1:02}", f"thing{i} is unlike all others", "2024-01-06" if i % 3 == 0 else None) for i in range(20)]
    facts = spark.createDataFrame(rows, "scope string, id string, stamp string, text string, expires string")
    at = str(tmp_path / "state")
    jobs.deliver(facts, "stamp", lambda s: state.reconcile_stream(s, "scope", "1 hour"), "append", "t", 4, at).count()
    held = spark.read.format("statestore").option("stateVarName", "facts").load(at)
    ids = {r.i for r in held.selectExpr("user_map_key.id AS i").collect()}
    # those that had expired when they came are written and leave with the next watermark
    assert ids == {f"f{i:02}" for i in range(20) if i % 3}


def test_denials_beyond_the_cap_are_counted(spark):
    rows = [(i, f"2024-01-01 00:0{i // 40}:{i % 40:02}", "u" if i % 4 else None, f"p{i}", i == 5) for i in range(120)] + [(999, "2024-01-02 00:00:00", "end", "", False)]
    events = spark.createDataFrame(rows, "id long, at string, caller string, path string, allowed boolean").withColumn("at", F.col("at").cast("timestamp_ntz"))
    out = [r for r in jobs.deliver(events, "at", lambda s: state.capped_denials(s, 7, "1 second"), "append", "t", 5).collect() if r.caller != "end"]
    for caller in ("u", ""):
        for minute in range(3):
            asked = [i for i in range(minute * 40, minute * 40 + 40) if (i % 4 == 0) == (caller == "") and i != 5]
            own = [r for r in out if r.caller == caller and r.minute.minute == minute]
            assert sorted(r.id for r in own if r.id is not None) == asked[:7]
            assert [r.suppressed for r in own if r.id is None] == ([len(asked) - 7] if len(asked) > 7 else [])


def test_a_late_fact_does_not_replace_a_newer_one(spark):
    rows = [(0, "s", "b", "2024-02-01", "Ana prefers tea"), (1, "s", "a", "2024-01-01", "Ana prefers milk")]
    facts = spark.createDataFrame(rows, "turn int, scope string, id string, stamp string, text string")
    late = facts.withColumn("turn", F.timestamp_seconds("turn"))
    got = {r.id: (r.op, r.target) for r in jobs.deliver(late, "turn", lambda s: state.reconcile_stream(s, "scope"), "append", "t", 2).collect()}
    assert got == {"b": ("ADD", None), "a": ("LATE", "b")}


def test_upserts_are_delivered_once(spark):
    e = _burst(spark, 6, 10).select(F.lit("c").alias("connector"), (F.col("id") % 3).cast("string").alias("external_id"), F.lit("h").alias("hash"), "at")
    assert jobs.deliver(e, "at", jobs.connector_upserts, "append", "u").count() == 3


def test_note_tree_skips_hidden_folders(spark, tmp_path):
    for p in ("a/x.md", "a/.hidden/y.md", ".git/z.md", "a/b/c d.txt", "a/q.png"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("body")
    assert {r.path.replace("%20", " ") for r in note_tree(spark, str(tmp_path)).collect()} == {"a/x.md", "a/b/c d.txt"}


def test_feed_reads_items_and_entries(spark, tmp_path):
    (tmp_path / "rss.xml").write_text("<rss><channel><item><title>T</title><link>http://l</link><description>&lt;p&gt;d&lt;/p&gt;</description><pubDate>Tue, 02 Jan 2024 10:00:00 +0000</pubDate></item></channel></rss>")
    (tmp_path / "atom.xml").write_text("<feed><entry><id>e1</id><title>U</title><content>c</content><updated>2024-01-03T00:00:00Z</updated></entry></feed>")
    got = {r.external_id: (r.title, r.body, str(r.updated)) for r in exports.feed(spark, str(tmp_path)).collect()}
    assert got == {"http://l": ("T", "d", "2024-01-02 10:00:00"), "e1": ("U", "c", "2024-01-03 00:00:00")}


def test_an_empty_set_is_an_error(spark, tmp_path):
    import pytest

    (tmp_path / "x.json").write_text("")
    with pytest.raises(ValueError):
        read_jsonl(spark, str(tmp_path), "q long")


def test_streaks_and_calendar(spark):
    days = spark.createDataFrame([("u", d) for d in ("2024-01-01", "2024-01-02", "2024-01-02", "2024-01-04")], "u string, d string").select("u", F.to_date("d").alias("day"))
    assert sorted((str(r["first"]), r.length) for r in Y.streaks(days, "u").collect()) == [("2024-01-01", 2), ("2024-01-04", 1)]
    assert Y.calendar(days, "2024-01-01", 1).agg(F.sum("n"), F.count("*")).first()[:] == (4, 7)
