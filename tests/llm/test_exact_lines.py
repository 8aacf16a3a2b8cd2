import hashlib
import re

from pyspark.sql import functions as F

from notelake.llm import exact, lines


def slow_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    return groups


TEXTS = [(5, "a  b"), (3, "a\t\nb"), (9, "a b"), (1, "ab"), (2, None), (4, ""), (7, " "), (None, "ab"), (8, "é\u00a0x"), (6, "é x"), (10, "\x0b"), (3, "a b")]


def check(result, rows):
    got = result.collect()
    assert len(got) == len(rows)
    groups = slow_groups(rows)
    for norm, ids in groups.items():
        own = [r for r in got if bytes(r.digest) == hashlib.sha256(norm.encode()).digest()]
        assert len(own) == len(ids) and {r.group_size for r in own} == {len(ids)}
        least = min((i for i in ids if i is not None), default=None)
        assert {r.keep_id for r in own} == {least} and sum(r.kept for r in own) == 1


def test_groups(filed):
    docs = filed([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, digest string")
    check(exact.exact_duplicates(docs), TEXTS)


def test_state_carries_over_batches(filed):
    docs = filed([(i, t) for i, t in TEXTS], "doc_id long, text string", files=3)
    check(exact.exact_duplicates(docs, files_per_batch=1), TEXTS)


def test_a_digest_that_covers_two_texts(filed, monkeypatch):
    monkeypatch.setattr(exact, "digest_of", lambda norm: F.unhex(F.lpad(F.hex(F.length(norm)), 8, "0")))
    docs = filed([(1, "ab"), (2, "cd"), (3, "cd"), (4, "abc")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(docs).collect()}
    assert got == {1: (1, 1, True), 2: (2, 2, True), 3: (2, 2, False), 4: (4, 1, True)}


def test_a_later_run_knows_the_texts_of_earlier_ones(filed, tmp_path):
    schema, at = "doc_id long, text string", str(tmp_path / "kept")
    first = filed([(5, "a  b"), (6, "c"), (7, "d")], schema)
    assert exact.exact_duplicates(first, checkpoint=at).where("kept").count() == 3
    second = filed([(2, "c"), (8, "a b"), (9, "e"), (10, "a\tb")], schema)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(second, checkpoint=at).collect()}
    assert got == {2: (2, 2, True), 8: (5, 3, False), 9: (9, 1, True), 10: (5, 3, False)}


def test_many_hits_are_not_broadcast(filed, monkeypatch):
    monkeypatch.setattr(exact, "BROADCAST_HITS", 0)
    monkeypatch.setattr(exact, "HOT_DIGESTS", 3)
    check(exact.exact_duplicates(filed(TEXTS, "doc_id long, text string")), TEXTS)


def test_odd_rows(odd_docs):
    got = exact.exact_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count() and sum(r.kept for r in got if r.keep_id == 1) == 1


def test_empty_table(filed):
    assert exact.exact_duplicates(filed([(1, "a")], "doc_id long, text string").where("doc_id > 5")).count() == 0


def _sites(filed, n):
    rows = [(i, f"s{i % n}", f"own {i}\n  Menu | Home \nbody {i}\n\nrare {i % 3}") for i in range(40)]
    return filed([*rows, (100, None, None), (None, "s1", "Menu | Home"), (5, "s2", "x\n Menu | Home")], "doc_id long, source string, text string")


def test_boilerplate_goes_by_sites(filed):
    out = lines.remove_boilerplate(_sites(filed, 12), min_sites=10).collect()
    assert len(out) == 43
    for r in out:
        if r.doc_id == 100:
            assert r.text is None and (r.n_lines, r.n_removed) == (0, 0)
        else:
            assert "Menu" not in r.text and r.n_removed == 1
    full = next(r for r in out if r.doc_id == 7)
    assert full.text == "own 7\nbody 7\n\nrare 1" and full.n_lines == 4


def test_many_boilerplate_lines_and_null_ids(filed, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    docs = _sites(filed, 12)
    nulls = filed([(None, r.source, r.text) for r in docs.collect()], "doc_id long, source string, text string")
    texts = lambda out: sorted(str(r.text) for r in out.collect())
    assert texts(lines.remove_boilerplate(nulls)) == texts(lines.remove_boilerplate(docs))


def test_few_sites_are_no_boilerplate(filed):
    out = lines.remove_boilerplate(_sites(filed, 9).where("source is not null"), min_sites=10)
    assert out.where("n_removed > 0").count() == 0


def test_exact_counts_decide_near_the_threshold(spark):
    keys = spark.createDataFrame([(f"s{i}", bytearray([k])) for k in (9, 10, 11, 30) for i in range(k)] * 2, "site string, line binary")
    assert sorted(r.line[0] for r in lines.boilerplate(keys, 10, 8).collect()) == [10, 11, 30]


def test_lines_of_an_empty_table(odd_docs):
    assert lines.remove_boilerplate(odd_docs.where(F.lit(False))).count() == 0
    assert lines.remove_boilerplate(odd_docs).count() == odd_docs.count()
