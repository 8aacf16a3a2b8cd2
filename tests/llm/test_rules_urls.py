import re

import pytest
from pyspark.sql import functions as F

from notelake.llm import rules, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " ", "a", "a b", "a b c", "a b c a b c", "x x x x", "one\ntwo\none\n\n \none", "#|<b>\t& $5%", "a b c d e f a b c x d e f", "é ñ 🙂 é ñ 🙂", "a\u00a0b c\x0bd"]


def test_base_statistics(filed):
    docs = filed([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words long")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.base_statistics(docs).collect()}
    assert got == {i: slow_statistics(t) for i, t in enumerate(TEXTS)}


def test_order_changes_no_verdict(odd_docs):
    forward = {(r.doc_id, r.kept, r.n_words) for r in rules.judge(odd_docs).collect()}
    backward = {(r.doc_id, r.kept, r.n_words) for r in rules.judge(odd_docs, rules.RULES[::-1]).collect()}
    assert forward == backward
    assert rules.judge(odd_docs.where(F.lit(False))).count() == 0


def test_rules_run_by_rejection_per_cost(filed):
    text = " ".join(f"w{i}" for i in range(80))
    docs = filed([(i, text + ("!" * 200 if i % 2 else "")) for i in range(20)], "doc_id long, text string")
    dear, cheap, never = rules.Rule("dear", "length(text) > 400", "length(text) * 1000"), rules.Rule("cheap", "n_words > 10"), rules.Rule("never", "false")
    for given in ([never, dear, cheap], [cheap, never, dear]):
        assert [r.name for r in rules.order_rules(rules.base_statistics(docs), given)] == ["cheap", "dear", "never"]
    half = rules.Rule("half", "length(text) > 400", "0.25")
    assert [r.name for r in rules.order_rules(rules.base_statistics(docs), [cheap, half])] == ["half", "cheap"]


def test_the_order_is_the_same_on_every_run(filed):
    docs = filed([(i, "Word! " * (i % 90)) for i in range(300)], "doc_id long, text string")
    runs = {tuple(sorted((r.doc_id, str(r.rejected_by)) for r in rules.judge(docs, given).collect())) for given in (rules.RULES, rules.RULES, rules.RULES[::-1])}
    assert len(runs) == 1


def test_any_frame_is_judged(spark, filed, tmp_path):
    rows = [(i, f"{TEXTS[i % len(TEXTS)] or ''} " * (i % 40)) for i in range(120)]
    docs = filed(rows, "doc_id long, text string", files=4)
    want = {(r.doc_id, r.kept, r.n_words) for r in rules.judge(docs).collect()}
    docs.write.json(str(tmp_path / "json"))
    from_json = spark.read.schema("doc_id long, text string").json(str(tmp_path / "json"))
    assert {(r.doc_id, r.kept, r.n_words) for r in rules.judge(from_json).collect()} == want
    renamed = docs.withColumnRenamed("text", "said")
    assert {(r.doc_id, r.kept, r.n_words) for r in rules.judge(renamed, text_col="said").collect()} == want
    some = rules.judge(docs.where("doc_id < 50")).collect()
    assert {(r.doc_id, r.kept, r.n_words) for r in some} == {x for x in want if x[0] < 50}


def test_sample_comes_from_all_files(filed):
    docs = filed([(i, "x") for i in range(4000)], "doc_id long, text string", files=8)
    ids = [r.doc_id for r in rules.even_sample(docs, 400).collect()]
    assert 250 < len(ids) < 550 and min(ids) < 500 and max(ids) > 3500


def test_no_rules(odd_docs):
    assert {r.kept for r in rules.judge(odd_docs, ()).where("not base_failed").collect()} <= {True}


URLS = [
    ("http://WWW.Example.com/en/1", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/", "www.example.com/en/", "allow"),
    ("http://m.example.com/en/2?x", "example.com/en/", "block"),
    ("http://notexample.com/en/2", "com/", "allow"),
    ("http://example.com", None, "allow"),
    ("http://example.com/EN/", "com/", "allow"),
    ("https://b.net/es/x", "net/es/", "block"),
    ("https://net/fr/", "net/fr/", "block"),
    ("https://casino-win.example.net/en/1", None, "block"),
    ("https://casinos.example.net/en/1", None, "allow"),
    ("https://example.org?u=http://b.net/es/", None, "allow"),
    ("example.com/en/", None, "allow"),
    (None, None, "allow"),
    ("", None, "allow"),
    ("://", None, "allow"),
    ("x://b.net/es#/en", None, "allow"),
]


def test_urls(spark):
    rows = [(i, u, "clash", "clash") for i, (u, _, _) in enumerate(URLS)] + [(0, URLS[0][0], "", ""), (None, URLS[0][0], "", "")]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, rule string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            assert (r.rule, r.verdict) == URLS[r.page_id][1:], URLS[r.page_id]


def test_no_url_rules_and_no_urls(spark):
    pages = spark.createDataFrame([(1, "http://b.net/es/")], "page_id long, url string")
    assert urls.filter_urls(pages, (), ()).first().verdict == "allow"
    assert urls.filter_urls(pages.where("false")).count() == 0


def test_a_rule_needs_a_token():
    with pytest.raises(ValueError):
        urls.UrlRule("any", "block", ".*", ())


def test_open_path_end_is_no_token():
    assert urls.host_rule("example.com/en", "block").tokens == ("example", "com")


def test_index_takes_the_rarest_token(spark):
    tokens = spark.createDataFrame([("com",)] * 5 + [("en",)] * 3 + [("example",)], "token string")
    row = urls.index_rules(tokens, [urls.host_rule("example.com/en/", "block")]).first()
    assert row.token == "example"
