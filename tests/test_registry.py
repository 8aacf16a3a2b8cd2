"""Every registered query beside its SQL on the smallest tables; the entry without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from notelake.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent
#: A spread over the families; all of them run against DuckDB at sf0.01 outside the tests.
SAMPLE = (
    "a4_chat_export", "a8_tracker_export", "b3_links", "b6_blocks", "b12_memory_bullets", "c1_note_query", "c9_visibility", "c14_autocomplete", "d2_incremental_resolution", "d12_provenance",
    "e2_memory_facets", "e8_latency_histogram", "f3_fusion", "f10_prefix_search", "g4_believed_at", "g7_pair_decision", "h9_crdt_merge", "i3_breadth_burst", "i11_stream_metrics", "j9_mcnemar",
    "a10_code_export", "a11_drive_export", "b10_embed_chain", "b13_content_ids", "b15_attributes", "b16_negation", "b17_typed_values", "b22_corpus_build", "c10_filter_before_limit", "c11_whole_corpus", "d7_unlinked_mentions",
    "d13_entity_neighbourhood", "d16_supersession_chains", "e12_statement_similarity", "f2_dense", "f6_hybrid_search", "f11_phrase_search", "f18_all_words_recall", "g1_fact_ranking", "g8_value_updates", "g9_reconcile_fold",
    "a5_feed", "a9_wiki_export", "d13_graph_nodes", "d13_graph_edges", "e4_principal_statistics", "e5_principal_frequency", "e10_vault_panel", "e13_full_briefing", "f5_merged_passages", "f6_principal_search", "f10_fulltext_search",
    "f11_phrase_policy", "f11_terms_policy", "f12_stems", "f18_whole_question_recall", "g9_fact_table", "i2_stream_capped_denials", "i4_denial_burst", "i5_anomaly_report", "i8_stream_index", "j5_run_deltas", "j7_all_signals",
    "i2_stream_denial_cap", "i6_stream_reconcile", "i7_stream_upserts", "i8_stream_coalesced_edits", "j4_score_run",
)


def _value(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = lambda found: sorted(tuple(map(_value, r)) for r in found)
    assert rows(got.select(*names).collect()) == rows(want.fetchall())


def test_entry_works_without_the_training_data_operators(tmp_path):
    for name in ("notelake", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    (tmp_path / "notelake").mkdir()
    for part in (ROOT / "notelake").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "notelake" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'f6_hybrid_search' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); print(len(q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_nothing_else_imports_them():
    for f in (ROOT / "notelake").rglob("*.py"):
        if "llm" not in f.parts:
            assert "notelake.llm" not in f.read_text(), f
