"""Registered queries against their SQL on the smallest tables; all of them: tools/check_queries.py."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tools.check_queries import TABLES, plain

FOLDER = "/root/testdata/sf0.001"
QUICK = (
    "word_counts text_loss text_loss_totals char_loss multiset_ops nfc_forms whitespace_forms glyph_hits "
    "sentence_quotes language_tags candidate_states evidence_problems inbox_owners routine_selection "
    "artifact_names artifact_names_existing declared_losses portable_bases bounded_ids delivery_plan deliverable "
    "source_kinds page_links_by_kind page_headings page_words distinct_locators page_verdicts tree_constructs "
    "tree_text note_numbers package_navigation inline_references arrival_states corpus_rollup immutable_evidence "
    "replaced_attempts nested_line_holders remote_pictures picture_candidates suppressed_captions callout_titles "
    "figure_measures figure_metadata decoded_documents inline_labels fitting_images inherited_facts kept_reports "
    "layered_facts conformance_results conformance_severities streamed_first_arrivals"
).split()
#: Minutes in all: python -m pytest tests/test_queries.py --every
DEAR = sorted(set(entry_points.registry.ORACLES) - set(QUICK))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [*QUICK, *(pytest.param(n, marks=pytest.mark.dear) for n in DEAR)])
def test_query_equals_sql(spark, con, name):
    df = entry_points.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = con.execute(entry_points.oracle_sql()[name])
    named = [d[0] for d in rel.description]
    assert sorted(named) == columns
    want = sorted(tuple(plain(r[named.index(c)]) for c in columns) for r in rel.fetchall())
    assert got == want


def test_every_oracle_has_its_query(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).columns == ["doc_id", "token", "missing", "expected", "unexpected"]
