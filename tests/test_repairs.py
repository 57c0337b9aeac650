"""Which pages the search for repairs reads."""

import __spark_entry__ as entry_points
from corpusaudit.plans import fact_queries


def test_only_pages_of_engaged_documents_are_read(spark, tmp_path, monkeypatch):
    rows = [(1, "Tide\nthe sea", "fr"), (2, "Tide\nthe sea and sky", "fr"), (3, "Tide\nplain words", "fr"), (4, "Tide\nthe sea", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, read = [], fact_queries.pages_to_nodes
    monkeypatch.setattr(fact_queries, "pages_to_nodes", lambda pages, *a, **k: seen.append(pages) or read(pages, *a, **k))
    found = entry_points.queries()["repair_candidates"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(1, "skipped")]
    assert sorted(r.doc_id for r in seen[0].collect()) == [1, 4]
