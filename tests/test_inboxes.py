"""Files and documents that a scan of inboxes must not pass over."""

import hashlib
import os

import __spark_entry__ as entry_points
from corpusaudit.sources import stores


def _put(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as file:
        file.write(content)


def test_files_of_no_bytes_are_files(spark, tmp_path):
    for name, content in (("a b.md", ""), ("deep/c.md", ""), ("deep/d.md", "x"), ("e.pdf", ""), (".f.md", ""), ("_g/h.md", "")):
        _put(f"{tmp_path}/in/{name}", content)
    found = stores.scan_inbox(spark, [("flat", f"{tmp_path}/in", False), ("deep", f"{tmp_path}/in", True)]).collect()
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    got = sorted((r.inbox, r.path.split("/in/")[1], r.byte_size, r.supported, r.sha256) for r in found)
    top = [("a b.md", 0, True, digest("")), ("e.pdf", 0, False, None)]
    below = [("deep/c.md", 0, True, digest("")), ("deep/d.md", 1, True, digest("x"))]
    assert got == sorted([("flat", *r) for r in top] + [("deep", *r) for r in top + below])
    assert all(r.path.startswith("file:/") and r.modified_at is not None for r in found)


def test_a_report_of_no_bytes_is_an_unreadable_one(spark, tmp_path):
    _put(f"{tmp_path}/one/report.json", "")
    _put(f"{tmp_path}/two/report.json", '{"finished_at": "x"}')
    got = {r.bundle: (r.readable, r.finished_at) for r in stores.scan_reports(spark, str(tmp_path)).collect()}
    assert got == {"one": (False, None), "two": (True, "x")}


def test_the_store_client_lists_the_same_empty_files(spark, tmp_path):
    for name in ("a b.md", "deep/c.md", "_g/h.md"):
        _put(f"{tmp_path}/in/{name}", "")
    walked = {(r.path, r.modified_at.timestamp()) for r in stores.empty_files(spark, f"{tmp_path}/in").collect()}
    assert walked == {(path, ms / 1000) for path, ms in stores._asked(spark, f"{tmp_path}/in", True)}


def test_documents_without_text_or_language_are_files(spark, tmp_path):
    rows = [(1, "abcd", "en"), (2, "", "de"), (3, None, "fr"), (4, "abcd", None), (5, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = entry_points.queries()["inbox_files"](spark, str(tmp_path)).collect()
    assert sorted((r.inbox, r.inbox_ord, r.name, r.byte_size) for r in found) == [
        ("first", 0, "de/2.md", 0), ("first", 0, "en/1.md", 4), ("first", 0, "en/5.pdf", 0),
        ("second", 1, "4.md", 4), ("second", 1, "fr/3.pdf", 0),
    ]
