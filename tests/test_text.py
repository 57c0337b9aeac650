"""Text columns and preservation on small cases."""

import re
import sys
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusaudit.functions import names as N
from corpusaudit.functions import refs as R
from corpusaudit.functions import text as X
from corpusaudit.operators import preservation as P


def values(spark, cells, column):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_word_edges(spark):
    cells = ["a''b", "x'", "'x", "12b", "五", "①", "can't can’t Echo Echo", ""]
    want = [["a", "b"], ["x"], ["x"], ["12b"], ["五"], ["①"], ["can't", "can’t", "Echo", "Echo"], []]
    assert values(spark, cells, X.words(F.col("c"))) == want


def test_inert_characters_are_inert():
    ranges = re.findall(r"\\x\{([0-9A-F]+)\}-\\x\{([0-9A-F]+)\}", X.NFC_INERT)
    inert = [chr(c) for a, b in ranges for c in range(int(a, 16), int(b, 16) + 1)]
    assert len(inert) > 20000
    for char in inert:
        assert unicodedata.normalize("NFC", char) == char and unicodedata.combining(char) == 0
    # Nothing inert composes with a character before it.
    composes = set()
    for code in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            composes.add(chr(int(parts[1], 16)))
    assert not composes & set(inert)


def test_nfc(spark):
    cells = ["Cafe\u0301", "café", "か\u3099", None, "plain"]
    got = values(spark, cells, X.nfc(F.col("c")))
    assert got == ["Café", "café", "が", None, "plain"]


def test_whitespace_is_the_whole_set(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert len(spaces) == 29
    cells = [f"a{s}{s}b" for s in spaces]
    assert set(values(spark, cells, X.collapse_whitespace(F.col("c")))) == {"a b"}
    assert set(values(spark, cells, X.remove_whitespace(F.col("c")))) == {"ab"}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=40).filter(lambda s: "\x00" not in s and s.isprintable()), min_size=1, max_size=20))
def test_truncation_matches_bytes(spark, cells):
    for limit in (0, 1, 5, 9):
        want = [c.encode()[:limit].decode("utf-8", "ignore") for c in cells]
        assert values(spark, cells, X.truncate_bytes(F.col("c"), limit)) == want


def test_sentence_quotes(spark):
    cells = ["One. Two Gwern.net three. Four", "Gwern", "no name", "A\nbeside Gwern! B"]
    got = values(spark, cells, X.sentence_around(F.col("c"), F.lit("Gwern")))
    assert got == ["Two Gwern.net three.", "Gwern", None, "beside Gwern!"]


def test_occurrences_absent_is_not_zero(spark):
    df = spark.createDataFrame([("aXbX", "X"), ("ab", "X"), ("ab", ""), ("ab", None)], "t string, a string")
    assert [r[0] for r in df.select(X.occurrences(F.col("t"), F.col("a"))).collect()] == [2, 0, None, None]


def test_discard_messages(spark):
    cells = ["Note with key 'n1' defined at line 3 but not used.", "Note with key 'n2' defined at x", "other"]
    assert values(spark, cells, X.discarded_note_key(F.col("c"))) == ["n1", None, None]


def test_portable_names(spark):
    cells = ["  A/B: C?  ", "***", "é" * 60, "..x..", "It’s (1), [2] & 3_4-5."]
    got = values(spark, cells, N.portable_base(F.col("c")))
    assert got == ["A B C", "book", "é" * 40, "x", "It’s (1), [2] & 3_4-5"]


def test_bounded_identifiers(spark):
    cells = ["short", "x" * 77, "y" * 78, "é" * 50]
    got = values(spark, cells, N.bounded_identifier(F.col("c"), 96))
    assert got[:2] == cells[:2]
    assert got[2].startswith("y" * 68 + "-") and len(got[2]) == 77
    assert got[3].startswith("é" * 34 + "-") and len(got[3].encode()) == 77
    tiny = values(spark, ["abcdefghijk"], N.bounded_identifier(F.col("c"), 24))
    assert len(tiny[0]) == 5


def test_reference_classes(spark):
    cells = ["#a", "", "https://x/", "//host/x", "b.xhtml#f", "../../../up", "/root.css", "a%20b.png", "./c/../d"]
    got = values(spark, cells, R.classify_reference(F.lit("EPUB/text/ch.xhtml"), F.col("c")))
    assert [(r.kind, r.target) for r in got] == [
        ("same-document", None), ("same-document", None), ("external", None), ("external", None),
        ("in-book", "EPUB/text/b.xhtml"), ("unsafe", None), ("in-book", "root.css"),
        ("in-book", "EPUB/text/a b.png"), ("in-book", "EPUB/text/d"),
    ]


def test_unsafe_members(spark):
    cells = ["ok/x", "", "/abs", "a\\b", "../x", "a/..", "a..b"]
    got = values(spark, cells, R.is_unsafe_member(F.col("c")))
    assert got == [False, True, True, True, True, True, False]


def test_inline_payloads(spark):
    cells = ["data:image/png;base64,aGk=", "data:text/plain,a%20b+c%zz", "data:image/png", "data:x;base64,!!"]
    got = values(spark, cells, R.inline_payload(F.col("c")))
    assert [bytes(r.payload) if r.payload is not None else None for r in got] == [b"hi", b"a b+c%zz", None, None]
    assert [r.reason for r in got] == [None, None, "malformed-inline-reference", "undecodable-inline-data"]
    assert values(spark, cells[:1], X.inline_label(F.col("c"))) == ["data:image/png;base64,…"]


LOST = "Cafe\u0301 café `can't` can’t Echo Echo."


def test_lost_sentence(spark):
    base = f"Opening\n{LOST}\nFinal block."
    df = spark.createDataFrame([(1, base, "Opening\nFinal block."), (2, base, base)], "k bigint, b string, d string")
    lost = {r.token: r.unexpected for r in P.token_losses(df, "k", "b", "d").collect()}
    assert lost == {"Café": 1, "café": 1, "can't": 1, "can’t": 1, "Echo": 2}
    declared = spark.createDataFrame([(t, n) for t, n in lost.items()], "token string, allowed bigint")
    rows = {r.k: r for r in P.loss_totals(df, "k", "b", "d", declared).collect()}
    assert (rows[1].missing, rows[1].expected, rows[1].unexpected, rows[1].identical) == (6, 6, 0, False)
    assert (rows[2].missing, rows[2].added, rows[2].identical) == (0, 0, True)


def brute(b, d, pattern):
    from collections import Counter

    x, y = Counter(pattern.findall(b)), Counter(pattern.findall(d))
    return sum((x - y).values()), sum((y - x).values())


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(*[st.text(alphabet="ab' \n", max_size=60)] * 2), min_size=1, max_size=40))
def test_losses_match_brute_force(spark, pairs):
    """Shared and repeated lines in every mix; also missing + kept = baseline."""
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k bigint, b string, d string")
    word = re.compile(r"[a-z]+(?:'[a-z]+)*")
    rows = {r.k: r for r in P.loss_totals(df, "k", "b", "d", normalise=False).collect()}
    chars = {r.k: r for r in P.char_losses(df, "k", "b", "d", normalise=False).collect()}
    for i, (b, d) in enumerate(pairs):
        assert (rows[i].missing, rows[i].added) == brute(b, d, word)
        assert rows[i].baseline - rows[i].missing == rows[i].artifact - rows[i].added
        assert (chars[i].missing, chars[i].added) == brute(b, d, re.compile(r"(?s)."))


@pytest.mark.parametrize("partitions", [1, 8])
def test_partitions_do_not_matter(spark, partitions):
    df = spark.createDataFrame([(i, f"a b c{i}\nx", "x a") for i in range(50)], "k bigint, b string, d string")
    got = P.loss_totals(df.repartition(partitions), "k", "b", "d", normalise=False).collect()
    assert {(r.missing, r.added) for r in got} == {(2, 0)}


def test_short_extractions(spark):
    df = spark.createDataFrame([(1, "w " * 299), (2, "w " * 300)], "k bigint, t string")
    assert [r.k for r in P.extraction_failures(df, "k", "t").collect()] == [1]


def test_declared_and_claims(spark):
    rows = [("ok", 1), ("two words", 1), ("x", -1), ("e\u0301", 1), ("z", None)]
    df = spark.createDataFrame(rows, "token string, allowed bigint")
    got = [r.reason for r in P.validate_declared(df).collect()]
    assert got == [None, "invalid-token", "invalid-count", "invalid-token", "invalid-count"]
    totals = spark.createDataFrame([(1,), (2,)], "k bigint")
    said = spark.createDataFrame([(1, "Note with key 'a' defined at 1 but not used"), (2, "hm")], "k bigint, message string")
    claims = {r.k: (r.claimed, r.reason) for r in P.with_claim(totals, "k", said).collect()}
    assert claims == {1: (False, "source-reader-discarded-content"), 2: (True, None)}
