import math
import random
import re

import numpy as np
import pytest

from corpusaudit.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, k):
    """Each item's best documents, by reading every document for every term."""
    words = [(key, terms(text)) for key, text in docs]
    size, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for key, w in words:
            score = 0
            m = 100 - 75 + (75 * len(w) * size) // max(total, 1)
            for t in terms(text):
                tf = w.count(t)
                if tf:
                    weight = math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1)))
                    score += weight * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        scored.sort(key=lambda x: x[:3])
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(scored[:k])]
    return sorted(out, key=str)


def made(rng, n, words=60):
    names = [f"w{i}" for i in range(words)]
    shares = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(rng.choices(names, shares, k=rng.choice([3, 10, 40, 200])))) for i in range(n)]


@pytest.mark.parametrize(("segment", "summed", "stride"), [(8 << 20, 4096, 128), (3000, 0, 4), (20_000, 60, 8)])
def test_equals_brute_force(spark, monkeypatch, segment, summed, stride):
    monkeypatch.setattr(lexical, "SEGMENT", segment)
    monkeypatch.setattr(lexical, "SUMMED", summed)
    monkeypatch.setattr(lexical, "STRIDE", stride)
    rng = random.Random(4)
    docs = made(rng, 300)
    docs += [(1000, None), (1001, ""), (1002, "-- !!"), (1003, "Ünïcode w1 漢字 w1W2"), (None, docs[0][1]), (7, docs[7][1])]
    items = [(i, " ".join(t.split()[:12])) for i, t in made(rng, 12)]
    items += [(50, None), (51, ""), (52, "unknown"), (53, "w1 W1 w1 ÜNÏCODE Ünïcode"), (53, "w3"), (None, "w9")]
    monkeypatch.setattr(lexical, "ITEM_BLOCK", 200)
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, term string, item_id int")
    asked = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")
    got = lexical.ranked(lexical.index(table.repartition(3)), asked, 10).collect()
    assert got[0].__fields__ == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got), key=str) == plain(docs, items, 10)


def test_string_keys_and_ties(spark):
    docs = [("b", "same words"), ("a", "same words"), ("c", "same words"), ("d", "other words here")]
    table = spark.createDataFrame(docs, "name string, body string")
    items = spark.createDataFrame([("q", "same")], "item_id string, text string")
    got = lexical.ranked(lexical.index(table, "name", "body"), items, 2, key="name").collect()
    assert [(r.rank, r.name) for r in sorted(got)] == [(1, "a"), (2, "b")]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(lexical.index(docs.limit(0)), items).collect() == []
    assert lexical.ranked(lexical.index(docs), items.limit(0)).collect() == []
    assert lexical.ranked(lexical.index(docs.selectExpr("doc_id", "cast(null as string) text")), items).collect() == []


def test_a_term_in_every_document_has_no_weight_left(spark):
    docs = spark.createDataFrame([(i, "all") for i in range(2000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "all all")], "item_id long, text string")
    assert lexical.ranked(lexical.index(docs), items).collect() == []


def test_most_documents_are_passed_over(monkeypatch):
    """A rare term decides; of the long list only strides with its documents are looked at."""
    n = 100_000
    lengths = np.full(n, 100, np.int64)
    every = np.arange(n)
    ones = np.ones(n, np.int64)
    bounds = (np.ones(n // 128 + 1, np.int64), np.full(n // 128 + 1, 100, np.int64))
    rare = np.arange(50, n, 5000)
    few = (rare, ones[: len(rare)], ones[:1], lengths[:1])
    asked = []
    scores_of = lexical.Bounded.scores_of
    monkeypatch.setattr(lexical.Bounded, "scores_of", lambda self, docs: (asked.append(len(docs)), scores_of(self, docs))[1])
    got = lexical.top([(every, ones, *bounds, 2), (*few, 9000)], lengths, 100 * n, n, 10)
    assert [p for _, p in got] == rare[:10].tolist()
    assert sum(asked) < 200
