import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpusaudit.llm import maxent


def tokens(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        low = low.replace(c, " ")
    return [*[w for w in low.split(" ") if w], None]


def rows_of(rng):
    verbs, nouns = ["runs", "walks", "sits"], ["a dog", "the Cat", "one bird"]
    rows = []
    for k in range(200):
        text = ". ".join(f"{rng.choice(nouns)} {rng.choice(verbs)} by {rng.choice(nouns)}" for _ in range(rng.randint(1, 30)))
        rows.append((k, text + f" w{rng.randrange(40)}\n"))
    return [*rows, (500, None), (501, ""), (502, "É no\x1cbreak é"), (None, "no key"), (7, rows[7][1]), (503, "big " * 30_000)]


def test_base_and_counts_equal_brute_force(spark):
    rows = rows_of(random.Random(2))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    held = F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False))
    got = maxent.scored(docs, held).collect()
    learn = [t for k, t in rows if not (k is not None and k % 7 == 2)]
    counts = Counter(w for t in learn for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for k, t in rows:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want.append((str(k), len(w), sum(counts[x] > 0 for x in w), n, round(base, 6)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(r.score < 0 for r in got)


def test_chances_are_a_distribution():
    rng = np.random.default_rng(1)
    w = rng.normal(size=(2 * maxent.ROWS + (maxent.CLASSES + 1) ** 2, maxent.CLASSES)).astype(np.float32)
    f = tuple(rng.integers(0, maxent.ROWS, 50) for _ in range(3))
    assert np.allclose(maxent._chances(w, f).sum(1), 1, atol=1e-5)


def test_known_words_and_one_unknown_have_all_the_chance(spark):
    docs = spark.createDataFrame([(i, "a b c a b") for i in range(20)] + [(100 + i, w) for i, w in enumerate("abc")], "doc_id long, text string")
    got = {r.doc_id: r for r in maxent.scored(docs, F.col("doc_id") >= 100).collect()}
    assert all(math.isfinite(r.score) for r in got.values())
    assert got[100].score > got[102].score  # a text starts with a


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert maxent.scored(docs, F.lit(False)).count() == 0
