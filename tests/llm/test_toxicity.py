import random

import numpy as np

from corpusaudit.llm import toxicity

BAD = ["vile", "grot", "muck", "scab"]


def corpus(rng, n):
    plain = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    docs, labels = [], []
    for k in range(n):
        words = rng.choices(plain, k=rng.randint(10, 120))
        toxic = rng.random() < 0.15
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD).upper() + ",")
        docs.append((k, " ".join(words), "en"))
        if rng.random() < 0.5:
            labels.append((k, int(toxic), "en"))
    truth = {d[0]: any(b in d[1].lower() for b in BAD) for d in docs}
    return docs, labels, truth


def test_held_out_accuracy(spark):
    rows, labels, truth = corpus(random.Random(3), 1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    model = toxicity.fit(docs.filter("doc_id % 5 != 0"), marks.filter("doc_id % 5 != 0"))
    got = [r for r in toxicity.toxicity(docs, model, "text", "doc_id").collect() if r.doc_id % 5 == 0]
    hit = [r for r in got if truth[r.doc_id]]
    clean = [r for r in got if not truth[r.doc_id]]
    assert np.mean([r.predicted for r in hit]) > 0.9 and np.mean([r.predicted for r in clean]) < 0.05
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    odd = [(1, None), (2, ""), (None, "vile muck grot scab"), (3, "vile muck"), (3, "vile muck"), (4, "abc " * 20_000)]
    got = toxicity.toxicity(spark.createDataFrame(odd, "doc_id long, text string"), model, "text", "doc_id").collect()
    by = {str(r.doc_id): r.predicted for r in got}
    assert len(got) == len(odd) and by["1"] == by["2"] == by["4"] == 0 and by["None"] == by["3"] == 1


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    clean = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) == [] and toxicity.fit(docs, clean) == []
    assert [r.score for r in toxicity.toxicity(docs, [], "text", "doc_id").collect()] == [0.0, 0.0]
    assert toxicity.toxicity(docs.filter("doc_id < 0"), [], "text", "doc_id").count() == 0


def test_risk_stays_at_zero_or_more():
    rng = np.random.default_rng(4)
    positive = [np.unique(rng.integers(0, 50, 5)) for _ in range(200)]
    other = [np.unique(rng.integers(0, 4000, 30)) for _ in range(2000)] + positive
    model = toxicity.fitted(positive, other, 200 / 2200)
    assert np.isfinite(model.weights).all() and model.bias < 0
