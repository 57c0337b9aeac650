"""Scores of fitted models, once more by plain loops."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusaudit.llm import language, maxent, toxicity
from test_language import rows_of
from test_maxent import tokens


def test_entropy_scores_are_a_softmax_of_classes_times_a_share(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("wal", "tal", "run", "sit") for b in ("ks", "ked", "ning", "s")]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(60)] + [(60, None), (61, "NEW wordS here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    used = []
    trained = maxent.trained
    monkeypatch.setattr(maxent, "trained", lambda *a, **k: used.append(trained(*a, **k)) or used[-1])
    got = {r.doc_id: r.score for r in maxent.scored(docs, F.col("doc_id") % 7 == 2).collect()}
    model = used[-1]

    def ending(word):
        if word is None:
            return maxent.END
        return int(maxent.Tokens(pa.array([word])).ending[0])

    counts = Counter(w for i, t in rows if i % 7 != 2 for w in tokens(t))
    in_class = Counter()
    for w, n in counts.items():
        in_class[int(model.classes[ending(w)])] += n + 1
    for i, text in rows:
        score, one, two = 0.0, maxent.START, maxent.START
        for w in tokens(text):
            pair = int(model.classes[one]) * (maxent.CLASSES + 1) + int(model.classes[two])
            active = [model.weights[one], model.weights[maxent.ROWS + two], model.weights[2 * maxent.ROWS + pair]]
            sums = [float(sum(x[c] for x in active)) for c in range(maxent.CLASSES)]
            mine = int(model.classes[ending(w)])
            chance = math.exp(sums[mine]) / sum(map(math.exp, sums))
            score += math.log10(chance) + math.log10((counts[w] + 1) / (in_class[mine] + 1))
            one, two = ending(w), one
        assert got[i] == pytest.approx(score, abs=1e-3)


def plain_vote(names, machines, x):
    """(name, least chance): a vote for each pair, ties to the larger sum of chances."""
    votes, least, chances = Counter(), {n: 1.0 for n in names}, Counter()
    for a, b in itertools.combinations(names, 2):
        (m,) = [m for m in machines if {m.yes, m.no} == {a, b}]
        margin = m.bias + sum(float(p) * float(q) for p, q in zip(m.weights, x, strict=True) if q)
        p = 1 / (1 + math.exp(-m.scale * margin))
        for name, chance in ((m.yes, p), (m.no, 1 - p)):
            votes[name] += chance > 0.5
            chances[name] += chance
            least[name] = min(least[name], chance)
    won = max(names, key=lambda n: (votes[n], chances[n]))
    return won, least[won]


def test_languages_are_voted_family_first(spark):
    rows = rows_of(random.Random(9), 160)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.fit(docs)
    some = [r[1] for r in rows[:12]] + ["der the", "éa", "12 x"]
    labels, scores = language.predicted(pa.array(some), model)
    for text, label, score in zip(some, labels, scores, strict=True):
        body = np.frombuffer(text.encode(), np.uint8)
        (x,) = language.features(body, np.array([0, len(body)]))
        family, sure = plain_vote(sorted(model.members), model.between, x)
        name, within = plain_vote(model.members[family], model.inside[family], x)
        assert label == name and score == pytest.approx(min(sure, within), abs=1e-4)


def plain_risk(classifier, positive, unlabelled, prior):
    """The class-prior-corrected risk, its part for negatives not under zero."""
    def chance(words):
        return 1 / (1 + math.exp(-(classifier.bias + sum(float(classifier.weights[w]) for w in words))))

    missed = sum(1 - chance(p) for p in positive) / len(positive)
    wrong_p = sum(chance(p) for p in positive) / len(positive)
    wrong_u = sum(chance(u) for u in unlabelled) / len(unlabelled)
    return prior * missed + max(0.0, wrong_u - prior * wrong_p)


def test_the_classifier_lowers_the_corrected_risk():
    rng = random.Random(4)
    clean, bad = list(range(100, 160)), list(range(200, 206))
    text = lambda toxic: np.unique(rng.choices(clean, k=20) + (rng.choices(bad, k=4) if toxic else []))
    positive = [text(True) for _ in range(80)]
    unlabelled = [text(i % 5 == 0) for i in range(400)]
    prior = 0.2
    got = toxicity.fitted(positive, unlabelled, prior)
    none = toxicity.Classifier(np.zeros(toxicity.BUCKETS, np.float32), math.log(prior / (1 - prior)))
    assert plain_risk(got, positive, unlabelled, prior) < 0.1 < plain_risk(none, positive, unlabelled, prior)
    # Nearby weights are no better by more than a step: the fit stands at a low place of the risk.
    for w in bad[:3]:
        for change in (0.5, -0.5):
            near = toxicity.Classifier(got.weights.copy(), got.bias)
            near.weights[w] += change
            assert plain_risk(near, positive, unlabelled, prior) > plain_risk(got, positive, unlabelled, prior) - 0.01


def test_toxic_scores_are_means_of_plain_sums(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["good", "day", "tide", "sea"], k=12)) + (" vile scum" if i % 4 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")).filter("doc_id < 200")
    model = toxicity.fit(docs, labels)
    texts = [t for _, t in rows[:8]] + ["", None, "vile vile VILE day"]
    got = toxicity.scores(pa.array(texts), model)
    for text, score in zip(texts, got, strict=True):
        _, buckets = toxicity.word_buckets(pa.array([text or ""]))
        each = [1 / (1 + math.exp(-(c.bias + sum(float(c.weights[b]) for b in set(buckets.tolist()))))) for c in model]
        assert score == pytest.approx(sum(each) / len(each), abs=1e-5)


def test_no_documents_and_no_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) == []
    assert toxicity.toxicity(docs, [], "text", "doc_id").collect() == []
