import random
from collections import defaultdict

import numpy as np
import pytest

from corpusaudit.llm import jaccard
from corpusaudit.llm.components import components


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, threshold):
    sets = {}
    for k, t in rows:
        if k is not None and shingles(t):
            sets.setdefault(shingles(t), []).append(k)
    keys = list(sets)
    links, root = defaultdict(int), {s: s for s in keys}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(a & b) >= threshold * len(a | b):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = defaultdict(lambda: 10**9)
    for s in keys:
        least[find(s)] = min([least[find(s)], *sets[s]])
    out = []
    for k, t in rows:
        s = shingles(t)
        if k is None or not s:
            out.append((k, k, k, 1, 0))
        else:
            out.append((k, least[find(s)], min(sets[s]), len(sets[s]), links[s]))
    return out


def corpus(rng, groups, size):
    def words(n):
        return ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n)]

    passage = words(30)
    rows, k = [], 0
    for g in range(groups):
        base = words(rng.randint(40, 200))
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "zz" + str(rng.randrange(10**6))
            if g % 3 == 0:
                w = w + passage
            rows.append((k, " ".join(w)))
            k += 1
    return rows


def check(spark, rows, slack=0):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class_id int")
    got = sorted((tuple(r) for r in jaccard.near_duplicates(docs, 0.8).collect()), key=str)
    want = sorted(brute(rows, 0.8), key=str)
    assert len(got) == len(want)
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= slack
    return docs


def test_links_and_classes_equal_brute_force(spark):
    rows = corpus(random.Random(4), 60, 6)
    rows += [(900 + i, rows[0][1].upper()) for i in range(5)]
    rows += [(950, None), (951, ""), (952, " \n"), (953, "three words only"), (954, "Three  words only"), (955, "three words"), (None, rows[1][1])]
    rows += [rows[3], rows[3]]
    rows += [(956, "long " * 20_000), (957, " ".join(map(str, range(9000))))]
    docs = check(spark, rows, slack=2)
    kept = jaccard.one_of_each(docs, 0.8)
    assert kept.columns == docs.columns
    want = sorted({str(c) for _, c, *_ in brute(rows, 0.8)})
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_groups_over_a_bucket_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    check(spark, corpus(random.Random(6), 4, 60), slack=3)


def test_recall_near_the_threshold():
    assert jaccard.runs_for(0.99) <= 12
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(400):
        base = rng.integers(0, 1 << 62, 360, dtype=np.uint64)
        sets += [np.unique(base[:320]), np.unique(base[40:])]  # Jaccard 0.78 to 0.8
    s = jaccard.sketches(sets)
    agree = (s[0::2] == s[1::2]).mean()
    assert abs(agree - 280 / 360) < 0.02


def test_repeated_keys_with_other_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "a b c d e f g"), (3, "h i j k l m n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.near_duplicates(docs, 0.8).collect())
    assert got == [(1, 1, 1, 2, 0), (1, 1, 1, 2, 0), (2, 1, 1, 2, 0), (3, 1, 1, 2, 0)]
    assert sorted(r.text for r in jaccard.one_of_each(docs, 0.8).collect()) == ["a b c d e f g", "h i j k l m n"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(docs, 0.8).count() == 0
    assert jaccard.one_of_each(docs, 0.8).count() == 0


@pytest.mark.parametrize("n", [50])
def test_components_of_chains_and_stars(spark, n):
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, n)] + [(2000, 2001), (2001, 2000), (5, 5)]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and all(got[1000 + i] == 1000 for i in range(n)) and got[2001] == 2000


def made_words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(n)]


def test_recall_of_isolated_pairs_near_the_threshold(spark):
    """Pairs at Jaccard 0.811: 86 of 96 shingles are shared. The join is run, nothing is estimated."""
    rng = random.Random(12)
    rows = []
    for i in range(400):
        first = made_words(rng, 100)
        rows += [(2 * i, " ".join(first)), (2 * i + 1, " ".join(first[:90] + made_words(rng, 10)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.near_duplicates(docs, 0.8).collect()
    assert all(r.class_id in (r.doc_id, r.doc_id - r.doc_id % 2) for r in got)
    found = sum(r.n_links for r in got) / 2
    assert found >= 0.99 * 400


def test_links_of_a_group_larger_than_a_bucket(spark):
    """Every two of 700 texts differ in two words and share at least 0.811 of their shingles: all are linked."""
    rng = random.Random(13)
    base = made_words(rng, 100)
    rows = []
    for i in range(700):
        at = rng.randrange(5, 95)
        rows.append((i, " ".join([*base[:at], *made_words(rng, 1), *base[at + 1 :]])))
    sets = [shingles(t) for _, t in rows]
    least = min(len(a & b) / len(a | b) for a, b in zip(sets, sets[1:], strict=False))
    assert 0.8 <= least < 0.83 and 700 > jaccard.BUCKET
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).collect()
    assert {r.class_id for r in got} == {0}
    assert sum(r.n_links for r in got) >= 0.999 * 700 * 699
