import random

from corpusaudit.operators import retrieval as R


def plain_as_of(log, key, when):
    held = [(t, o) for k, t, o in log if k == key and t is not None and when is not None and t <= when and key is not None]
    last = max((t for t, _ in held), default=None)
    return max((o for t, o in held if t == last), default=None)


def test_as_of_equals_looking_at_every_row(spark):
    rng = random.Random(8)
    log = [("hot" if rng.random() < 0.4 else rng.choice("abc"), rng.choice([None, *range(-5, 60)]), rng.choice("uvw")) for _ in range(400)]
    log += [(None, 3, "u")]
    asked = [(i, rng.choice(["hot", "a", "b", "z", None]), rng.choice([None, *range(-9, 70)])) for i in range(150)]
    asked += [asked[0], asked[0]]
    a = spark.createDataFrame(asked, "n int, k string, t long")
    b = spark.createDataFrame(log, "k string, t long, o string")
    for slot in (1, 7, 1000):
        got = [(r.n, r.k, r.t, r.o) for r in R.as_of(a, b, "k", "t", "t", slot, "o").collect()]
        assert sorted(got, key=str) == sorted(((n, k, t, plain_as_of(log, k, t)) for n, k, t in asked), key=str)


def test_chains_and_circles(spark):
    steps = [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("x", "y"), ("y", "z"), ("z", "x"), ("into", "x"), ("self", "self")]
    got = {r.locator: (r.final, r.hops, r.cyclic) for r in R.followed(spark.createDataFrame(steps, "locator string, target string")).collect()}
    assert all(got[f"c{i}"] == ("c40", 40 - i, False) for i in range(40))
    assert all(got[k] == (None, None, True) for k in ("x", "y", "z", "into", "self"))
    none = spark.createDataFrame([], "locator string, target string")
    assert R.followed(none).collect() == []


def test_outcomes_follow_the_log_as_it_was(spark):
    log = spark.createDataFrame(
        [
            ("a", 1, "http-error", None), ("a", 5, "retrieved", None), ("b", 1, "redirected", "a"), ("c", 2, "redirected", "b"),
            ("d", 1, "redirected", "e"), ("e", 1, "redirected", "d"), ("e", 4, "retrieved", None), ("f", 1, "redirected", None),
        ],
        "locator string, at long, outcome string, target string",
    )
    asked = spark.createDataFrame(
        [(k, t) for k in "abcdefg" for t in (0, 3, 9)] + [("a", None), (None, 3), ("a", 3)], "locator string, when long"
    )
    got = {(r.locator, r.when): (r.final, r.outcome) for r in R.outcomes(asked, log, 2).collect()}
    assert len(got) == 21
    assert [got["a", t] for t in (0, 3, 9)] == [("a", "not-attempted"), ("a", "http-error"), ("a", "retrieved")]
    assert [got["c", t] for t in (0, 3, 9)] == [("c", "not-attempted"), ("a", "http-error"), ("a", "retrieved")]
    assert got["d", 3] == (None, "redirect-cycle") and got["d", 9] == ("e", "retrieved")
    assert got["f", 9] == ("f", "redirected") and got["g", 9] == ("g", "not-attempted")
    refs = spark.createDataFrame([(1, "a", 9, 1), (1, "b", 9, 2), (2, "d", 3, 2), (2, "a", 3, 1), (3, "q", 3, 1)], "doc_id long, locator string, when long, ord int")
    told = {r.doc_id: (r.retrieved, r.boundary) for r in R.retrieval_status(refs, R.outcomes(asked, log, 2)).collect()}
    assert told == {1: (True, None), 2: (False, "http-error"), 3: (False, "not-attempted")}
