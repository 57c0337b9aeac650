import hashlib
import random

import numpy as np
import pytest

from corpusaudit.llm import suffixes


@pytest.mark.parametrize("letters", ["ab", "abcd", "a", "abcdefghijklmnop"])
def test_suffix_array_equals_sorting(letters):
    rng = random.Random(len(letters))
    for n in [0, 1, 2, 3, 10, 200, 1500]:
        s = [ord(rng.choice(letters)) for _ in range(n)]
        if n > 500:
            s[200:400] = s[0:200]
        t = np.array([*s, 0])
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert suffixes.suffix_array(t, 256).tolist() == want


def test_earliest_equals_brute_force():
    rng = random.Random(8)
    base = bytes(rng.choice(b"abc ") for _ in range(200))
    strings = list({base[i : i + rng.randint(3, 60)] for i in range(0, 150, 3)} | {b"a" * 30, b"a" * 31})
    owners = np.array([rng.randrange(100) for _ in strings])
    offsets, got = suffixes.earliest(strings, owners, 10)
    first = {}
    for s, o in zip(strings, owners):
        for i in range(len(s) - 9):
            first[s[i : i + 10]] = min(first.get(s[i : i + 10], 999), o)
    for k, s in enumerate(strings):
        assert got[offsets[k] : offsets[k + 1]].tolist() == [first[s[i : i + 10]] for i in range(len(s) - 9)]


def rows_of(rng):
    def words(n):
        return " ".join("".join(rng.choices("abcdefgé", k=rng.randint(1, 8))) for _ in range(n))

    passage, long = words(40), words(400)
    rows = []
    for i in range(60):
        kind = i % 6
        text = words(rng.randint(0, 120))
        if kind == 1:
            text += " " + passage + " " + words(5)
        elif kind == 2:
            text = long[: rng.randint(100, 1500)] + "|" + long[rng.randint(0, 1000) :]
        elif kind == 3:
            text = long
        elif kind == 4:
            text = "ab" * rng.randint(0, 200) + "x" * rng.randint(0, 120) + words(3)
        rows.append((1000 - 7 * i, text))
    return [*rows, (5000, ""), (5001, None), (5002, passage[:49]), (5003, passage[:50]), (4000, "z" * 30_000), (4001, "z" * 70)]


def digest(rows):
    return [
        (
            r.doc_id,
            r.n_bytes,
            sum(s.stop - s.start for s in r.spans),
            len(r.spans),
            hashlib.sha256(bytes(r.kept)).hexdigest(),
        )
        for r in rows
    ]


def test_repeats_equal_brute_force(spark):
    rows = rows_of(random.Random(3))
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, part int")
    got = digest(suffixes.repeats(docs, 50).collect())
    want = suffixes.brute([(k, (t or "").encode()) for k, t in rows], 50)
    assert sorted(got) == sorted(want)


def test_repeated_rows_and_null_keys(spark):
    text = "the same passage of some length, long enough to be looked at " * 2
    rows = [(1, text), (1, text), (2, text), (2, text), (None, text), (3, "x" + text), (3, text[5:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), bytes(r.kept).decode()) for r in suffixes.repeats(docs, 50).collect())
    assert got == sorted([("1", text), ("1", text), ("2", ""), ("2", ""), ("None", text), ("3", "x"), ("3", "")])


def test_empty_table(spark):
    assert suffixes.repeats(spark.createDataFrame([], "doc_id long, text string"), 50).count() == 0


def stock_phrases(rng, n, phrase):
    """Texts that hold one phrase between neighbours of their own."""
    def own(k):
        return "".join(rng.choices("abcdefghijklmnop ", k=k))

    return [(3 * (k * 37 % n), own(60) + phrase + own(60)) for k in range(n)]


@pytest.mark.parametrize("length", [30, 45, 60, 120])
def test_hot_anchors_equal_brute_force(spark, length):
    rng = random.Random(length)
    phrase = "".join(rng.choices("QRSTUVWXYZ", k=length))
    rows = rows_of(rng) + [(k + 20_000, t) for k, t in stock_phrases(rng, 120, phrase)]
    rows += [(k + 30_000, t[20:]) for k, t in rows[-30:]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(suffixes.brute([(k, (t or "").encode()) for k, t in rows], 50))
    for hot in (0, 5, suffixes.HOT):
        assert sorted(digest(suffixes.repeats(docs, 50, hot=hot).collect())) == want


def test_surroundings_of_one_anchor_are_dealt_to_all_shards(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame(stock_phrases(rng, 3000, "".join(rng.choices("QRSTUVWXYZ", k=40))), "doc_id long, text string")
    # The phrase alone has a few anchors; their surroundings are all different.
    for hot, even in ((100, True), (suffixes.HOT, False)):
        _, prints, places = suffixes._steps(docs, 50, "doc_id", "text", (), hot)
        for frame, column in ((prints, "prints"), (places, "context")):
            shards = [r[0] for r in frame.groupBy("shard").agg({column: "count"}).selectExpr("shard").collect()]
            sums = [r.n for r in frame.selectExpr("shard", f"length({column}) AS n").groupBy("shard").sum("n").toDF("shard", "n").collect()]
            assert (len(shards) == 8 and max(sums) < 1.5 * sum(sums) / 8) == even


def test_suffix_arrays_take_whole_buckets():
    bucket, sizes = np.array([1, 1, 2, 3, 3, 3, 4]), np.array([5, 5, 4, 30, 30, 30, 2])
    assert suffixes._cuts(bucket, sizes, 14) == [(0, 3), (3, 6), (6, 7)]
    assert suffixes._cuts(bucket[:0], sizes[:0], 14) == []


def test_a_worker_holds_less_than_a_task_of_texts(spark):
    docs = spark.createDataFrame(stock_phrases(random.Random(11), 3000, "QRSTUVWXYZ" * 4), "doc_id long, text string")
    parts = suffixes._steps(docs, 50, "doc_id", "text", (), suffixes.HOT)[1].select("part").distinct().count()
    assert parts == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
