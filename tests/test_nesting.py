import random
import time

import pytest
from pyspark.sql import functions as F

from corpusaudit.operators.nesting import innermost


def nested(rng, start, stop, out, chance=0.6):
    """Random holders that nest within start..stop."""
    at = start
    while at < stop:
        if rng.random() < chance:
            end = rng.randint(at, stop)
            out.append((at, end))
            nested(rng, at + 1, end, out, chance * 0.8)
            at = end + 1
        else:
            at += 1
    return out


@pytest.mark.parametrize("own", [True, False])
def test_equals_looking_at_every_holder(spark, own):
    rng = random.Random(5)
    holders = {d: nested(rng, 0, 60, []) for d in range(6)}
    nodes = [(d, n, rng.choice("ab")) for d in range(8) for n in range(62) for _ in range(rng.choice([1, 1, 2]))]
    nodes += [(None, 3, "x"), (0, None, "y")]
    table = spark.createDataFrame(nodes, "doc_id long, node int, text string")
    held = spark.createDataFrame([(d, a, b, "h") for d, hs in holders.items() for a, b in hs] + [(None, 0, 9, "n"), (0, None, 3, "n")], "doc_id long, node int, end_node int, text string")
    got = innermost(table, held, "holder", own=own)
    assert got.columns == ["doc_id", "node", "text", "holder"]

    def around(d, n):
        if d is None or n is None:
            return None
        mine = [a for a, b in holders.get(d, []) if (a <= n if own else a < n) and n <= b]
        return max(mine, default=None)

    assert sorted(map(tuple, got.collect()), key=str) == sorted(((d, n, t, around(d, n)) for d, n, t in nodes), key=str)


def test_parents_of_holders(spark):
    held = spark.createDataFrame([(1, 0, 9), (1, 2, 5), (1, 3, 3), (1, 7, 9), (1, 12, 12)], "doc_id long, node int, end_node int")
    got = {r.node: r.outer for r in innermost(held, held, "outer", own=False).collect()}
    assert got == {0: None, 2: 0, 3: 2, 7: 0, 12: None}


def test_ten_thousand_holders_deep(spark):
    """Work follows rows, not rows times depth: ten times the nodes take about ten times as long at most."""
    deep = 10_000
    held = spark.range(deep).select(F.lit(1).alias("doc_id"), F.col("id").alias("node"), (F.lit(10**6) - F.col("id")).alias("end_node"))
    took = []
    for n in (100_000, 1_000_000):
        nodes = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") * (10**6 // n)).alias("node"))
        begin = time.time()
        got = innermost(nodes, held, "holder")
        far = got.agg(F.count("*"), F.max("holder"), F.count_if(F.col("holder") == F.least("node", F.lit(10**6) - F.col("node"))).alias("edge")).first()
        took.append(time.time() - begin)
        assert far[0] == n and far[1] == deep - 1
        assert far["edge"] >= 2 * (deep - 1) * n // 10**6 - 2
    assert took[1] < 10 * took[0] + 10


def test_no_holders_and_no_nodes(spark):
    nodes = spark.createDataFrame([(1, 2)], "doc_id long, node int")
    none = spark.createDataFrame([], "doc_id long, node int, end_node int")
    assert [r.h for r in innermost(nodes, none, "h").collect()] == [None]
    assert innermost(nodes.limit(0), none, "h").collect() == []
