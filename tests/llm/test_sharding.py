import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusaudit.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 97, 1000, 4099])
def test_permutation_is_whole(spark, n):
    df = spark.range(n).select(sharding.permuted(F.col("id"), n, 5).alias("p"))
    assert sorted(r.p for r in df.collect()) == list(range(n))


def test_walk_bound_stays_small():
    for n in (10**6 + 3, 10**9 + 7, 10**12 + 39):
        a, b, walks = sharding.halves(n)
        assert a * b >= n and walks <= 64 and max(a, b) < sharding.PRIME


def test_laws_and_edge_rows(spark):
    rows = [(i, f"text {i % 50}", "law") for i in range(530)] + [(None, None, "x"), (None, "", "x"), (3, "text 3", "y")]
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, law string")
    got = sharding.shard_rows(docs, 16).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(r.law == "rows" and r.grown_shard is None for r in got)
    seven = next(r for r in got if r.doc_id == 7)
    assert (seven.size, seven.text_crc32) == (7, zlib.crc32(b"text 7"))
    again = sharding.shard_rows(docs.repartition(5), 16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty_table(spark):
    assert sharding.shard_rows(spark.createDataFrame([], "doc_id long, text string"), 16).count() == 0
