"""Reproducible shuffling into shards by a permutation of global row numbers."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusaudit.session import materialise

ROUNDS = 6
#: A prime under 2^31: squares of rests fit in 64 bits.
PRIME = 2147483647


def halves(n: int) -> tuple[int, int, int]:
    """Sides a, b of the Feistel network for n rows, and how often a walk may have to go on.

    a * b is n or a little more. Values from n on are walked over, and a walk meets each of them
    once at most, so a * b - n + 1 applications always end in 0 .. n - 1. Sides near the root of n
    are searched for the smallest excess, so that this bound is a handful at any size.
    """
    root = max(1, math.isqrt(max(n - 1, 0)) + 1)
    low = max(1, root // 2)
    best = min(range(low, min(2 * root, low + 200_000) + 1), key=lambda a: (-n % a, abs(a - root)))
    b = -(-n // best) if n else 1
    return best, b, best * b - n + 1


def constants(seed: int) -> list[tuple[int, int]]:
    """Two constants for each round, from the seed alone."""
    out, x = [], (seed * 48271 + 11) % PRIME
    for _ in range(ROUNDS):
        x = (x * 48271 + 12345) % PRIME
        y = (x * 69621 + 54321) % PRIME
        out.append((x, y))
        x = y
    return out


def permuted(number: Column, n: int, seed: int) -> Column:
    """Where the permutation of 0 .. n - 1 puts a row number: a Feistel network, cycle-walked."""
    a, b, walks = halves(n)
    keys = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(i % 2 == 0).alias("even")) for i, (x, y) in enumerate(constants(seed))])

    def mixed(value: Column, key: Column) -> Column:
        x = (value + key["x"]) % PRIME
        return ((x * x) % PRIME * ((x + key["y"]) % PRIME)) % PRIME

    def round_(state: Column, key: Column) -> Column:
        left = F.when(key["even"], (state["l"] + mixed(state["r"], key)) % a).otherwise(state["l"])
        right = F.when(key["even"], state["r"]).otherwise((state["r"] + mixed(state["l"], key)) % b)
        return F.struct(left.alias("l"), right.alias("r"))

    def once(value: Column) -> Column:
        start = F.struct((value % a).alias("l"), F.floor(value / a).cast("long").alias("r"))
        return F.reduce(keys, start, round_, lambda s: s["r"] * a + s["l"])

    if walks == 1:
        return once(number)
    # The first application is unconditional: only values that left 0 .. n - 1 walk on.
    return F.reduce(
        F.sequence(F.lit(2), F.lit(walks)), once(number), lambda v, _: F.when(v < n, v).otherwise(once(v))
    )


def numbered(rows: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """Rows with their global number from 0, and how many there are.

    Spark sorts by range over all tasks; a row's number is its place in its part plus the rows of
    all parts before it. Only one figure for each part is gathered.
    """
    placed = materialise(rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    n = placed.count()
    # One row for each part of the sort: as many as shuffle partitions, whatever the input holds.
    out = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    number = F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn("number", number).drop("_part", "_place", "_start"), n


def shard_rows(docs: DataFrame, shards: int, seed: int = 17, key="doc_id", text="text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard): every row gets its place in a shard.

    Law ``rows``: the counts of the shards are at most one apart. Rows are numbered in the order of
    key, CRC and size, a Feistel network with cycle walking permutes the numbers, and number p goes
    to slot p // shards of shard p % shards. Anyone who has a row's number can compute its place.

    Equal texts are not kept together: the law deals rows. Null texts have size 1 and the CRC of
    nothing; null keys come first; rows equal in key, CRC and size get neighbouring numbers, in
    either order; an empty table gives an empty one; other columns are left out.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    placed, n = numbered(rows, F.col(key).asc_nulls_first(), F.col("text_crc32"), F.col("size"))
    place = permuted(F.col("number"), max(n, 1), seed)
    return placed.select(key, "size", "text_crc32", "number", place.alias("place")).select(
        key,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
