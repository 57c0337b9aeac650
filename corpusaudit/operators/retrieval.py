"""Retrieval of locators: what was known of one at a time, where redirects end, and what a document may use."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusaudit.session import materialise

#: What an attempt may end in besides ``retrieved``, ``redirected`` and a failure's own name.
NOT_ATTEMPTED, CYCLE = "not-attempted", "redirect-cycle"


def as_of(asked: DataFrame, log: DataFrame, key: str, when: str, at: str, slot: int, *values: str) -> DataFrame:
    """``asked`` (key, when, ...) with ``values`` of the last row of ``log`` for the key at or before ``when``.

    Times are whole numbers. A key is looked at in slots of ``slot`` of them: within a slot the rows of
    both sides are put into one order, and the last row of each slot is carried on to later ones, so that
    a key with a great part of all rows is dealt over its slots. Of rows of one key and time the greatest
    by ``values`` counts. Rows of ``asked`` without an earlier row have nulls, as have null keys and times;
    rows of ``asked`` that are alike stay apart.
    """
    known = F.struct(*(F.col(f"`{v}`") for v in values))
    # One row a key and time, and one question however often it is asked.
    rows = log.filter(F.col(at).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(at).alias("_t")).agg(F.max(known).alias("_v"))
    questions = asked.select(F.col(key).alias("_key"), F.col(when).alias("_t")).dropna().distinct()
    of = F.floor(F.col("_t") / slot)
    merged = rows.select("_key", "_t", F.lit(0).alias("_asks"), "_v").unionByName(
        questions.select("_key", "_t", F.lit(1).alias("_asks"), F.lit(None).cast(rows.schema["_v"].dataType).alias("_v"))
    ).withColumn("_slot", of)
    inside = Window.partitionBy("_key", "_slot").orderBy("_t", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    here = merged.withColumn("_v", F.last("_v", ignorenulls=True).over(inside))
    ends = merged.groupBy("_key", "_slot").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_t"))).alias("_end"))
    before = Window.partitionBy("_key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    answers = (
        here.filter("_asks = 1").join(carried, ["_key", "_slot"])
        .select(F.col("_key"), F.col("_t"), F.coalesce("_v", "_carried").alias("_v"))
    )
    joined = asked.join(answers, (asked[key] == answers["_key"]) & (asked[when] == answers["_t"]), "left")
    return joined.select(*(asked[c] for c in asked.columns), *(F.col("_v")[v].alias(v) for v in values))


def followed(steps: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(within, locator, final, hops, cyclic): where each redirecting locator leads in the end.

    ``steps`` (within, locator, target) has one row for each redirecting locator. Each round joins the
    table with itself, so paths double in length and a chain of n takes log n rounds. What is still on its
    way after more steps than there are locators runs in a circle: ``final`` is null there.
    """
    keys = list(within)
    now = materialise(
        steps.select(*keys, "locator", F.col("target").alias("final"), F.lit(1).cast("long").alias("hops"), F.lit(True).alias("moving"))
    )
    n = now.count()
    for _ in range(max(1, math.ceil(math.log2(n + 1)) + 1) if n else 0):
        jump = now.select(*keys, F.col("locator").alias("final"), F.col("final").alias("_to"), F.col("hops").alias("_more"), F.lit(True).alias("_on"))
        moved = now.filter("moving").join(jump, [*keys, "final"], "left").select(
            *keys,
            "locator",
            F.coalesce("_to", "final").alias("final"),
            (F.col("hops") + F.coalesce("_more", F.lit(0).cast("long"))).alias("hops"),
            F.coalesce("_on", F.lit(False)).alias("moving"),
        )
        now = materialise(now.filter("NOT moving").unionByName(moved))
        if not now.filter("moving").limit(1).count():
            break
    return now.select(
        *keys,
        "locator",
        F.when(~F.col("moving"), F.col("final")).alias("final"),
        F.when(~F.col("moving"), F.col("hops")).alias("hops"),
        F.col("moving").alias("cyclic"),
    )


def _reached(asked: DataFrame, log: DataFrame, slot: int) -> DataFrame:
    """(when, locator, outcome, target) of every locator asked for and all that redirects lead to from there."""
    frontier = materialise(asked.select("when", "locator").dropna().distinct())
    seen, told = frontier, None
    while True:
        now = materialise(as_of(frontier, log, "locator", "when", "at", slot, "outcome", "target"))
        told = now if told is None else told.unionByName(now)
        ahead = now.filter("outcome = 'redirected' AND target IS NOT NULL").select("when", F.col("target").alias("locator"))
        # Who was seen before is not asked again, so that circles end here too.
        frontier = materialise(ahead.distinct().join(seen, ["when", "locator"], "left_anti"))
        if not frontier.limit(1).count():
            return told
        seen = seen.unionByName(frontier)


def outcomes(asked: DataFrame, log: DataFrame, slot: int = 1 << 16) -> DataFrame:
    """(when, locator, final, hops, outcome) of each locator and time that ``asked`` (locator, when) names.

    ``log`` has locator, at, outcome and target. The last attempt at or before the time counts, of the
    locator itself and of every one that redirects lead to; an outcome of ``redirected`` goes on at its
    target. A locator nobody had tried by then is ``not-attempted``, one whose redirects run in a circle a
    ``redirect-cycle``, one that redirects to nowhere stays ``redirected``. Null locators and times are left out.
    """
    told = materialise(_reached(asked, log, slot))
    steps = told.filter("outcome = 'redirected' AND target IS NOT NULL").select("when", "locator", "target")
    ends = followed(steps, ("when",))
    round_about = F.coalesce("cyclic", F.lit(False))
    found = asked.select("when", "locator").dropna().distinct().join(ends, ["when", "locator"], "left")
    found = found.withColumn("final", F.when(~round_about, F.coalesce("final", "locator")))
    last = told.select("when", F.col("locator").alias("final"), "outcome")
    said = F.when(round_about, F.lit(CYCLE)).otherwise(F.coalesce("outcome", F.lit(NOT_ATTEMPTED)))
    return found.join(last, ["when", "final"], "left").select(
        "when", "locator", "final", F.coalesce("hops", F.lit(0).cast("long")).alias("hops"), said.alias("outcome")
    )


def retrieval_status(references: DataFrame, tried: DataFrame) -> DataFrame:
    """(doc_id, retrieved, boundary): all locators of a document must have been retrieved.

    ``references`` holds doc_id, locator, when, ord; ``tried`` is ``outcomes``. The first failure in order
    names the boundary.
    """
    found = references.join(tried.select("when", "locator", "outcome"), ["when", "locator"], "left").withColumn(
        "outcome", F.coalesce("outcome", F.lit(NOT_ATTEMPTED))
    )
    bad = F.col("outcome") != "retrieved"
    return found.groupBy("doc_id").agg(
        (~F.bool_or(bad)).alias("retrieved"),
        F.min_by("outcome", F.when(bad, F.col("ord"))).alias("boundary"),
    )
