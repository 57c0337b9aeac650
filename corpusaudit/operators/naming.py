"""Artifact names that never let two different books share one."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions.names import ARTIFACT_SUFFIX, portable_base, suffixed_base
from corpusaudit.session import materialise


def assign_names(artifacts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Add ``name`` and ``action`` (publish, reuse, refuse) to every (ord, title, digest) row.

    The first digest that asks for a base name holds it; other digests take the base and 12 hex
    of their own. Equal bytes reuse what is there. A suffixed name that different bytes hold is
    refused. ``existing`` holds (name, digest) of what is already published.

    Holders are folded to one row per name before they meet the artifacts: a name a third of
    the corpus asks for is one row on the small side of the join, and its many rows on the other
    side may be split between tasks. The asked-for names are kept as a table, as titles and
    digests may have been read out of whole texts.
    """
    based = artifacts.withColumn("_base", portable_base(F.col("title"))).withColumn(
        "_plain", F.concat("_base", F.lit(ARTIFACT_SUFFIX))
    )
    asked = materialise(
        based.withColumn(
            "_suffixed",
            F.concat(suffixed_base(F.col("_base"), F.col("digest")), F.lit(ARTIFACT_SUFFIX)),
        ).drop("_base")
    )
    held = _holders(asked, "_plain", existing)
    placed = asked.join(held.toDF("_plain", "_holder", "_first"), "_plain", "left")
    own = F.col("_holder") == F.col("digest")
    contested = placed.withColumn("_own", own)
    second = _holders(contested.filter(~F.col("_own")), "_suffixed", existing)
    placed = contested.join(
        second.toDF("_suffixed", "_holder2", "_first2"),
        "_suffixed",
        "left",
    )
    own2 = F.col("_holder2") == F.col("digest")
    fresh = F.when(F.col("_own"), F.col("_first") == F.col("ord")).otherwise(
        F.col("_first2") == F.col("ord")
    )
    return placed.select(
        *artifacts.columns,
        F.when(F.col("_own"), F.col("_plain")).otherwise(F.col("_suffixed")).alias("name"),
        F.when(~F.col("_own") & ~own2, F.lit("refuse"))
        .when(F.coalesce(fresh, F.lit(False)), F.lit("publish"))
        .otherwise(F.lit("reuse"))
        .alias("action"),
    )


def _holders(asked: DataFrame, name: str, existing: DataFrame | None) -> DataFrame:
    """(name, digest, ord): who holds each name; ord is NULL where it was published before."""
    claims = asked.select(F.col(name).alias("n"), "digest", "ord", F.lit(1).alias("late"))
    if existing is not None:
        before = existing.select(
            F.col("name").alias("n"),
            "digest",
            F.lit(None).cast("bigint").alias("ord"),
            F.lit(0).alias("late"),
        )
        claims = claims.unionByName(before)
    first = F.min_by(F.struct("digest", "ord"), F.struct("late", "ord"))
    return claims.groupBy("n").agg(first.alias("_h")).select("n", "_h.digest", "_h.ord")
