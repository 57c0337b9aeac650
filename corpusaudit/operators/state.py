"""Corpus state: which sources are new, changed or done, and which evidence is damaged.

Tables
  candidates  path, sha256                        one row per source
  evidence    bundle, source, source_sha256, artifact, artifact_sha256
  artifacts   path, sha256                        what is stored now; NULL sha256 = unreadable
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key. A partial aggregate: a hot key never meets in one task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in the given order."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def reconcile_inboxes(seen: DataFrame) -> DataFrame:
    """One candidate per path, owned by the first inbox in order, with every inbox that sees it.

    ``seen`` holds inbox, inbox_ord, path and whatever else describes the file. The list per
    path is a set of inbox names, so the number of configured inboxes bounds it.
    """
    rest = [c for c in seen.columns if c not in ("path", "inbox", "inbox_ord")]
    merged = seen.groupBy("path").agg(
        F.min_by(F.struct("inbox", "inbox_ord", *rest), F.struct("inbox_ord", "inbox")).alias("_r"),
        F.array_sort(F.collect_set(F.struct("inbox_ord", "inbox"))).alias("_all"),
    )
    return merged.select(
        "path", "_r.*", F.transform("_all", lambda e: e["inbox"]).alias("inboxes")
    )


def candidate_order(candidates: DataFrame) -> DataFrame:
    """Inbox position, then path."""
    return candidates.orderBy("inbox_ord", "path")


def inbox_coverage(files: DataFrame) -> DataFrame:
    """One row per inbox: supported and ignored files, the first error and the status.

    ``files`` holds inbox, ord, supported, error. A supported file that could not be read is in
    neither count.
    """
    bad = F.col("error").isNotNull()
    return (
        files.groupBy("inbox")
        .agg(
            F.count_if(F.col("supported") & ~bad).alias("supported_count"),
            F.count_if(~F.col("supported") & ~bad).alias("ignored_count"),
            F.min_by(F.col("error"), F.when(bad, F.col("ord"))).alias("error"),
        )
        .withColumn(
            "status",
            F.when(F.col("error").isNull(), F.lit("checked")).otherwise(F.lit("unavailable")),
        )
    )


def artifact_damage(evidence: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Evidence with ``damage``: artifact-missing, -unreadable, -mismatched, or NULL for sound."""
    stored = artifacts.select(
        F.col("path").alias("artifact"), F.col("sha256").alias("_now"), F.lit(True).alias("_there"), F.lit(0).alias("_salt")
    )
    # Rows that name no artifact find none; they are dealt out, not sent to one task by their NULL.
    name = F.coalesce("artifact", F.lit(""))
    salt = F.when(F.col("artifact").isNull(), 1 + F.pmod(F.xxhash64(*evidence.columns), F.lit(1 << 16)).cast("int")).otherwise(0)
    stored = stored.withColumnRenamed("artifact", "_name")
    return (
        evidence.withColumn("_name", name)
        .withColumn("_salt", salt)
        .join(stored, ["_name", "_salt"], "left")
        .drop("_name", "_salt")
        .withColumn(
            "damage",
            F.when(F.col("_there").isNull(), F.lit("artifact-missing"))
            .when(F.col("_now").isNull(), F.lit("artifact-unreadable"))
            .when(F.col("_now") != F.col("artifact_sha256"), F.lit("artifact-mismatched")),
        )
        .drop("_now", "_there")
    )


def derive_state(candidates: DataFrame, evidence: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Candidates with ``state`` (new, changed, already-ready) and ``damage``.

    The exact (path, digest) pair with a sound artifact is ready; the same path with another
    digest is changed; everything else is new. Identity is the path, never the bytes.

    Evidence is first folded to one row per pair and one per path, so a source with a long
    history never multiplies rows. "Another digest exists" needs only the smallest and largest
    digest of the path. Digests are compared only for pairs that matched.
    """
    exact = evidence.groupBy("source", "source_sha256").agg(
        F.min_by(F.struct("artifact", "artifact_sha256"), F.col("bundle")).alias("_e")
    )
    known = evidence.groupBy("source").agg(
        F.min("source_sha256").alias("_lo"), F.max("source_sha256").alias("_hi")
    )
    columns = candidates.columns
    matched = (
        candidates.join(
            exact.withColumnsRenamed({"source": "path", "source_sha256": "sha256"}),
            ["path", "sha256"],
            "left",
        )
        .select(*columns, "_e.artifact", "_e.artifact_sha256")
        .join(known.withColumnRenamed("source", "path"), "path", "left")
    )
    paired = F.col("artifact").isNotNull()
    looked_up = artifact_damage(matched, artifacts).withColumn(
        "damage", F.when(paired, F.col("damage"))
    )
    other = (F.col("_lo") != F.col("sha256")) | (F.col("_hi") != F.col("sha256"))
    return looked_up.withColumn(
        "state",
        F.when(paired & F.col("damage").isNull(), F.lit("already-ready"))
        .when(F.coalesce(other, F.lit(False)), F.lit("changed"))
        .otherwise(F.lit("new")),
    ).select(*columns, "state", "damage")


def with_latest_attempt(states: DataFrame, attempts: DataFrame) -> DataFrame:
    """Add the last refused attempt of each exact (path, digest): boundary and finished_at.

    An attempt stands beside the state and never changes it. ``attempts`` holds source,
    source_sha256, boundary, finished_at.
    """
    last = latest_per_key(
        attempts.filter(F.col("boundary").isNotNull()).select(
            F.col("source").alias("path"),
            F.col("source_sha256").alias("sha256"),
            "boundary",
            "finished_at",
        ),
        ["path", "sha256"],
        ["finished_at", "boundary"],
    )
    return states.join(last, ["path", "sha256"], "left")


def evidence_problems(reports: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(bundle, problem, artifact), one row per distinct problem.

    ``reports`` holds bundle, readable, source, source_url, source_sha256, artifact,
    artifact_sha256. A report of a page names a locator and no path; it is no damage.
    """
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    whole = ~(empty("source_sha256") | empty("artifact") | empty("artifact_sha256"))
    page = F.col("source").isNull() & ~empty("source_url")
    kept = reports.withColumn(
        "_own",
        F.when(~F.col("readable"), F.lit("unreadable-report"))
        .when(page, F.lit(None).cast("string"))
        .when(F.col("source").isNull() | ~whole, F.lit("incomplete-report")),
    )
    broken = kept.filter(F.col("_own").isNotNull()).select(
        "bundle", F.col("_own").alias("problem"), F.lit(None).cast("string").alias("artifact")
    )
    sound = kept.filter(F.col("_own").isNull() & ~page & F.col("readable"))
    damaged = (
        artifact_damage(sound.select("bundle", "artifact", "artifact_sha256"), artifacts)
        .filter(F.col("damage").isNotNull())
        .select("bundle", F.col("damage").alias("problem"), "artifact")
    )
    return broken.unionByName(damaged).dropDuplicates(["bundle", "problem"])


def problem_order(problems: DataFrame) -> DataFrame:
    return problems.orderBy("bundle", "problem")


def published_artifact(artifacts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Artifacts with the first bundle, in name order, that published them."""
    first = (
        evidence.groupBy("artifact")
        .agg(F.min_by(F.struct("bundle", "artifact_sha256"), F.col("bundle")).alias("_e"))
        .select(
            F.col("artifact").alias("path"),
            "_e.bundle",
            F.col("_e.artifact_sha256").alias("recorded_sha256"),
        )
    )
    return artifacts.join(first, "path", "left")


def hash_guard(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(path, status): unchanged, changed or missing between two snapshots of (path, sha256)."""
    now = observed.select("path", F.col("sha256").alias("observed"))
    return expected.join(now, "path", "left").select(
        "path",
        F.col("sha256").alias("expected"),
        "observed",
        F.when(F.col("observed").isNull(), F.lit("source-missing"))
        .when(F.col("observed") != F.col("sha256"), F.lit("source-changed"))
        .otherwise(F.lit("unchanged"))
        .alias("status"),
    )


def select_routine(candidates: DataFrame, coverage: DataFrame) -> DataFrame:
    """Candidates to prepare, with ``partial`` set where any inbox was not covered.

    A candidate must be new or changed and have a display name nobody else has. Names are
    counted together with the one candidate a single name can have, so no row joins back and a
    name half the corpus carries is folded before it is shuffled.
    """
    columns = candidates.columns
    rest = [c for c in columns if c != "display_name"]
    single = (
        candidates.groupBy("display_name")
        .agg(F.count("*").alias("_names"), F.min(F.struct(*rest)).alias("_c"))
        .filter(F.col("_names") == 1)
        .select("display_name", "_c.*")
        .select(*columns)
    )
    partial = coverage.agg(
        F.coalesce(F.bool_or(F.col("status") != "checked"), F.lit(False)).alias("partial")
    )
    # One row: the flag of the whole run.
    return single.filter(F.col("state").isin("new", "changed")).crossJoin(F.broadcast(partial))
