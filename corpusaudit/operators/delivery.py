"""Delivery: what to send, whether it may be sent, and whether it arrived."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.sources.documents import suffix


def remote_files(listing: DataFrame) -> DataFrame:
    """(name, byte_size) of files on the device, the first entry of a name. Folders are no files."""
    files = listing.filter(~F.coalesce(F.col("is_directory"), F.lit(False)) & (F.col("name") != ""))
    order = F.col("ord") if "ord" in listing.columns else F.col("byte_size")
    return (
        files.groupBy("name")
        .agg(F.min_by(F.struct("byte_size"), order).alias("_e"))
        .select("name", F.col("_e.byte_size").alias("remote_size"), F.lit(True).alias("listed"))
    )


def plan_delivery(artifacts: DataFrame, listing: DataFrame) -> DataFrame:
    """Add ``action``: upload-new, already-delivered, overwrite or collision.

    ``artifacts`` holds name, byte_size, overwrite. Name and size are all a listing tells.
    """
    same = F.col("byte_size").eqNullSafe(F.col("remote_size"))
    return (
        artifacts.join(remote_files(listing), "name", "left")
        .withColumn(
            "action",
            F.when(F.col("listed").isNull(), F.lit("upload-new"))
            .when(same, F.lit("already-delivered"))
            .when(F.col("overwrite"), F.lit("overwrite"))
            .otherwise(F.lit("collision")),
        )
        .drop("listed")
    )


def confirm_delivery(sent: DataFrame, listing: DataFrame) -> DataFrame:
    """Add ``outcome`` (delivered, unconfirmed) and ``reason`` from a fresh listing."""
    same = F.col("byte_size").eqNullSafe(F.col("remote_size"))
    return (
        sent.join(remote_files(listing), "name", "left")
        .withColumn(
            "outcome",
            F.when(F.col("listed") & same, F.lit("delivered")).otherwise(F.lit("unconfirmed")),
        )
        .withColumn(
            "reason",
            F.when(F.col("listed").isNull(), F.lit("not-listed")).when(~same, F.lit("other-size")),
        )
        .drop("listed")
    )


def deliverable(artifacts: DataFrame, evidence: DataFrame, ready_dir: str) -> DataFrame:
    """Add ``boundary``: NULL where an artifact may be delivered, else the first check it fails.

    ``artifacts`` holds path, is_file, sha256 (NULL where unreadable); ``evidence`` holds bundle,
    artifact, artifact_sha256.
    """
    from corpusaudit.operators.state import published_artifact

    parent = F.regexp_extract(F.col("path"), r"(?s)^(.*)/[^/]*\z", 1)
    return published_artifact(artifacts, evidence).withColumn(
        "boundary",
        F.when(~F.col("is_file"), F.lit("unusable-ready-artifact"))
        .when(suffix(F.col("path")) != ".epub", F.lit("unusable-ready-artifact"))
        .when(parent != ready_dir.rstrip("/"), F.lit("artifact-outside-ready"))
        .when(F.col("bundle").isNull(), F.lit("missing-preparation-evidence"))
        .when(F.col("sha256").isNull(), F.lit("unreadable-ready-artifact"))
        .when(F.col("sha256") != F.col("recorded_sha256"), F.lit("artifact-mismatched")),
    )
