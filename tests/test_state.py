"""Corpus state, naming, delivery, stores and streams."""

import json

from pyspark.sql import functions as F

from corpusaudit.operators import delivery as D
from corpusaudit.operators import naming, state
from corpusaudit.sources import stores
from corpusaudit.streaming import arrivals as A


def test_candidate_states(spark):
    cands = spark.createDataFrame(
        [("/new", "a"), ("/same", "b"), ("/edited", "c2"), ("/copy", "b"), ("/lost", "d"), ("/swapped", "e"), ("/reverted", "f1")],
        "path string, sha256 string",
    )
    ev = spark.createDataFrame(
        [("1", "/same", "b", "/r/b", "B"), ("2", "/edited", "c1", "/r/c", "C"), ("3", "/lost", "d", "/r/d", "D"),
         ("4", "/swapped", "e", "/r/e", "E"), ("5", "/swapped", "e0", "/r/e0", "E0"), ("6", "/reverted", "f1", "/r/f", "F"),
         ("7", "/reverted", "f2", "/r/f2", "F2")],
        "bundle string, source string, source_sha256 string, artifact string, artifact_sha256 string",
    )
    art = spark.createDataFrame([("/r/b", "B"), ("/r/c", "C"), ("/r/e", "other"), ("/r/f", "F")], "path string, sha256 string")
    got = {r.path: (r.state, r.damage) for r in state.derive_state(cands, ev, art).collect()}
    assert got == {
        "/new": ("new", None), "/same": ("already-ready", None), "/edited": ("changed", None),
        "/copy": ("new", None), "/lost": ("new", "artifact-missing"),
        "/swapped": ("changed", "artifact-mismatched"), "/reverted": ("already-ready", None),
    }


def test_overlapping_inboxes(spark):
    seen = spark.createDataFrame([("b", 1, "/x", 3), ("a", 0, "/x", 3), ("b", 1, "/y", 4)], "inbox string, inbox_ord int, path string, size int")
    got = {r.path: (r.inbox, r.inboxes) for r in state.reconcile_inboxes(seen).collect()}
    assert got == {"/x": ("a", ["a", "b"]), "/y": ("b", ["b"])}


def test_names_under_a_hot_title(spark):
    """A third of all books share one title; every one still gets its name."""
    rows = [(i, "Same" if i % 3 == 0 else f"T{i}", f"{i // 6:064x}") for i in range(3000)]
    df = spark.createDataFrame(rows, "ord bigint, title string, digest string")
    got = naming.assign_names(df).collect()
    first, names = {}, {}
    for ord_, title, digest in rows:
        base = first.setdefault(title, digest)
        names[ord_] = f"{title}.epub" if base == digest else f"{title}-{digest[:12]}.epub"
    assert {r.ord: r.name for r in got if r.action != "refuse"}.items() <= names.items()
    # Digests that share twelve digits clash and are refused, all but the first.
    refused = {r.ord for r in got if r.action == "refuse"}
    assert {r.ord for r in got} - refused and all(rows[o][1] == "Same" for o in refused)


def test_names_are_reused(spark):
    df = spark.createDataFrame([(1, "T", "d" * 64), (2, "T", "d" * 64), (3, "T", "e" * 64)], "ord bigint, title string, digest string")
    old = spark.createDataFrame([("T.epub", "z" * 64), ("T-" + "e" * 12 + ".epub", "e" * 64)], "name string, digest string")
    got = {r.ord: (r.name, r.action) for r in naming.assign_names(df, old).collect()}
    assert got == {
        1: ("T-" + "d" * 12 + ".epub", "publish"), 2: ("T-" + "d" * 12 + ".epub", "reuse"),
        3: ("T-" + "e" * 12 + ".epub", "reuse"),
    }


def test_delivery(spark):
    books = spark.createDataFrame([("a", 1, False), ("b", 2, False), ("c", 3, False), ("d", 4, True), ("e", 5, False)], "name string, byte_size bigint, overwrite boolean")
    listing = spark.createDataFrame([("b", 2, False), ("c", 9, False), ("d", 9, False), ("e", 5, True)], "name string, byte_size bigint, is_directory boolean")
    plan = {r.name: r.action for r in D.plan_delivery(books, listing).collect()}
    assert plan == {"a": "upload-new", "b": "already-delivered", "c": "collision", "d": "overwrite", "e": "upload-new"}
    done = {r.name: (r.outcome, r.reason) for r in D.confirm_delivery(books, listing).collect()}
    assert done["b"] == ("delivered", None) and done["c"] == ("unconfirmed", "other-size") and done["a"] == ("unconfirmed", "not-listed")


def test_inboxes_and_reports_on_disk(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("A")
    (tmp_path / "in" / "b.pdf").write_text("B")
    (tmp_path / "in" / ".hidden.md").write_text("H")
    (tmp_path / "in" / "deep" / "c.markdown").write_text("C")
    folder = str(tmp_path / "in")
    files = stores.scan_inbox(spark, [("flat", folder, False), ("deep", folder, True)]).collect()
    names = sorted((r.inbox, r.path.rsplit("/", 1)[1], r.supported) for r in files)
    assert names == [("deep", "a.md", True), ("deep", "b.pdf", False), ("deep", "c.markdown", True), ("flat", "a.md", True), ("flat", "b.pdf", False)]
    assert all((r.sha256 is not None) == r.supported for r in files)
    for bundle, content in {
        "b1": json.dumps({"source": {"path": "/s", "sha256": "x"}, "artifact": {"path": "/r", "sha256": "y"}}),
        "b2": "{broken", "b3": json.dumps({"source": {"url": "https://x"}}), "b4": json.dumps({"source": {"path": "/s"}}),
        ".b5": "{}",
    }.items():
        (tmp_path / "ready" / bundle).mkdir(parents=True)
        (tmp_path / "ready" / bundle / "report.json").write_text(content)
    reports = stores.scan_reports(spark, str(tmp_path / "ready"))
    none = spark.createDataFrame([], "path string, sha256 string")
    got = sorted((r.bundle, r.problem) for r in state.evidence_problems(reports, none).collect())
    assert got == [("b1", "artifact-missing"), ("b2", "unreadable-report"), ("b4", "incomplete-report")]


def test_sinks_never_write_a_key_twice(spark, tmp_path):
    table, shape = str(tmp_path / "evidence"), "key string, v string"
    one = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "b")], shape)
    assert stores.append_new(one, table, ["key"]) == 2
    assert stores.append_new(spark.createDataFrame([("k2", "other"), ("k3", "c")], shape), table, ["key"]) == 1
    assert sorted(map(tuple, stores.kept(spark, table, one.schema, ["key"]).collect())) == [("k1", "a"), ("k2", "b"), ("k3", "c")]
    log = str(tmp_path / "attempts")
    for turn, text in ((1, "first"), (2, "second")):
        attempt = spark.createDataFrame([("k", turn, text)], "key string, at int, boundary string")
        stores.replace_attempts(attempt, log, ["key"], ["at"])
    assert [r.boundary for r in stores.kept(spark, log, attempt.schema, ["key"]).collect()] == ["second"]


def test_stream_of_new_files(spark, tmp_path):
    inbox, table = tmp_path / "in", str(tmp_path / "states")
    inbox.mkdir()
    (inbox / "a.md").write_text("A")
    none = lambda s: (lambda: spark.createDataFrame([], s))
    evidence = none("bundle string, source string, source_sha256 string, artifact string, artifact_sha256 string")
    for name in ("b.md", "c.txt"):
        job = A.check_arrivals(A.inbox_stream(spark, str(inbox)), evidence, none("path string, sha256 string"), table, str(tmp_path / "cp"))
        job.awaitTermination()
        (inbox / name).write_text(name)
    rows = stores.kept(spark, table, A.DERIVED, ["path", "sha256"]).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.state) for r in rows) == [("a.md", "new"), ("b.md", "new")]


def test_streamed_states_match_batch(spark, tmp_path):
    """A path that holds a third of all arrivals, over two batches of the stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", A.ROCKSDB)
    source, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = [("/hot" if i % 3 == 0 else f"/p{i % 7}", i, str(i % 5)) for i in range(600)]
    every = spark.createDataFrame(rows, "path string, s int, sha256 string").withColumn("arrived_at", F.timestamp_seconds("s")).drop("s")
    for low, high in ((0, 300), (300, 600)):
        every.filter(F.unix_seconds("arrived_at").between(low, high - 1)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(every.schema).parquet(source)
        job = (
            A.path_states(stream).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        job.awaitTermination()
    count = lambda df: sorted((r.path, r.state, r.n) for r in df.groupBy("path", "state").agg(F.sum("n").alias("n")).collect())
    assert count(spark.read.parquet(out)) == count(A.path_states_batch(every))


def test_a_path_with_many_digests_is_dealt_over_shares(spark, tmp_path):
    """A third of all arrivals under one path, every digest another one: no share holds more than its part."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", A.ROCKSDB)
    source, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = [("/hot" if i % 3 == 0 else f"/p{i}", 3000 - i, str(i)) for i in range(3000)]
    every = spark.createDataFrame(rows, "path string, s int, sha256 string").withColumn("arrived_at", F.timestamp_seconds("s")).drop("s")
    for low, high in ((2000, 3001), (0, 2000)):
        every.filter((F.unix_seconds("arrived_at") >= low) & (F.unix_seconds("arrived_at") < high)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(every.schema).parquet(source)
        job = (
            A.path_states(stream, 16).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        job.awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 3000
    # The first batch had the later arrivals, so its least is the path's first.
    (first,) = got.filter("path = '/hot' AND state = 'new'").collect()
    assert first.sha256 == "999" and got.filter("path = '/hot' AND state = 'changed'").count() == 999
    share = F.pmod(F.xxhash64("sha256"), F.lit(16))
    assert got.filter("path = '/hot'").groupBy(share.alias("s")).count().agg(F.max("count")).first()[0] < 120


def test_late_rows_and_repeats(spark, tmp_path):
    source = str(tmp_path / "src")
    rows = [("/a", "x", 0), ("/a", "x", 60), ("/b", "x", 61), ("/a", "y", 62)]
    every = spark.createDataFrame(rows, "path string, sha256 string, s int").withColumn("modified_at", F.timestamp_seconds("s"))
    every.write.parquet(source)
    stream = spark.readStream.schema(every.schema).parquet(source)
    job = A.first_arrivals(stream, "1 hour").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    job.awaitTermination()
    assert spark.table("firsts").count() == 3


def test_files_are_written_once_and_whole(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.md", b"one"), ("a/x.md", b"two"), ("b.md", None), (None, b"lost")], "path string, content binary")
    got = stores.write_files(rows, str(tmp_path / "in")).collect()
    assert sorted((r.path, r.written) for r in got) == [("a/x.md", False), ("a/x.md", True), ("b.md", True)]
    assert (tmp_path / "in" / "a" / "x.md").read_bytes() in (b"one", b"two") and (tmp_path / "in" / "b.md").read_bytes() == b""
    again = stores.write_files(rows.filter("path = 'b.md'").withColumn("content", F.lit(b"new")), str(tmp_path / "in")).collect()
    assert [r.written for r in again] == [False] and (tmp_path / "in" / "b.md").read_bytes() == b""
    assert not [f for f in (tmp_path / "in").rglob("*") if f.is_file() and f.suffix != ".md"]
