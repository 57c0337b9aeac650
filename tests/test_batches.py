import pyarrow as pa

from corpusaudit.session import BATCH_BYTES, bound_batches
from corpusaudit.sources.rows import arrow_rows, read_files

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_whole_files_go_to_python_in_small_batches(spark):
    before = spark.conf.get(LIMIT)
    try:
        spark.conf.set(LIMIT, f"{64 << 20}b")
        files = spark.range(0, 3000, 1, 1).selectExpr("id", "cast(repeat('y', 10000) AS binary) AS content")
        read_files(files, lambda *row: [], files.schema, ("id", "content"))
        sizes = files.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"b": [b.nbytes]}) for b in bs), "b long").collect()
        assert len(sizes) > 3 and max(r.b for r in sizes) < 2 * BATCH_BYTES
        spark.conf.set(LIMIT, "1g")
        bound_batches(spark)
        assert spark.conf.get(LIMIT) == f"{BATCH_BYTES}b"
        spark.conf.set(LIMIT, f"{1 << 20}b")
        bound_batches(spark)
        assert spark.conf.get(LIMIT) == f"{1 << 20}b"
    finally:
        spark.conf.set(LIMIT, before)


def test_rows_of_text_are_handed_on_before_they_pile_up(spark):
    schema = spark.createDataFrame([], "k long, t string").schema
    run = arrow_rows(lambda k: [(k, "y" * (1 << 20))], schema, ("k",))
    out = list(run([pa.RecordBatch.from_pydict({"k": list(range(40))})]))
    assert sum(b.num_rows for b in out) == 40 and max(b.nbytes for b in out) < 2 * BATCH_BYTES
