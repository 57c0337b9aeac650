"""Turning Python rows into Arrow batches of a fixed schema."""

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusaudit.session import BATCH_BYTES, bound_batches

# Output is cut on rows, as a page is thousands of them, and on the bytes that rows carry.
BATCH_ROWS = 20000


def dealt(rows, *key, deal=True):
    """Rows dealt over all tasks of a shuffle by their key, as parsing them costs far more than moving them.

    A file with one row group would else be parsed by one task, whatever it holds.
    """
    if not deal:
        return rows
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def read_files(rows, make_rows, schema, columns):
    """``make_rows`` over rows that hold whole files, which go to Python in small batches."""
    bound_batches(rows.sparkSession)
    return rows.mapInArrow(arrow_rows(make_rows, schema, columns), schema)


def pruned(schema, columns):
    """(schema of the named columns, a function that keeps just those of a row); all where none are named."""
    if columns is None:
        return schema, lambda row: row
    places = [schema.fieldNames().index(c) for c in columns]
    return StructType([schema.fields[i] for i in places]), lambda row: [row[i] for i in places]


def arrow_rows(make_rows, schema, columns):
    """A ``mapInArrow`` function: ``make_rows(*values of one input row)`` yields output tuples."""
    target = to_arrow_schema(schema)
    limit = BATCH_ROWS

    def run(batches):
        waiting, held = [], 0
        for batch in batches:
            inputs = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            for i in range(batch.num_rows):
                for row in make_rows(*[col[i].as_py() for col in inputs]):
                    waiting.append(row)
                    held += sum(len(v) for v in row if type(v) in (bytes, str))
                    if len(waiting) >= limit or held >= BATCH_BYTES:
                        yield _batch(waiting, target)
                        waiting, held = [], 0
        if waiting:
            yield _batch(waiting, target)

    def _batch(rows, to):
        arrays = [pa.array(col, type=f.type) for col, f in zip(zip(*rows), to)]
        return pa.RecordBatch.from_arrays(arrays, schema=to)

    return run
