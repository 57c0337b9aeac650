"""Nodes in the holders around them, for holders that nest, by one ordered sweep."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The order of what happens at one position; a holder that does not hold itself opens behind its node.
_OPENS, _NODE, _OPENS_BEHIND, _ENDS = range(4)


def innermost(nodes: DataFrame, holders: DataFrame, name: str, doc=("doc_id",), own=True) -> DataFrame:
    """``nodes`` with the position of the innermost holder around each as ``name``, null outside of all.

    ``holders`` has the columns ``doc``, ``node`` and ``end_node``; they nest or lie apart, as elements
    do. With ``own`` a holder lies in itself, else in the one around it: applied to the holders
    themselves this gives the parent of each.

    Starts and ends of holders and the nodes are put into one order, as a merge of three sorted runs.
    The number of holders open at each place is a running sum, and the innermost one open at a depth is
    the last that began at this depth: the top of a stack without a stack. Each document is sorted twice,
    however deep its holders nest; no node meets a holder that it does not lie in.

    Rows that are alike stay apart, and a node or holder with a null position or document is in none.
    """
    doc = list(doc)
    opens = _OPENS if own else _OPENS_BEHIND
    row = F.struct(*(F.col(f"`{c}`") for c in nodes.columns))

    def events(table, at, phase, step, start, carried):
        return table.select(
            *doc, at.alias("_at"), F.lit(phase).alias("_phase"), F.lit(step).alias("_step"), start.alias("_start"), carried.alias("_row")
        )

    kind = nodes.select(row.alias("r")).schema["r"].dataType
    known = holders.dropna(subset=[*doc, "node", "end_node"])
    nothing, none = F.lit(None).cast(kind), F.lit(None).cast(holders.schema["node"].dataType)
    merged = (
        events(nodes, F.col("node"), _NODE, 0, none, row)
        .unionByName(events(known, F.col("node"), opens, 1, F.col("node"), nothing))
        .unionByName(events(known, F.col("end_node"), _ENDS, -1, none, nothing))
    )
    order = [F.col("_at"), F.col("_phase")]
    so_far = Window.partitionBy(*doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at_depth = Window.partitionBy(*doc, "_depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    lies = (F.col("_depth") > 0) & F.col("_at").isNotNull()
    return (
        merged.withColumn("_depth", F.sum("_step").over(so_far))
        .withColumn("_top", F.when(lies, F.last("_start", ignorenulls=True).over(at_depth)))
        .filter(F.col("_row").isNotNull())
        .select("_row.*", F.col("_top").alias(name))
    )
