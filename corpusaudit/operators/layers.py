"""Values from several layers, merged value by value with where each came from."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layered(layers: dict[str, DataFrame], key: list[str], values: list[str]) -> DataFrame:
    """One row for each key, with each value of the layer that says it last, and which layers said it.

    A layer has the columns ``key``, ``version``, ``gone`` and some of ``values``. Of all rows the one of
    the greatest version counts, of equal versions the one of the later layer in ``layers``. A null value
    says nothing, so an older one shows through; a row that is ``gone`` takes away what older rows said.

    For each value ``v`` there are ``v``, ``v_from`` (the layer whose word counts, also of one that took it
    away; null where nobody said anything) and ``v_over`` (the layers that said something else before, in
    order). All of it is one aggregate that is summed before it is shuffled, so a key with many rows is no
    burden. Null keys are a key, a null version is older than all others, rows that are alike count once.
    """
    stacked = None
    for place, (name, layer) in enumerate(layers.items()):
        there = set(layer.columns)
        types = {v: t for other in layers.values() for v, t in other.dtypes if v in values}
        rows = layer.select(
            *key,
            F.lit(name).alias("_layer"),
            F.struct(F.col("version").cast("long"), F.lit(place).alias("place")).alias("_order"),
            F.coalesce("gone", F.lit(False)).alias("_gone"),
            *((F.col(v) if v in there else F.lit(None)).cast(types[v]).alias(v) for v in values),
        )
        stacked = rows if stacked is None else stacked.unionByName(rows)
    order = {name: place for place, name in enumerate(layers)}
    places = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    merged = []
    for v in values:
        says = F.col(v).isNotNull() | F.col("_gone")
        word = F.struct(F.when(~F.col("_gone"), F.col(v)).alias("v"), F.col("_layer").alias("l"))
        merged += [
            F.max_by(word, F.when(says, F.col("_order"))).alias(f"_{v}"),
            F.collect_set(F.when(F.col(v).isNotNull() & ~F.col("_gone"), F.col("_layer"))).alias(f"_{v}_said"),
        ]
    rows = stacked.groupBy(*key).agg(*merged)
    out = []
    for v in values:
        lost = F.array_sort(
            F.array_remove(f"_{v}_said", F.coalesce(F.col(f"_{v}")["l"], F.lit(""))), lambda a, b: (places[a] - places[b]).cast("int")
        )
        out += [F.col(f"_{v}")["v"].alias(v), F.col(f"_{v}")["l"].alias(f"{v}_from"), lost.alias(f"{v}_over")]
    return rows.select(*key, *out)
