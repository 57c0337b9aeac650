"""Observations: what a reader would notice, who may decide it, and what is still to judge."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.operators.verdicts import QUANTITY, quantity
from corpusaudit.rules import ENABLED, OBSERVATIONS

_EVIDENCE = {name: evidence for name, evidence, _ in OBSERVATIONS}
_CONSEQUENCE = {name: consequence for name, _, consequence in OBSERVATIONS}
_POSITION = {name: i for i, (name, *_) in enumerate(OBSERVATIONS)}


def enabled(names=ENABLED) -> list[str]:
    """The activated observations in registry order."""
    return [name for name, *_ in OBSERVATIONS if name in set(names)]


def lookup(values: dict, name: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[name]


def _entry(name, applicability, fired=None, measurement=None, locations=None) -> Column:
    """One observation of a document. Only computable ones may carry a decision."""
    if fired is not None and _EVIDENCE[name] != "computable":
        raise ValueError(f"{name} is {_EVIDENCE[name]}: nothing here may decide whether it fired")
    none = lambda kind: F.lit(None).cast(kind)
    empty = F.array().cast("array<string>")
    return F.struct(
        F.lit(name).alias("name"),
        F.lit(_EVIDENCE[name]).alias("evidence"),
        F.lit(_CONSEQUENCE[name]).alias("consequence"),
        (none("boolean") if applicability is None else applicability).alias("applicability"),
        (none("boolean") if fired is None else fired).alias("fired"),
        (none(QUANTITY) if measurement is None else measurement.cast(QUANTITY)).alias(
            "measurement"
        ),
        (empty if locations is None else F.coalesce(locations, empty)).alias("locations"),
    )


def _unpivot(df: DataFrame, key: str, entries: dict[str, Column], names) -> DataFrame:
    """One row per observation that is turned on, in place."""
    chosen = [entries[n] for n in enabled(names) if n in entries]
    return df.select(key, F.inline(F.array(*chosen)))


def source_observations(facts: DataFrame, names=ENABLED, key: str = "doc_id") -> DataFrame:
    """Thirteen observations of a source, one row each, from its row of facts.

    ``facts`` holds the counts of ``structure.measure``, recorded, max_per_block, strikeouts,
    tables, code_blocks, glyphs, and where wanted the places as arrays named
    ``<observation with underscores>_at``.
    """

    def places(name):
        column = name.replace("-", "_") + "_at"
        return F.col(column) if column in facts.columns else None

    def counted(name, column, unit, applicability):
        n = F.col(column)
        return _entry(name, applicability, n > 0, quantity(n, F.lit(unit)), places(name))

    images, yes = F.col("images") > 0, F.lit(True)
    bound = F.lit("lower-bound")
    return _unpivot(
        facts,
        key,
        {
            "ordered-list-numbering-loss": counted(
                "ordered-list-numbering-loss",
                "renumbered_lists",
                "lists",
                F.col("ordered_lists") > 0,
            ),
            "page-break-content-destruction": counted(
                "page-break-content-destruction", "page_breaks", "elements", yes
            ),
            "unrenderable-glyphs": counted("unrenderable-glyphs", "glyphs", "codepoints", yes),
            "unrenderable-images": _entry("unrenderable-images", images),
            "alt-text-fallback-absence": _entry(
                "alt-text-fallback-absence",
                images,
                None,
                quantity(F.col("images_without_alt"), F.lit("images")),
            ),
            "footnote-target-reliability": _entry(
                "footnote-target-reliability", F.col("notes") > 0
            ),
            "colour-meaning-collapse": _entry("colour-meaning-collapse", images),
            "diagram-text-legibility": _entry("diagram-text-legibility", images),
            "link-footnote-dilution": _entry(
                "link-footnote-dilution",
                F.col("recorded") > 0,
                None,
                quantity(F.col("max_per_block"), F.lit("recorded links"), bound),
            ),
            "boundary-chrome-presence": _entry("boundary-chrome-presence", yes),
            "strikethrough-inversion": counted(
                "strikethrough-inversion", "strikeouts", "strikeouts", yes
            ),
            "table-relationship-loss": counted(
                "table-relationship-loss", "tables", "tables", yes
            ),
            "code-block-reflow": counted("code-block-reflow", "code_blocks", "code blocks", yes),
        },
        names,
    )


def navigation_observations(facts: DataFrame, names=ENABLED, key: str = "doc_id") -> DataFrame:
    """Two observations of a built book from its link facts.

    ``facts`` holds note_references, note_unresolved, links, web_link, max_non_footnote_per_block,
    complete. Where a document could not be read nothing is claimed.
    """
    complete = F.col("complete")
    unresolved = F.col("note_unresolved")
    quantity_if = lambda q: F.when(complete, q)
    return _unpivot(
        facts,
        key,
        {
            "footnote-target-reliability": _entry(
                "footnote-target-reliability",
                F.col("note_references") > 0,
                F.when(complete, unresolved > 0),
                quantity_if(quantity(unresolved, F.lit("links"))),
            ),
            "link-footnote-dilution": _entry(
                "link-footnote-dilution",
                F.col("links") - F.col("web_link") > 0,
                None,
                quantity_if(
                    quantity(F.col("max_non_footnote_per_block"), F.lit("recorded links"))
                ),
            ),
        },
        names,
    )


def image_observations(facts: DataFrame, names=ENABLED, key: str = "doc_id") -> DataFrame:
    """Four observations of a built book from its image facts.

    ``facts`` holds displayed, references, unrenderable, blank_alt.
    """
    shown = F.col("displayed") > 0
    applies = shown | (F.col("references") > 0)
    return _unpivot(
        facts,
        key,
        {
            "unrenderable-images": _entry(
                "unrenderable-images",
                shown,
                F.when(shown, F.col("unrenderable") > 0),
                quantity(F.col("unrenderable"), F.lit("images")),
            ),
            "alt-text-fallback-absence": _entry(
                "alt-text-fallback-absence",
                applies,
                F.when(applies, F.col("blank_alt") > 0),
                quantity(F.col("blank_alt"), F.lit("images")),
            ),
            "colour-meaning-collapse": _entry("colour-meaning-collapse", applies),
            "diagram-text-legibility": _entry("diagram-text-legibility", applies),
        },
        names,
    )


def judged(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Judgements (key, name, fired) of a person or a device as a layer of observations; null is undecided."""
    none = F.lit(None).cast(QUANTITY)
    return rows.select(
        key,
        "name",
        lookup(_EVIDENCE, F.col("name")).alias("evidence"),
        lookup(_CONSEQUENCE, F.col("name")).alias("consequence"),
        F.lit(True).alias("applicability"),
        "fired",
        none.alias("measurement"),
        F.array().cast("array<string>").alias("locations"),
    )


def merge_observations(
    docs: DataFrame, layers: list[DataFrame], names=ENABLED, key: str = "doc_id"
) -> DataFrame:
    """One row per document and observation: the last layer that reached it wins.

    Device-judged observations nobody reached are added undecided, so that an outstanding
    judgement is a row and not an absence.
    """
    wanted = enabled(names)
    judged = [n for n in wanted if _EVIDENCE[n] == "device-judged"]
    stacked = None
    if judged:
        entries = {n: _entry(n, None) for n in judged}
        stacked = _unpivot(docs, key, entries, names).withColumn("_layer", F.lit(-1))
    for position, layer in enumerate(layers):
        layer = layer.filter(F.col("name").isin(*wanted)).withColumn("_layer", F.lit(position))
        stacked = layer if stacked is None else stacked.unionByName(layer)
    rest = [c for c in stacked.columns if c not in (key, "name", "_layer")]
    merged = stacked.groupBy(key, "name").agg(F.max_by(F.struct(*rest), "_layer").alias("_o"))
    return merged.select(key, "name", "_o.*").withColumn(
        "position", lookup(_POSITION, F.col("name"))
    )


def worklist(observations: DataFrame, interlocks: DataFrame | None = None, key: str = "doc_id"):
    """What is still to be judged: undecided and not out of scope, with its owner.

    ``interlocks`` holds key and ``engaged``; an engaged interlock is work for the agent. A
    computable observation without a decision waits for its measurement and has no owner here.
    """
    open_ = observations.filter(
        F.col("fired").isNull() & ~F.coalesce(~F.col("applicability"), F.lit(False))
    )
    owned = open_.filter(F.col("evidence").isin("flaggable", "device-judged")).select(
        key,
        F.col("name").alias("item"),
        F.when(F.col("evidence") == "flaggable", F.lit("agent"))
        .otherwise(F.lit("human"))
        .alias("owner"),
        lookup(_POSITION, F.col("name")).alias("position"),
    )
    if interlocks is None:
        return owned
    locked = interlocks.filter("engaged").select(
        key,
        F.lit("link-interlock").alias("item"),
        F.lit("agent").alias("owner"),
        F.lit(len(OBSERVATIONS)).alias("position"),
    )
    return owned.unionByName(locked)


def repair_candidates(docs: DataFrame) -> DataFrame:
    """Documents whose interlock engaged and whose notes were not recovered.

    ``docs`` holds engaged and recovery_outcome.
    """
    return docs.filter(
        F.col("engaged") & F.col("recovery_outcome").isin("not-recognised", "skipped")
    )
