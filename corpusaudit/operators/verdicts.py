"""Requirements against measurements: five-valued verdicts, refusals, and what they add up to."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.rules import ACTIVATIONS, REQUIREMENTS
from corpusaudit.schema import VERDICTS

# Severity when verdicts are combined: a known failure outranks any uncertainty.
_RANK = {"false": 1, "unknown": 2, "unevaluable": 3, "not_applicable": 4, "true": 5}
INSTRUMENT = (
    "struct<value:bigint,applicable:boolean,reliable:boolean,relation:string>"
)
QUANTITY = "struct<basis:string,relation:string,unit:string,value:bigint>"


def quantity(value: Column, unit: Column, relation: Column | None = None) -> Column:
    """A number with how it was obtained: measured, or projected where a relation is given."""
    relation = F.lit(None).cast("string") if relation is None else relation
    basis = F.when(relation.isNull(), F.lit("measured")).otherwise(F.lit("projected"))
    return F.struct(
        basis.alias("basis"),
        relation.alias("relation"),
        unit.alias("unit"),
        value.cast("bigint").alias("value"),
    )


def reported(value: Column, unit: Column) -> Column:
    return F.when(
        value.isNotNull(),
        F.struct(
            F.lit("reported").alias("basis"),
            F.lit(None).cast("string").alias("relation"),
            unit.alias("unit"),
            value.cast("bigint").alias("value"),
        ),
    )


def inherit(fact: Column) -> Column:
    """A quantity taken over from another run: reported, whatever it was, and of no relation."""
    taken = fact["basis"].isin("measured", "projected")
    return F.when(
        taken,
        fact.withField("basis", F.lit("reported")).withField(
            "relation", F.lit(None).cast("string")
        ),
    ).otherwise(fact)


def instrument(value, applicable, reliable=True, relation=None) -> Column:
    """What one requirement can be held against."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(value).cast("bigint").alias("value"),
        as_col(applicable).cast("boolean").alias("applicable"),
        as_col(reliable).cast("boolean").alias("reliable"),
        as_col(relation).cast("string").alias("relation"),
    )


def instruments_of(facts: DataFrame) -> DataFrame:
    """Per-document facts -> map of requirement to instrument, for built documents.

    ``facts`` holds recorded, max_per_block, max_href_bytes, max_anchors, chapters, complete. One
    malformed document makes every reading of its package unreliable.
    """
    recorded = F.col("recorded") > 0
    complete = F.col("complete")
    return facts.withColumn(
        "instruments",
        F.create_map(
            F.lit("recorded-links-per-block"),
            instrument(F.col("max_per_block"), recorded, complete),
            F.lit("footnote-href-length"),
            instrument(F.col("max_href_bytes"), recorded, complete),
            F.lit("anchors-per-chapter"),
            instrument(F.col("max_anchors"), F.col("chapters") > 0, complete),
        ),
    )


def project(facts: DataFrame, strips: bool | None = None) -> DataFrame:
    """Per-document facts of a source -> map of projected instruments.

    ``facts`` holds recorded, max_per_block, max_href_bytes, identifiers, notes,
    unresolved_recorded. The block count is a lower bound only where nothing will be stripped.
    """
    strips = ACTIVATIONS["strip_non_apparatus_hrefs"][0] if strips is None else strips
    recorded = F.col("recorded") > 0
    floor = (
        (F.col("notes") == 0) & (F.col("unresolved_recorded") == 0) if strips else F.lit(True)
    )
    unsure = F.lit("indeterminate")
    return facts.withColumn(
        "instruments",
        F.create_map(
            F.lit("recorded-links-per-block"),
            instrument(
                F.col("max_per_block"),
                recorded,
                True,
                F.when(floor, F.lit("lower-bound")).otherwise(unsure),
            ),
            F.lit("footnote-href-length"),
            instrument(F.col("max_href_bytes"), recorded, True, unsure),
            F.lit("anchors-per-chapter"),
            instrument(F.col("identifiers"), F.col("identifiers") > 0, True, unsure),
        ),
    )


def gather_instruments(measurements: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long rows (key, requirement_id, value, applicable, reliable, relation) -> one map per key."""
    one = F.struct("value", "applicable", "reliable", "relation").cast(INSTRUMENT)
    single = measurements.groupBy(key, "requirement_id").agg(F.max(one).alias("i"))
    return single.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("requirement_id", "i"))).alias("instruments")
    )


def _rule_rows(requirements) -> Column:
    text = lambda v: F.lit(v).cast("string")
    number = lambda v: F.lit(v).cast("bigint")
    return F.array(
        *[
            F.struct(
                text(r.id).alias("requirement_id"),
                text(r.unit).alias("unit"),
                number(r.enforced).alias("enforced"),
                number(r.observed).alias("observed"),
                text(r.failure_mode).alias("failure_mode"),
                text(r.authority).alias("authority"),
                text(r.declared if r.declared in VERDICTS else None).alias("declared"),
            )
            for r in sorted(requirements, key=lambda r: r.id)
        ]
    )


def evaluate(
    subjects: DataFrame, key: str = "doc_id", requirements=REQUIREMENTS, assessments: str | None = None
) -> DataFrame:
    """One verdict per subject and requirement, by the fixed order of precedence.

    ``subjects`` holds the key and ``instruments``, a map of requirement to instrument; where
    ``assessments`` names a map of requirement to STRUCT(verdict, applicable), that is used too.
    The rules are a literal of a dozen rows, so every subject meets all of them in place: no
    join and no shuffle, and a requirement nobody measured still gets its ``unknown``.
    """
    rows = subjects.select(
        key,
        "instruments",
        *([F.col(assessments).alias("_assessed")] if assessments else []),
        F.inline(_rule_rows(requirements)),
    )
    given = F.try_element_at("instruments", F.col("requirement_id"))
    rows = rows.withColumn("_i", given)
    i = F.col("_i")
    enforced = F.col("enforced")
    projected = F.when(
        (i["relation"] == "lower-bound") & (i["value"] > enforced), F.lit("false")
    ).otherwise(F.lit("unknown"))
    measured = F.when(i["value"] <= enforced, F.lit("true")).otherwise(F.lit("false"))
    judged = F.lit(None).cast("struct<verdict:string,applicable:boolean>")
    if assessments:
        judged = F.try_element_at("_assessed", F.col("requirement_id"))
    stated, assessed = F.col("declared").isNotNull(), judged.isNotNull()
    by_rule = ~stated & ~assessed & i.isNotNull()
    verdict = (
        F.when(stated, F.col("declared"))
        .when(assessed, judged["verdict"])
        .when(i.isNull(), F.lit("unknown"))
        .when(~i["applicable"], F.lit("not_applicable"))
        .when(~i["reliable"] | enforced.isNull(), F.lit("unknown"))
        .when(i["relation"].isNotNull(), projected)
        .otherwise(measured)
    )
    return rows.select(
        key,
        "requirement_id",
        verdict.alias("verdict"),
        "failure_mode",
        "authority",
        F.when(~stated & assessed, judged["applicable"])
        .when(by_rule, i["applicable"])
        .alias("applicability"),
        F.when(by_rule & i["applicable"], quantity(i["value"], F.col("unit"), i["relation"])).alias(
            "measurement"
        ),
        reported(enforced, F.col("unit")).alias("enforced_limit"),
        reported(F.col("observed"), F.col("unit")).alias("observed_limit"),
    )


def rank(verdict: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in _RANK.items() for x in pair])[verdict]


def combine(verdict: Column) -> Column:
    """Aggregate: the gravest verdict present; of nothing, not_applicable."""
    names = F.array(*[F.lit(v) for v, _ in sorted(_RANK.items(), key=lambda e: e[1])])
    return F.coalesce(F.get(names, F.min(rank(verdict)) - 1), F.lit("not_applicable"))


def refusals(verdicts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, requirements): false verdicts whose rule may refuse, by requirement."""
    false = verdicts.filter((F.col("verdict") == "false") & (F.col("authority") == "refuse"))
    return false.groupBy(key).agg(
        F.array_sort(F.collect_set("requirement_id")).alias("requirements")
    )


def first_refusal(
    malformed: Column,
    incompatible: Column,
    text_lost: Column,
    notes_mismatched: Column,
    images_lost: Column,
) -> Column:
    """The boundary that refuses a book, or NULL. An unreadable chapter comes before its words."""
    return (
        F.when(malformed, F.lit("malformed-content-document"))
        .when(incompatible, F.lit("compatibility"))
        .when(text_lost, F.lit("text-preservation"))
        .when(notes_mismatched, F.lit("note-representation-mismatch"))
        .when(images_lost, F.lit("image-preservation"))
    )


def note_mismatch(counts: DataFrame) -> DataFrame:
    """Add ``disagreements``: where source, conversion and book differ over notes.

    ``counts`` holds source_notes, converted_notes, references, unresolved_references,
    note_documents. Counts of the book are floors: it may keep links of its own.
    """
    notes = F.col("converted_notes")
    checks = (
        (F.col("source_notes") != notes, "source-count-disagreement"),
        (F.col("references") < notes, "missing-references"),
        (F.col("unresolved_references") != 0, "unresolved-references"),
        (F.col("note_documents") < notes, "shared-note-documents"),
    )
    return counts.withColumn(
        "disagreements",
        F.array_compact(F.array(*[F.when(wrong, F.lit(name)) for wrong, name in checks])),
    )


def verdict_rollup(verdicts: DataFrame, *levels: str) -> DataFrame:
    """Counts of verdicts with totals per level and of everything."""
    return verdicts.rollup(*levels).agg(F.count("*").alias("n"))
