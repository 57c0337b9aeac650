"""Package integrity: problems, references, navigation, covers, text, images and conformance."""

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions import refs as R
from corpusaudit.operators import verdicts as V
from corpusaudit.operators.nesting import innermost
from corpusaudit.rules import APPLIES_TO, IMAGE_REQUIREMENTS, SUPPORT_MATRIX
from corpusaudit.sources import packages as S
from corpusaudit.sources.images import has_alt

_union = functools.partial(functools.reduce, DataFrame.unionByName)


def duplicate_members(members: DataFrame) -> DataFrame:
    """(package_id, name, n) of names stored more than once."""
    stored = members.filter(F.col("ord") >= 0)
    return stored.groupBy("package_id", "name").agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_ids(records: DataFrame) -> DataFrame:
    """(package_id, path, id, n) of manifest ids declared more than once."""
    items = S.manifest(records)
    return items.groupBy("package_id", "path", "id").agg(F.count("*").alias("n")).filter("n > 1")


def first_items(records: DataFrame) -> DataFrame:
    """Manifest items, one per id: the first declaration wins."""
    items = S.manifest(records)
    rest = [c for c in items.columns if c not in ("package_id", "id")]
    first = items.groupBy("package_id", "id").agg(F.min_by(F.struct(*rest), "ord").alias("_i"))
    return first.select("package_id", "id", "_i.*")


def spine_paths(records: DataFrame) -> DataFrame:
    """(package_id, ord, idref, linear, target, properties, resolved) of the reading order."""
    items = first_items(records).select(
        "package_id",
        F.col("id").alias("idref"),
        "target",
        "properties",
        F.lit(True).alias("_there"),
    )
    return (
        S.spine(records)
        .select("package_id", "ord", F.col("id").alias("idref"), "linear")
        .join(items, ["package_id", "idref"], "left")
        .withColumn("resolved", F.coalesce("_there", F.lit(False)))
        .drop("_there")
    )


def document_references(nodes: DataFrame) -> DataFrame:
    """(package_id, document, kind, target): every reference of every content document."""
    get = lambda k: F.try_element_at("attrs", F.lit(k))
    said = F.array_compact(F.array(get("href"), get("src"), get("data"), get("xlink:href")))
    rows = nodes.filter("well_formed").select("package_id", "document", F.explode(said).alias("href"))
    ref = R.classify_reference(F.col("document"), F.col("href"))
    return rows.withColumn("_r", ref).select("package_id", "document", "_r.kind", "_r.target")


def reference_counts(references: DataFrame) -> DataFrame:
    """(package_id, kind, n) of references by class."""
    return references.groupBy("package_id", "kind").agg(F.count("*").alias("n"))


def broken_references(
    members: DataFrame, records: DataFrame, references: DataFrame
) -> DataFrame:
    """(package_id, source, kind, target): references to what the archive does not hold.

    Manifest targets and document targets are looked for among the members, spine entries among
    the manifest ids.
    """
    names = members.select("package_id", F.col("name").alias("target")).distinct()
    declared = (
        S.manifest(records)
        .filter(F.col("reference") == "in-book")
        .select("package_id", F.col("path").alias("source"), F.lit("manifest").alias("kind"), "target")
    )
    inside = references.filter((F.col("kind") == "in-book") & F.col("target").isNotNull()).select(
        "package_id",
        F.col("document").alias("source"),
        F.lit("content-document").alias("kind"),
        "target",
    )
    ids = S.manifest(records).select("package_id", F.col("id").alias("target")).distinct()
    ordered = S.spine(records).select(
        "package_id", F.col("path").alias("source"), F.lit("spine").alias("kind"), F.col("id").alias("target")
    )
    on = ["package_id", "target"]
    columns = ["package_id", "source", "kind", "target"]
    return (
        declared.unionByName(inside)
        .join(names, on, "left_anti")
        .select(*columns)
        .unionByName(ordered.join(ids, on, "left_anti").select(*columns))
    )


def navigation(records: DataFrame) -> DataFrame:
    """(package_id, path, kind): the navigation item; the property comes before the old format."""
    toc = records.filter(F.col("record") == "package").select("package_id", F.col("id").alias("_toc"))
    items = S.manifest(records).join(toc, "package_id", "left")
    modern = F.array_contains("properties", "nav") & (F.col("media_type") == S.XHTML_TYPE)
    older = (F.col("id") == F.col("_toc")) | (F.col("media_type") == S.NCX_TYPE)
    place = F.when(F.coalesce(modern, F.lit(False)), 0).when(F.coalesce(older, F.lit(False)), 1)
    ranked = items.withColumn("_p", place).filter(F.col("_p").isNotNull())
    best = ranked.groupBy("package_id").agg(
        F.min_by(F.struct("target", "_p"), F.struct("_p", "id", "ord")).alias("_n")
    )
    kind = F.when(F.col("_n._p") == 0, F.lit("epub3-nav")).otherwise(F.lit("ncx"))
    return best.select("package_id", F.col("_n.target").alias("path"), kind.alias("kind"))


def navigation_entries(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(package_id, entries) of links inside the navigation of the chosen document.

    The old format's entries are its navigation points.
    """
    documents = chosen.select("package_id", F.col("path").alias("document"), F.col("kind").alias("_k"))
    mine = nodes.join(documents, ["package_id", "document"])
    points = F.count_if((F.col("_k") == "ncx") & (F.col("tag") == "navpoint"))
    navs = mine.filter(F.col("tag") == "nav").select("package_id", "node", "end_node")
    anchors = mine.filter((F.col("tag") == "a") & F.col("href").isNotNull() & (F.col("_k") != "ncx"))
    inside = (
        innermost(anchors.select("package_id", "node"), navs, "nav", ["package_id"])
        .filter(F.col("nav").isNotNull())
        .groupBy("package_id")
        .agg(F.count("*").alias("a"))
    )
    older = mine.groupBy("package_id").agg(points.alias("p"))
    zero = F.lit(0).cast("bigint")
    return (
        chosen.select("package_id")
        .join(inside, "package_id", "left")
        .join(older, "package_id", "left")
        .select("package_id", (F.coalesce("a", zero) + F.coalesce("p", zero)).alias("entries"))
    )


def covers(records: DataFrame) -> DataFrame:
    """(package_id, cover): the item with the cover property, else the one older metadata names."""
    items = S.manifest(records)
    marked = (
        items.filter(F.array_contains("properties", "cover-image"))
        .groupBy("package_id")
        .agg(F.min_by("id", F.struct("id", "ord")).alias("a"))
    )
    known = items.select("package_id", "id").distinct()
    older = (
        records.filter(F.col("record") == "meta")
        .select("package_id", "ord", "id")
        .join(known, ["package_id", "id"], "left_semi")
        .groupBy("package_id")
        .agg(F.min_by("id", "ord").alias("b"))
    )
    named = marked.join(older, "package_id", "full_outer").select(
        "package_id", F.coalesce("a", "b").alias("id")
    )
    return named.join(first_items(records), ["package_id", "id"]).select(
        "package_id", F.col("target").alias("cover")
    )


def package_text(segments: DataFrame, records: DataFrame) -> DataFrame:
    """(package_id, text): visible text in reading order, navigation left out."""
    order = spine_paths(records).filter(
        F.col("target").isNotNull() & ~F.array_contains("properties", "nav")
    )
    placed = segments.join(
        order.select("package_id", "ord", F.col("target").alias("document")),
        ["package_id", "document"],
    )
    parts = F.array_sort(F.collect_list(F.struct("ord", "seq", "text")))
    return placed.groupBy("package_id").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text")
    )


def package_problems(
    members: DataFrame, paths: DataFrame, records: DataFrame, nodes: DataFrame, broken: DataFrame
) -> DataFrame:
    """(package_id, kind, location, detail): everything wrong with each package.

    ``members`` are all stored members, duplicates included.
    """
    text = lambda v: F.lit(v).cast("string")

    def rows(df, kind, location, detail):
        return df.select(
            "package_id", text(kind).alias("kind"), location.alias("location"), detail.alias("detail")
        )

    at_container = text(S.CONTAINER)
    readable = members.filter(F.col("content").isNotNull())
    document = readable.select("package_id", F.col("name").alias("path")).distinct()
    named = paths.filter(F.col("path").isNotNull())
    whole = records.filter(F.col("record") == "package").select("package_id", "path")
    nav = whole.join(navigation(records).withColumnRenamed("path", "nav"), "package_id", "left")
    there = readable.select("package_id", F.col("name").alias("nav"), F.lit(True).alias("_in")).distinct()
    malformed = nodes.filter(~F.col("well_formed")).select("package_id", "document").distinct()
    return _union(
        [
            rows(
                paths.filter(~F.col("present")),
                "missing-container",
                at_container,
                text("the archive has no container document"),
            ),
            rows(
                paths.filter(F.col("present") & ~F.col("well_formed")),
                "malformed-xml",
                at_container,
                text("the container document is not well-formed"),
            ),
            rows(
                named.join(document, ["package_id", "path"], "left_anti"),
                "missing-package-document",
                F.col("path"),
                text("the package document is not in the archive"),
            ),
            rows(
                records.filter(F.col("record") == "malformed"),
                "malformed-xml",
                F.col("path"),
                text("the package document is not well-formed"),
            ),
            rows(
                duplicate_ids(records),
                "duplicate-manifest-id",
                F.col("path"),
                F.concat(text("declared more than once: "), "id"),
            ),
            rows(
                duplicate_members(members),
                "duplicate-archive-member",
                F.col("name"),
                text("stored more than once"),
            ),
            rows(
                members.filter((F.col("ord") >= 0) & R.is_unsafe_member(F.col("name"))),
                "unsafe-archive-path",
                F.col("name"),
                text("the name leaves the archive root"),
            ),
            rows(
                members.filter(F.col("problem") == "unreadable"),
                "unreadable-archive-member",
                F.col("name"),
                text("could not be read"),
            ),
            rows(
                members.filter(F.col("problem") == "not-a-zip-archive"),
                "unreadable-artifact",
                text(""),
                F.col("problem"),
            ),
            rows(malformed, "malformed-xml", F.col("document"), text("not well-formed")),
            rows(
                nav.join(there, ["package_id", "nav"], "left").filter(F.col("_in").isNull()),
                "missing-navigation",
                F.coalesce("nav", "path"),
                text("no readable navigation document"),
            ),
            rows(
                broken,
                "broken-reference",
                F.col("source"),
                F.concat("kind", text(" reference is unresolved")),
            ),
        ]
    )


def problem_order(problems: DataFrame) -> DataFrame:
    return problems.orderBy("package_id", "kind", "location", "detail")


# --- images -------------------------------------------------------------------------------------


def support(requirement: str, matrix=SUPPORT_MATRIX) -> Column:
    """The verdict of one image against one requirement's matrix; a damaged image is unknown.

    The matrix is a handful of rows, so it becomes a condition and no join. A row that names a
    property the image lacks does not match.
    """

    def matches(row):
        ok = F.lit(True)
        for column, wanted in (
            ("media_type", row.media_type),
            ("sample_depth", row.sample_depth),
            ("colour_type", row.colour_types),
            ("scan_mode", row.scan_mode),
            ("colour_model", row.colour_models),
        ):
            if isinstance(wanted, tuple):
                ok = ok & F.col(column).isin(*wanted) if wanted else ok
            elif wanted is not None:
                ok = ok & (F.col(column) == wanted)
        return F.coalesce(ok, F.lit(False))

    rows = [r for r in matrix if r.requirement == requirement]
    any_of = lambda v: functools.reduce(
        Column.__or__, [matches(r) for r in rows if r.verdict == v], F.lit(False)
    )
    return (
        F.when(~F.coalesce("intact", F.lit(False)), F.lit("unknown"))
        .when(any_of("false"), F.lit("false"))
        .when(any_of("true"), F.lit("true"))
        .otherwise(F.lit("unknown"))
    )


def image_verdicts(images: DataFrame, requirements=IMAGE_REQUIREMENTS, matrix=SUPPORT_MATRIX) -> DataFrame:
    """Images times the requirements that cover them, with ``requirement_id`` and ``verdict``."""
    entries = [
        F.when(
            F.coalesce(F.col("media_type").isin(*APPLIES_TO[r]), F.lit(False)) if r in APPLIES_TO else F.lit(True),
            F.struct(F.lit(r).alias("requirement_id"), support(r, matrix).alias("verdict")),
        )
        for r in requirements
    ]
    return images.select("*", F.inline(F.array_compact(F.array(*entries))))


def device_support(images: DataFrame, requirements=IMAGE_REQUIREMENTS, matrix=SUPPORT_MATRIX) -> DataFrame:
    """Images with ``device_support``: the gravest verdict of all requirements that cover them."""
    ranks = [
        F.when(
            F.coalesce(F.col("media_type").isin(*APPLIES_TO[r]), F.lit(False)) if r in APPLIES_TO else F.lit(True),
            V.rank(support(r, matrix)),
        )
        for r in requirements
    ]
    names = F.array(*[F.lit(v) for v in ("false", "unknown", "unevaluable", "not_applicable", "true")])
    return images.withColumn(
        "device_support",
        F.coalesce(F.get(names, F.least(*ranks) - 1), F.lit("not_applicable")),
    )


def image_assessments(verdicts: DataFrame, key: str = "package_id") -> DataFrame:
    """(key, requirement_id, verdict, images, compatible, incompatible, unlisted) of shown images."""
    shown = verdicts.filter("displayed")
    n = lambda v: F.count_if(F.col("verdict") == v)
    return shown.groupBy(key, "requirement_id").agg(
        V.combine(F.col("verdict")).alias("combined"),
        F.count("*").alias("images"),
        n("true").alias("compatible"),
        n("false").alias("incompatible"),
        n("unknown").alias("unlisted"),
    ).withColumnRenamed("combined", "verdict")


def image_references(nodes: DataFrame) -> DataFrame:
    """(package_id, document, src, target, alt) of every picture a content document shows."""
    images = nodes.filter((F.col("tag") == "img") & F.col("src").isNotNull() & F.col("well_formed"))
    ref = R.classify_reference(F.col("document"), F.col("src"))
    return images.withColumn("_r", ref).select(
        "package_id", "document", "node", "src", F.col("_r.target").alias("target"), F.col("label").alias("alt")
    )


def image_resources(images: DataFrame, references: DataFrame, covers_: DataFrame) -> DataFrame:
    """Measured images with ``referenced``, ``cover`` and ``displayed``.

    ``images`` holds package_id, path and the image columns.
    """
    targets = references.filter(F.col("target").isNotNull()).select(
        "package_id", F.col("target").alias("path"), F.lit(True).alias("referenced")
    ).distinct()
    named = covers_.select("package_id", F.col("cover").alias("path"), F.lit(True).alias("cover"))
    no = F.lit(False)
    return (
        images.join(targets, ["package_id", "path"], "left")
        .join(named, ["package_id", "path"], "left")
        .withColumn("referenced", F.coalesce("referenced", no))
        .withColumn("cover", F.coalesce("cover", no))
        .withColumn("displayed", F.col("referenced") | F.col("cover"))
    )


def blank_alt(references: DataFrame, unrenderable: DataFrame) -> DataFrame:
    """(package_id, target): pictures a device cannot show and nothing is said in their place."""
    bad = unrenderable.select("package_id", F.col("path").alias("target")).distinct()
    blank = references.filter(F.col("target").isNotNull() & ~has_alt(F.col("alt")))
    return blank.join(bad, ["package_id", "target"], "left_semi").select("package_id", "target").distinct()


def image_mismatch(expected: DataFrame, published: DataFrame) -> DataFrame:
    """Expected pictures with ``reason`` where the book does not carry them.

    ``expected`` holds package_id, reference, sha256, is_cover; ``published`` package_id, sha256,
    cover, referenced. Pictures are matched by the bytes they have, never by name.
    """
    carried = published.groupBy("package_id", "sha256").agg(
        F.bool_or("cover").alias("_cover"), F.bool_or("referenced").alias("_ref")
    )
    return (
        expected.join(carried, ["package_id", "sha256"], "left")
        .withColumn(
            "reason",
            F.when(F.col("_ref").isNull(), F.lit("absent-resource"))
            .when(F.col("is_cover") & ~F.col("_cover"), F.lit("cover-not-declared"))
            .when(~F.col("is_cover") & ~F.col("_ref"), F.lit("unreferenced-resource")),
        )
        .drop("_cover", "_ref")
    )


def first_resources(images: DataFrame) -> DataFrame:
    """The first picture of every digest in a document, which gives all its copies their name."""
    rest = [c for c in images.columns if c not in ("doc_id", "sha256")]
    first = images.groupBy("doc_id", "sha256").agg(F.min_by(F.struct(*rest), "node").alias("_r"))
    return first.select("doc_id", "sha256", "_r.*")


def image_reduction(images: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, images, reduced, minimum, median, maximum) of scale percents, covers left out.

    The upper median: of an even number, the larger of the two in the middle. Scales are counted
    per value first, and there are at most 101 values however many pictures a document has.
    """
    per_value = (
        images.filter(~F.col("cover"))
        .groupBy(key, "scale_percent")
        .agg(F.count("*").alias("n"))
        .groupBy(key)
        .agg(
            F.array_sort(F.collect_list(F.struct("scale_percent", "n"))).alias("_v"),
            F.sum("n").alias("images"),
            F.coalesce(F.sum(F.when(F.col("scale_percent") < 100, F.col("n"))), F.lit(0)).alias("reduced"),
        )
    )
    half = F.floor(F.col("images") / 2)
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("at"))
    median = F.aggregate(
        "_v",
        start,
        lambda acc, e: F.struct(
            (acc["seen"] + e["n"]).alias("seen"),
            F.when(acc["at"].isNull() & (acc["seen"] + e["n"] > half), e["scale_percent"].cast("int"))
            .otherwise(acc["at"])
            .alias("at"),
        ),
        lambda acc: acc["at"],
    )
    return per_value.select(
        key,
        "images",
        "reduced",
        F.element_at("_v", 1)["scale_percent"].alias("minimum"),
        median.alias("median"),
        F.element_at("_v", -1)["scale_percent"].alias("maximum"),
    )


# --- conformance --------------------------------------------------------------------------------

CONFORMANCE = (
    "struct<checker:struct<checkerVersion:string,nFatal:bigint,nError:bigint,nWarning:bigint,nUsage:bigint>,"
    "messages:array<struct<ID:string,severity:string,message:string,"
    "locations:array<struct<path:string,line:bigint,column:bigint>>>>>"
)


def conformance(reports: DataFrame, key: str, output: str) -> DataFrame:
    """(key, version, fatal, error, warning, usage, valid) from a checker's JSON output.

    Output without a checker version is no result: ``valid`` is NULL.
    """
    parsed = reports.select(key, F.from_json(F.col(output), CONFORMANCE).alias("_c"))
    n = lambda f: F.coalesce(F.col(f"_c.checker.{f}"), F.lit(0).cast("bigint"))
    there = F.col("_c.checker.checkerVersion").isNotNull()
    return parsed.select(
        key,
        F.col("_c.checker.checkerVersion").alias("version"),
        n("nFatal").alias("fatal"),
        n("nError").alias("error"),
        n("nWarning").alias("warning"),
        n("nUsage").alias("usage"),
        F.when(there, (n("nFatal") == 0) & (n("nError") == 0)).alias("valid"),
    )


def conformance_messages(reports: DataFrame, key: str, output: str) -> DataFrame:
    """(key, path, line, column, id, severity, message); sort by these where their order is to be shown."""
    parsed = reports.select(key, F.from_json(F.col(output), CONFORMANCE).alias("_c"))
    rows = parsed.select(key, F.explode("_c.messages").alias("m"))
    where = F.get("m.locations", F.lit(0))
    return rows.select(
        key,
        F.coalesce(where["path"], F.lit("")).alias("path"),
        F.coalesce(where["line"], F.lit(0).cast("bigint")).alias("line"),
        F.coalesce(where["column"], F.lit(0).cast("bigint")).alias("column"),
        F.coalesce("m.ID", F.lit("")).alias("id"),
        F.col("m.severity").alias("severity"),
        F.col("m.message").alias("message"),
    )


def severity_counts(messages: DataFrame, key: str) -> DataFrame:
    return messages.groupBy(key, "severity").agg(F.count("*").alias("n"))
