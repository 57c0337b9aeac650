"""Links: which leave the book, which are dead, how dense they are, and where they lead."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions import refs as R

KINDS = (
    "cross-reference",
    "dead-link",
    "footnote-back-link",
    "footnote-reference",
    "web-link",
)


def marker(attrs: Column) -> Column:
    """The note marker a link carries in its role or type."""
    said = F.concat_ws(" ", F.try_element_at(attrs, F.lit("epub:type")), F.try_element_at(attrs, F.lit("role")))
    return R.link_marker(F.split(F.lower(said), r"\s+"))


def links_of(nodes: DataFrame, schemes=R.EXCLUDED_SCHEMES, needs_text=True, *extra: str) -> DataFrame:
    """One row per measured link, straight from the node rows: no shuffle."""
    href = F.col("href")
    return nodes.filter((F.col("kind") == "Link") & href.isNotNull() & F.col("measured")).select(
        "doc_id",
        "node",
        "read_block",
        "href",
        F.col("label").alias("text"),
        F.octet_length(href).cast("bigint").alias("href_bytes"),
        R.is_external(href, schemes).alias("external"),
        R.is_recorded(href, F.col("label"), schemes, needs_text).alias("recorded"),
        marker(F.col("attrs")).alias("marked"),
        R.path_part(href).alias("path"),
        R.fragment(href).alias("fragment"),
        *extra,
    )


def anchors_of(nodes: DataFrame) -> DataFrame:
    """(doc_id, ident): every identifier once per document."""
    named = nodes.filter(F.col("ident").isNotNull() & (F.col("ident") != ""))
    return named.select("doc_id", "ident").distinct()


def resolve_in_document(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """Add ``resolves`` and ``kind`` where a link can only lead into its own document.

    Only links that name a bare fragment are looked up; all others carry NULL into the join,
    which Spark then need not shuffle to one place: the key is the pair (document, fragment).
    """
    wanted = F.when(~F.col("external") & (F.col("path") == "") & (F.col("fragment") != ""), F.col("fragment"))
    known = anchors.select("doc_id", F.col("ident").alias("_ident"), F.lit(True).alias("_known"))
    found = links.withColumn("_ident", wanted).join(known, ["doc_id", "_ident"], "left")
    return with_kind(
        found.withColumn("resolves", F.coalesce("_known", F.lit(False))).drop("_ident", "_known")
    )


def with_kind(links: DataFrame) -> DataFrame:
    return links.withColumn(
        "kind", R.link_kind(F.col("external"), F.col("resolves"), F.col("marked"))
    )


def resolve_in_package(links: DataFrame, members: DataFrame, anchors: DataFrame) -> DataFrame:
    """Add ``target_document``, ``resolves`` and ``kind`` where links lead between documents.

    ``links`` and ``anchors`` carry package_id and document; ``members`` holds package_id, name.
    """
    document = F.col("document")
    joined = R.join_path(document, R.percent_decode(F.col("path")))
    target = F.when(~F.col("external"), F.when(F.col("path") == "", document).otherwise(joined))
    known = members.select("package_id", F.col("name").alias("_target"), F.lit(True).alias("_member")).distinct()
    idents = anchors.select(
        "package_id",
        F.col("document").alias("_target"),
        F.col("ident").alias("_fragment"),
        F.lit(True).alias("_anchor"),
    ).distinct()
    fragment = R.percent_decode(F.col("fragment"))
    found = (
        links.withColumn("_target", target)
        .withColumn("_fragment", F.when(F.col("fragment") != "", fragment))
        .join(known, ["package_id", "_target"], "left")
        .join(idents, ["package_id", "_target", "_fragment"], "left")
    )
    reaches = (
        F.col("_target").isNotNull()
        & ((F.col("path") == "") | F.coalesce("_member", F.lit(False)))
        & (F.col("_fragment").isNull() | F.coalesce("_anchor", F.lit(False)))
    )
    return with_kind(
        found.withColumn("resolves", reaches)
        .withColumn("target_document", F.when(reaches, F.col("_target")))
        .drop("_target", "_fragment", "_member", "_anchor")
    )


def link_facts(links: DataFrame, keys=("doc_id",), block=("read_block",)) -> DataFrame:
    """One row per document: links by kind, recorded links, block maxima, longest href, notes.

    Folded per block first and per document then, so both rounds start with a partial sum.
    """
    recorded = F.col("recorded")
    apart = ~F.col("kind").isin("footnote-reference", "footnote-back-link")
    noted = F.col("marked") == "noteref"
    per_block = links.groupBy(*keys, *block).agg(
        F.count("*").alias("total"),
        F.count_if(recorded).alias("recorded"),
        F.count_if(recorded & apart).alias("non_footnote"),
        F.max(F.when(recorded, F.col("href_bytes"))).alias("href_bytes"),
        F.count_if(noted).alias("note_references"),
        F.count_if(noted & ~F.col("resolves")).alias("note_unresolved"),
        F.count_if(recorded & ~F.col("resolves")).alias("unresolved_recorded"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS],
    )
    zero = F.lit(0).cast("bigint")
    return per_block.groupBy(*keys).agg(
        F.sum("total").alias("links"),
        F.sum("recorded").alias("recorded"),
        F.max("recorded").alias("max_per_block"),
        F.max("non_footnote").alias("max_non_footnote_per_block"),
        F.coalesce(F.max("href_bytes"), zero).alias("max_href_bytes"),
        F.sum("note_references").alias("note_references"),
        F.sum("note_unresolved").alias("note_unresolved"),
        F.sum("unresolved_recorded").alias("unresolved_recorded"),
        *[F.sum(k).alias(k.replace("-", "_")) for k in KINDS],
    )


def over_all(facts: DataFrame, documents: DataFrame, *keys: str) -> DataFrame:
    """Facts of every document: one that has none of what was counted has zeros, not no row."""
    return documents.select(*keys).join(facts, list(keys), "left").fillna(0)


def note_targets(links: DataFrame, key: str = "package_id") -> DataFrame:
    """(key, target_documents): in how many documents the note references of a package land."""
    landed = links.filter((F.col("marked") == "noteref") & F.col("target_document").isNotNull())
    return (
        landed.select(key, "target_document")
        .distinct()
        .groupBy(key)
        .agg(F.count("*").alias("target_documents"))
    )


def dead_links(links: DataFrame, *order: str) -> DataFrame:
    """Dead links, ordered by document and href."""
    return links.filter(F.col("kind") == "dead-link").orderBy(*(order or ("doc_id", "href", "node")))


def anchor_counts(nodes: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Elements with an identifier per chapter."""
    return nodes.groupBy(*keys).agg(
        F.count_if(F.col("ident").isNotNull() & (F.col("ident") != "")).alias("anchors")
    )


def distinct_locators(refs: DataFrame, key: str, locator: str, position: str) -> DataFrame:
    """(key, locator, occurrences, first): every locator once, in first-seen order per document."""
    return refs.groupBy(key, locator).agg(
        F.count("*").alias("occurrences"), F.min(position).alias("first")
    )


def remote_references(images: DataFrame, covers: DataFrame) -> DataFrame:
    """(doc_id, identifier, locator, occurrences) to retrieve, the cover first and never twice.

    ``images`` holds doc_id, src, node; ``covers`` doc_id, cover. A document with a locator that
    is neither local nor http is refused as a whole; ``first_unsupported`` names it.
    """
    from pyspark.sql import Window

    remote = images.filter(R.locator_class(F.col("src")) == "remote")
    seen = distinct_locators(remote, "doc_id", "src", "node").withColumnRenamed("src", "locator")
    # Numbering needs a whole document's distinct locators, which one page's text bounds.
    order = Window.partitionBy("doc_id").orderBy("first")
    numbered = seen.select(
        "doc_id",
        F.concat(F.lit("image-"), F.row_number().over(order)).alias("identifier"),
        "locator",
        "occurrences",
    )
    extra = covers.filter(R.locator_class(F.col("cover")) == "remote").select(
        "doc_id",
        F.lit("cover-image").alias("identifier"),
        F.col("cover").alias("locator"),
        F.lit(1).cast("bigint").alias("occurrences"),
    )
    new = extra.join(seen.select("doc_id", "locator"), ["doc_id", "locator"], "left_anti")
    return new.select(*numbered.columns).unionByName(numbered)


def first_unsupported(images: DataFrame) -> DataFrame:
    """(doc_id, locator): the first locator in reading order that cannot be made local."""
    bad = images.filter(R.locator_class(F.col("src")) == "unsupported")
    return bad.groupBy("doc_id").agg(F.min_by("src", "node").alias("locator"))
