"""Structure survey: counts and places of every construct, segments, and text of a document."""

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions.text import collapse_whitespace, glyph_count, codepoint, strip_whitespace
from corpusaudit.session import materialise
from corpusaudit.sources import tree

# Markers of a printed page break, and the attributes that may carry them.
PAGE_BREAK_MARKERS = ("doc-pagebreak", "pagebreak")
PAGE_BREAK_ATTRIBUTES = ("epub:type", "role", "class")
DECIMAL_STYLES = ("Decimal", "DefaultStyle", "1", "")
# Kinds whose identifier is a link target of the source.
IDENTIFIED = ("Div", "Span", "Header", "Code", "Image", "Link")


def _blank(text: Column) -> Column:
    return F.length(strip_whitespace(F.coalesce(text, F.lit("")))) == 0


def is_page_break(
    classes: Column, attrs: Column, markers=PAGE_BREAK_MARKERS, names=PAGE_BREAK_ATTRIBUTES
) -> Column:
    """Whether a class word, or the whole value of a named attribute, is a page-break marker."""
    empty = F.array().cast("array<string>")
    named = F.filter(
        F.coalesce(F.map_entries(attrs), F.array().cast("array<struct<key:string,value:string>>")),
        lambda e: F.lower(e["key"]).isin(*names),
    )
    said = F.transform(named, lambda e: F.lower(e["value"]))
    if "class" in names:
        said = F.concat(said, F.transform(F.coalesce(classes, empty), lambda c: F.lower(c)))
    return F.coalesce(F.arrays_overlap(said, F.array(*map(F.lit, markers))), F.lit(False))


def is_renumbered(start: Column, style: Column) -> Column:
    """Whether an ordered list has numbering of its own: another start, or no decimal style."""
    restarted = F.coalesce(start != 1, F.lit(False))
    return restarted | ~F.coalesce(style, F.lit("")).isin(*DECIMAL_STYLES)


def measure(nodes: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row per document: everything a reader meets, counted in one pass.

    With ``documents``, those without any node have a row of zeros.
    """
    if documents is not None:
        return documents.select("doc_id").join(measure(nodes), "doc_id", "left").fillna(0)
    kind, measured = F.col("kind"), F.col("measured")
    count = lambda c: F.count_if(measured & c)
    lists = kind == "OrderedList"
    named = F.col("ident").isNotNull() & (F.col("ident") != "")
    return nodes.groupBy("doc_id").agg(
        count(F.col("read_block") == F.col("node")).alias("blocks"),
        count(kind == "Note").alias("notes"),
        count(kind == "Image").alias("images"),
        count((kind == "Image") & _blank(F.col("label"))).alias("images_without_alt"),
        count(kind == "Link").alias("links"),
        count(lists).alias("ordered_lists"),
        count(lists & is_renumbered(F.col("list_start"), F.col("list_style"))).alias(
            "renumbered_lists"
        ),
        count(kind.isin(*IDENTIFIED) & named).alias("identifiers"),
        count(kind == "Header").alias("headings"),
        count(is_page_break(F.col("classes"), F.col("attrs"))).alias("page_breaks"),
    )


def visible_glyphs(names) -> Column:
    """Sum over nodes: how often the named code points occur in visible text."""
    shown = F.col("text_seg").isNotNull() & F.col("text").isNotNull() & ~F.col("kind").isin(*tree.RAW)
    each = [glyph_count(F.col("text"), codepoint(n)) for n in names]
    return F.coalesce(F.sum(F.when(shown, sum(each[1:], each[0]))), F.lit(0))


def heading_levels(nodes: DataFrame) -> DataFrame:
    """(doc_id, level, n) of measured headings."""
    heads = nodes.filter((F.col("kind") == "Header") & F.col("measured"))
    return heads.groupBy("doc_id", "level").agg(F.count("*").alias("n"))


def _surveyed(kind: Column) -> Column:
    return ~kind.isin(*tree.OTHER, *tree.SUB_TYPES) & ~kind.startswith("#")


def construct_counts(nodes: DataFrame, runs: bool = False) -> DataFrame:
    """(doc_id, kind, n): every construct of body and metadata.

    With ``runs``, words and spaces that came as one row (``tree.RUN``) count as the nodes they are.
    """
    counts = nodes.filter(_surveyed(F.col("kind"))).groupBy("doc_id", "kind").agg(
        F.count("*").alias("n")
    )
    if not runs:
        return counts
    held = nodes.filter(F.col("kind") == tree.RUN).groupBy("doc_id").agg(F.sum("level").alias("_w"), F.sum("list_start").alias("_s"))
    said = [F.struct(F.lit(kind).alias("kind"), F.col(c).alias("n")) for kind, c in (("Str", "_w"), ("Space", "_s"))]
    words = held.select("doc_id", F.inline(F.array(*said))).filter("n > 0")
    return counts.unionByName(words).groupBy("doc_id", "kind").agg(F.sum("n").alias("n"))


def construct_locations(nodes: DataFrame, kinds=None) -> DataFrame:
    """(doc_id, kind, n, locations): counts and JSON pointers in reading order.

    Name the ``kinds`` wanted: places of every word of a document help nobody. One list holds
    the places of one kind in one document, whose text was one input row.
    """
    chosen = nodes.filter(_surveyed(F.col("kind")))
    if kinds is not None:
        chosen = chosen.filter(F.col("kind").isin(*kinds))
    placed = F.array_sort(F.collect_list(F.struct("node", "pointer")))
    return chosen.groupBy("doc_id", "kind").agg(
        F.count("*").alias("n"), F.transform(placed, lambda p: p["pointer"]).alias("locations")
    )


def unsupported_constructs(counts: DataFrame, modelled=None, vocabulary=None) -> DataFrame:
    """Constructs outside the modelled set, with ``recognised`` for those the vocabulary has.

    ``modelled`` and ``vocabulary`` may be tables with a column ``kind``; the fixed lists
    serve where none is given.
    """
    if modelled is None:
        left = counts.filter(~F.col("kind").isin(*tree.MODELLED))
    else:
        left = counts.join(modelled.select("kind").distinct(), "kind", "left_anti")
    if vocabulary is None:
        return left.withColumn("recognised", F.col("kind").isin(*tree.BLOCKS, *tree.INLINES))
    known = vocabulary.select("kind", F.lit(True).alias("recognised")).distinct()
    return left.join(known, "kind", "left").withColumn(
        "recognised", F.coalesce("recognised", F.lit(False))
    )


def _visible(nodes: DataFrame) -> DataFrame:
    return nodes.filter(
        F.col("text_seg").isNotNull() & F.col("text").isNotNull() & ~F.col("kind").isin(*tree.RAW)
    )


def segments(nodes: DataFrame, collapse: bool = False) -> DataFrame:
    """(doc_id, text_seg, text): visible text, one row per block, empty blocks left out.

    Text is trimmed, and white space collapsed too where the source is markup.
    """
    shape = collapse_whitespace if collapse else strip_whitespace
    parts = F.array_sort(F.collect_list(F.struct("node", "text")))
    built = (
        _visible(nodes)
        .groupBy("doc_id", "text_seg")
        .agg(shape(F.array_join(F.transform(parts, lambda p: p["text"]), "")).alias("text"))
    )
    return built.filter(F.col("text") != "")


def visible_segments(nodes: DataFrame) -> DataFrame:
    """Segments of document trees in reading order, with figure captions placed by their rule.

    The body of a figure comes before its caption, and a caption segment that only repeats a
    segment of the body is dropped.
    """
    whole = segments(nodes)
    figures = nodes.filter(F.col("kind") == "Figure").select(
        "doc_id", F.col("node").alias("_fig"), "end_node", F.col("pointer").alias("_at")
    )
    owners = nodes.filter(F.col("text_seg") == F.col("node")).select(
        "doc_id", F.col("node").alias("text_seg"), "pointer"
    )
    # Innermost figure of each segment; most documents have none and meet no join partner.
    held = (
        owners.join(figures, "doc_id")
        .filter(F.col("text_seg").between(F.col("_fig"), F.col("end_node")))
        .groupBy("doc_id", "text_seg")
        .agg(F.max(F.struct("_fig", "_at", "pointer", "end_node")).alias("_f"))
        .select(
            "doc_id",
            "text_seg",
            "_f._fig",
            F.col("_f.end_node").alias("_last"),
            F.col("_f.pointer").startswith(F.concat("_f._at", F.lit("/c/1/"))).alias("_caption"),
        )
    )
    marked = whole.join(held, ["doc_id", "text_seg"], "left")
    body = (
        marked.filter(~F.col("_caption"))
        .select("doc_id", "_fig", "text", F.lit(True).alias("_said"))
        .distinct()
    )
    kept = marked.join(body, ["doc_id", "_fig", "text"], "left").filter(
        ~(F.coalesce("_caption", F.lit(False)) & F.coalesce("_said", F.lit(False)))
    )
    # A caption is read behind the whole figure it belongs to.
    place = F.struct(
        F.when(F.col("_caption"), F.col("_last")).otherwise(F.col("text_seg")).alias("a"),
        F.coalesce("_caption", F.lit(False)).alias("b"),
        F.col("text_seg").alias("c"),
    )
    return kept.select("doc_id", place.alias("place"), "text")


def render_text(segs: DataFrame, order: str = "place") -> DataFrame:
    """(doc_id, text): the visible text of each document, one line per segment."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    return segs.groupBy("doc_id").agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text")
    )


def meta_text(nodes: DataFrame) -> DataFrame:
    """(doc_id, name, value): top-level metadata as the text a reader would see."""
    meta = nodes.filter(F.col("root") == "meta")
    named = meta.withColumn("name", F.split_part("pointer", F.lit("/"), F.lit(3)))
    # Items of a list are joined by a comma, blocks by a space.
    item = F.regexp_extract("pointer", r"^/meta/[^/]+/c/(\d+)", 1)
    tops = named.filter(F.col("depth") == 0).select(
        "doc_id", "name", F.col("kind").alias("shape")
    )
    leaves = named.filter(F.col("text").isNotNull() & ~F.col("kind").isin(*tree.RAW)).withColumn(
        "item", F.when(item != "", item.cast("int"))
    )
    per_item = (
        leaves.join(tops, ["doc_id", "name"])
        .filter(F.col("shape").isin("MetaString", "MetaInlines", "MetaBlocks", "MetaList"))
        .withColumn("item", F.when(F.col("shape").isin("MetaList", "MetaBlocks"), F.col("item")))
        .groupBy("doc_id", "name", "shape", "item")
        .agg(F.array_sort(F.collect_list(F.struct("node", "text"))).alias("_p"))
        .withColumn("value", strip_whitespace(F.array_join(F.transform("_p", lambda p: p["text"]), "")))
        .filter(F.col("value") != "")
    )
    parts = F.array_sort(F.collect_list(F.struct("item", "value")))
    values = F.transform(parts, lambda p: p["value"])
    return (
        per_item.groupBy("doc_id", "name", "shape")
        .agg(
            F.when(F.first("shape") == "MetaBlocks", F.array_join(values, " "))
            .otherwise(F.array_join(values, ", "))
            .alias("value")
        )
        .drop("shape")
    )


def glyph_hits(texts: DataFrame, key: str, text: str, glyphs) -> DataFrame:
    """(key, glyph, n) for every listed code point that occurs. Unusable names are passed over."""
    usable = [g for g in glyphs if codepoint(g)]
    counts = F.array(
        *[
            F.struct(F.lit(g).alias("glyph"), glyph_count(F.col(text), codepoint(g)).alias("n"))
            for g in usable
        ]
    )
    return texts.select(key, F.inline(counts)).filter(F.col("n") > 0)


def subtree_digests(nodes: DataFrame) -> DataFrame:
    """(doc_id, node, parent, depth, root, kind, size, digest) of every node with all below it.

    A digest is made of the node's own facts and of its children's digests in order, level by level from
    the deepest up, so equal subtrees agree wherever they stand: positions, pointers and depth play no part.
    A node that does not say how deep it lies is of depth 0. Each level is written and read once; a level
    groups no more than the children of its own nodes.

    Attributes are put in key order first. Repeated rows are children of their own.
    """
    attrs = F.array_join(
        F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";"
    )
    fields = ["kind", "tag", "level", "ident", "href", "src", "list_start", "list_style", "text"]
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in fields]
    parts += [F.coalesce(F.array_join("classes", " "), F.lit("\x00")), F.coalesce(attrs, F.lit("\x00"))]
    own = F.sha2(F.concat_ws("\x1f", *parts), 256)
    level = F.coalesce("depth", F.lit(0))
    base = materialise(nodes.select("doc_id", "node", "parent", level.alias("depth"), "root", "kind", own.alias("own")), "depth")
    deepest = base.agg(F.max("depth")).first()[0]
    whole, below = None, None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        here = base.filter(F.col("depth") == depth)
        size, children = F.lit(1).cast("long"), F.lit("")
        if below is not None:
            held = F.array_sort(F.collect_list(F.struct("node", "digest")))
            told = below.filter("parent IS NOT NULL").groupBy("doc_id", F.col("parent").alias("node")).agg(
                F.array_join(F.transform(held, lambda c: c["digest"]), "").alias("_children"), F.sum("size").alias("_size")
            )
            here = here.join(told, ["doc_id", "node"], "left")
            size, children = size + F.coalesce("_size", F.lit(0).cast("long")), F.coalesce("_children", F.lit(""))
        below = materialise(
            here.select(
                "doc_id", "node", "parent", "depth", "root", "kind", size.alias("size"), F.sha2(F.concat("own", children), 256).alias("digest")
            )
        )
        whole = below if whole is None else whole.unionByName(below)
    if whole is None:
        return base.select("doc_id", "node", "parent", "depth", "root", "kind", F.lit(0).cast("long").alias("size"), F.col("own").alias("digest"))
    return whole


def tree_digest(nodes: DataFrame, subtrees: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest) of a document's nodes: equal trees agree, whatever order rows came in.

    ``subtrees`` are the digests of all subtrees, where they are there already.
    """
    subtrees = subtree_digests(nodes) if subtrees is None else subtrees
    ordered = F.array_sort(F.collect_list(F.struct("node", F.concat("root", F.lit(":"), "digest").alias("h"))))
    return (
        subtrees.filter("depth = 0")
        .groupBy("doc_id")
        .agg(F.sha2(F.array_join(F.transform(ordered, lambda e: e["h"]), ""), 256).alias("digest"))
    )


def repeated_subtrees(subtrees: DataFrame) -> DataFrame:
    """(kind, digest, n, documents, doc_id, node) of each different subtree: how often, and where first.

    One aggregate on the digest over the whole corpus, summed before it is shuffled.
    """
    return subtrees.groupBy("kind", "digest").agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"), F.min(F.struct("doc_id", "node")).alias("_first")
    ).select("kind", "digest", "n", "documents", "_first.doc_id", "_first.node")



def worst(measures: DataFrame, by: str, k: int, key: str = "doc_id") -> DataFrame:
    """The ``k`` rows with the largest measure, ties by key."""
    return measures.orderBy(F.col(by).desc(), key).limit(k)


union_all = functools.partial(functools.reduce, DataFrame.unionByName)
