"""Rewriting documents as set operations on their nodes.

The order is meaning: captions, callouts, links, notes, raw markup, identifiers, attributes.

While documents are rewritten, ``node`` and ``end_node`` are fractions within a ``part``: part 0 is
the body, part n the document of note n. A node may then be put between two others, and a note
moved behind the body, without renumbering anything. The chain ends with labels made of both; ``dense`` counts
whole numbers for those who need them.

Every rewrite first gathers the few rows it is about - links, notes, figures - into a small table
and then passes over the nodes once. Joins carry the document in their key, so rows without a
partner spread as evenly as documents do.
"""

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit.functions import refs as R
from corpusaudit.functions.names import ANCHOR_RESERVE, bounded_identifier
from corpusaudit.functions.text import remove_whitespace, strip_whitespace
from corpusaudit.operators.nesting import innermost
from corpusaudit.operators.structure import IDENTIFIED
from corpusaudit.rules import ACTIVATIONS
from corpusaudit.schema import NODES
from corpusaudit.session import materialise
from corpusaudit.sources import tree

DOC = ["doc_id", "part"]
_FRACTIONS = ("node", "end_node", "parent", "read_block", "text_seg", "note")
# Fixed values of converted notes.
NOTEREF_ATTRS = (("epub:type", "noteref"), ("role", "doc-noteref"))
BACKLINK_ATTRS = (("epub:type", "backlink"), ("role", "doc-backlink"))


def working(nodes: DataFrame) -> DataFrame:
    """Nodes ready for rewriting."""
    for name in _FRACTIONS:
        nodes = nodes.withColumn(name, F.col(name).cast("double"))
    return nodes.withColumn("part", F.lit(0).cast("bigint"))


def _columns() -> list[str]:
    return [*NODES.names, "part"]


def _made(rows: DataFrame, **values: Column) -> DataFrame:
    """New nodes: the named columns as given, every other column empty."""
    types = {f.name: f.dataType for f in NODES} | {n: T.DoubleType() for n in _FRACTIONS}
    types["part"] = T.LongType()
    defaults = {
        "sib": F.lit(0),
        "root": F.lit("blocks"),
        "pointer": F.lit(""),
        "measured": F.lit(True),
        "in_image": F.lit(False),
        "closed": F.lit(True),
        "depth": F.lit(0),
    }
    empty = F.lit(None)
    return rows.select(
        *[values.get(c, defaults.get(c, empty)).cast(types[c]).alias(c) for c in _columns()]
    )


def dense(nodes: DataFrame) -> DataFrame:
    """Count positions again: whole numbers in reading order, body first and notes behind it.

    Starts and ends are put in one order; the number of starts so far is the new position of a
    start, and of the last node before an end.
    """
    key = F.struct("part", "node")
    starts = nodes.select("doc_id", key.alias("k"), F.struct("part", "node").alias("at"), F.lit(0).alias("end"))
    ends = nodes.select("doc_id", key.alias("k"), F.struct("part", F.col("end_node").alias("node")).alias("at"), F.lit(1).alias("end"))
    order = Window.partitionBy("doc_id").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, 0)
    counted = starts.unionByName(ends).withColumn(
        "n", (F.sum(1 - F.col("end")).over(order) - 1).cast("int")
    )
    placed = materialise(
        counted.groupBy("doc_id", "k").agg(
            F.max(F.when(F.col("end") == 0, F.col("n"))).alias("_node"),
            F.max(F.when(F.col("end") == 1, F.col("n"))).alias("_end"),
        )
    )
    moved = nodes.withColumn("k", key).join(placed, ["doc_id", "k"])
    # References to other nodes are looked up by their old position in the same part.
    for name in ("parent", "read_block", "text_seg"):
        found = placed.select("doc_id", F.col("k").alias("_k"), F.col("_node").alias("_to"))
        moved = (
            moved.withColumn(
                "_k", F.when(F.col(name).isNotNull(), F.struct("part", F.col(name).alias("node")))
            )
            .join(found, ["doc_id", "_k"], "left")
            .withColumn(name, F.col("_to"))
            .drop("_to", "_k")
        )
    new = {"node": F.col("_node"), "end_node": F.col("_end"), "note": F.lit(None).cast("int")}
    return moved.select(*[new.get(c, F.col(c)).alias(c) for c in NODES.names])


def labelled(nodes: DataFrame) -> DataFrame:
    """Nodes with labels for positions: (part, place), which sort in reading order, the body first.

    A label is given when a node is put in and never changes, whatever is put in or taken out around it,
    so nothing is counted again: consumers sort and group by labels as they do by numbers.
    """
    label = lambda c: F.when(F.col(c).isNotNull(), F.struct("part", F.col(c).alias("place"))).alias(c)
    places = ("node", "end_node", "parent", "read_block", "text_seg")
    new = {c: label(c) for c in places} | {"note": F.lit(None).cast("int").alias("note")}
    return nodes.select(*[new.get(c, F.col(c)) for c in NODES.names])


def _holding(nodes: DataFrame, mark: Column) -> tuple[DataFrame, DataFrame]:
    """Documents with a marked node, gathered apart, and all the others."""
    docs = materialise(nodes.filter(mark).select("doc_id").distinct())
    return (
        materialise(nodes.join(docs, "doc_id", "left_semi")),
        nodes.join(docs, "doc_id", "left_anti"),
    )


def _without(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    return nodes.join(gone.select(*DOC, "node").distinct(), [*DOC, "node"], "left_anti")


# --- captions and callouts ----------------------------------------------------------------------


def derived_captions(nodes: DataFrame) -> DataFrame:
    """Figures whose caption, picture text and following paragraph are the same words.

    (doc_id, part, node, end_node, pointer, text), white space apart. Give it the documents that
    have a figure.
    """
    docs = nodes
    # Siblings of one sequence share the parent and the pointer up to the last step.
    sequence = F.regexp_extract("pointer", r"^(.*)/\d+\z", 1)
    beside = Window.partitionBy(*DOC, "parent", "_seq").orderBy("node")
    blocks = docs.filter(F.col("kind").isin(*tree.BLOCKS)).withColumn("_seq", sequence)
    pairs = (
        blocks.withColumn("_next", F.lead(F.struct("kind", "node", "end_node")).over(beside))
        .filter((F.col("kind") == "Figure") & (F.col("_next.kind") == "Para"))
        .select(
            *DOC,
            F.col("node").alias("fig"),
            F.col("end_node").alias("fig_end"),
            F.col("pointer").alias("fig_at"),
            F.col("_next.node").alias("para"),
            F.col("_next.end_node").alias("para_end"),
        )
    )
    leaves = docs.filter(
        F.col("text").isNotNull() & F.col("text_seg").isNotNull() & ~F.col("kind").isin(*tree.RAW)
    ).select(*DOC, "node", "pointer", "text")
    # A leaf belongs to the last figure-with-paragraph begun before it, if it still lies within.
    marks = pairs.select(*DOC, F.col("fig").alias("node"), F.struct(*pairs.columns[2:]).alias("_p"))
    order = Window.partitionBy(*DOC).orderBy("node")
    tagged = (
        leaves.join(marks, [*DOC, "node"], "full_outer")
        .withColumn("_p", F.last("_p", ignorenulls=True).over(order))
        .filter(F.col("text").isNotNull() & (F.col("node") <= F.col("_p.para_end")))
    )
    role = (
        F.when(F.col("node") >= F.col("_p.para"), F.lit("para"))
        .when(F.col("pointer").startswith(F.concat("_p.fig_at", F.lit("/c/1/"))), F.lit("caption"))
        .otherwise(F.lit("body"))
    )
    texts = (
        tagged.withColumn("_role", role)
        .groupBy(*DOC, "_p", "_role")
        .agg(F.array_sort(F.collect_list(F.struct("node", "text"))).alias("_t"))
        .withColumn(
            "_t", remove_whitespace(F.array_join(F.transform("_t", lambda e: e["text"]), ""))
        )
        .groupBy(*DOC, "_p")
        .agg(*[F.max(F.when(F.col("_role") == r, F.col("_t"))).alias(r) for r in ("body", "caption", "para")])
    )
    same = (F.col("body") != "") & (F.col("body") == F.col("caption")) & (F.col("body") == F.col("para"))
    return texts.filter(same).select(
        *DOC,
        F.col("_p.fig").alias("node"),
        F.col("_p.fig_end").alias("end_node"),
        F.col("_p.fig_at").alias("pointer"),
        F.col("body").alias("text"),
    )


def suppress_captions(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop derived captions. Returns the nodes and what was dropped: (doc_id, node, text)."""
    docs, others = _holding(nodes, F.col("kind") == "Figure")
    found = materialise(derived_captions(docs))
    spans = found.select(
        *DOC, F.col("node").alias("_f"), F.col("end_node").alias("_l"), F.col("pointer").alias("_at")
    )
    captions = (
        docs.select(*DOC, "node", "pointer")
        .join(spans, DOC)
        .filter(
            F.col("node").between(F.col("_f"), F.col("_l"))
            & F.col("pointer").startswith(F.concat("_at", F.lit("/c/1/")))
        )
    )
    return _without(docs, captions).unionByName(others), found.select("doc_id", "node", "text")


def emphasise_callouts(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Callout titles become a paragraph with a strong line; the exact nesting only.

    A ``callout-title`` division that holds nothing but a ``callout-title-inner`` division that
    holds nothing but one plain line. Returns nodes and changes (doc_id, node, text).
    """
    classed = lambda name: F.coalesce(F.array_contains("classes", name), F.lit(False))
    div = F.col("kind") == "Div"
    nodes, others = _holding(nodes, div & classed("callout-title"))
    outer = nodes.filter(div & classed("callout-title")).select(*DOC, F.col("node").alias("o"))
    only = (
        nodes.select(*DOC, F.col("parent").alias("o"), "node", "kind", "classes")
        .join(outer, [*DOC, "o"], "left_semi")
        .groupBy(*DOC, "o")
        .agg(
            F.count("*").alias("n"),
            F.first(F.struct("node", "kind", "classes")).alias("c"),
        )
        .filter(
            (F.col("n") == 1)
            & (F.col("c.kind") == "Div")
            & F.coalesce(F.array_contains("c.classes", "callout-title-inner"), F.lit(False))
        )
        .select(*DOC, "o", F.col("c.node").alias("i"))
    )
    held = nodes.select(*DOC, F.col("parent").alias("i"), "node", "kind")
    lines = materialise(
        held.join(only, [*DOC, "i"])
        .groupBy(*DOC, "o", "i")
        .agg(F.count("*").alias("n"), F.first(F.struct("node", "kind")).alias("c"))
        .filter((F.col("n") == 1) & (F.col("c.kind") == "Plain"))
        .select(*DOC, "o", "i", F.col("c.node").alias("p"))
    )
    roles = lines.select(
        *DOC,
        F.inline(
            F.array(
                F.struct(F.col("o").alias("node"), F.lit("Para").alias("_as"), F.col("o"), F.col("i")),
                F.struct(F.col("i").alias("node"), F.lit("Strong").alias("_as"), F.col("o"), F.col("i")),
            )
        ),
    ).select(*DOC, "node", "_as")
    plain = lambda kind, col: F.when(F.col("_as").isNull(), F.col(col)).otherwise(F.lit(None).cast(kind))
    relabelled = (
        nodes.join(roles, [*DOC, "node"], "left")
        .withColumn("kind", F.coalesce("_as", "kind"))
        .withColumn("ident", plain("string", "ident"))
        .withColumn("classes", plain("array<string>", "classes"))
        .withColumn("attrs", plain("map<string,string>", "attrs"))
        .drop("_as")
    )
    words = (
        nodes.filter(F.col("text").isNotNull() & F.col("text_seg").isNotNull())
        .join(lines.withColumnRenamed("p", "text_seg"), [*DOC, "text_seg"])
        .groupBy("doc_id", F.col("o").alias("node"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("n"), "text"))).alias("t"))
        .select("doc_id", "node", F.array_join(F.transform("t", lambda e: e["text"]), "").alias("text"))
    )
    # The plain line goes; what it held hangs on the strong one and reads as the new paragraph.
    moved = lines.select(*DOC, F.col("p").alias("_p"), F.col("o").alias("_o"), F.col("i").alias("_i"))
    shifted = (
        relabelled.withColumn("_p", F.coalesce("text_seg", "parent"))
        .join(moved, [*DOC, "_p"], "left")
        .withColumn("parent", F.when(F.col("parent") == F.col("_p"), F.coalesce("_i", "parent")).otherwise(F.col("parent")))
        .withColumn("text_seg", F.coalesce(F.when(F.col("text_seg").isNotNull(), F.col("_o")), "text_seg"))
        .withColumn("read_block", F.coalesce(F.when(F.col("read_block").isNotNull(), F.col("_o")), "read_block"))
    )
    gone = F.coalesce(F.col("_o").isNotNull() & (F.col("node") == F.col("_p")), F.lit(False))
    kept = shifted.filter(~gone).select(*_columns())
    return kept.unionByName(others.select(*_columns())), words


# --- links --------------------------------------------------------------------------------------


def classify_links(nodes: DataFrame, schemes=R.EXCLUDED_SCHEMES, needs_text=True) -> DataFrame:
    """Every link of a source with its kind, and ``removed`` where it loses its target.

    Web and dead links always do. A cross-reference does only where the document has a note, as
    otherwise it may be the note reference the rule exists to protect.
    """
    links = nodes.filter(F.col("kind") == "Link").select(
        *DOC,
        "node",
        "parent",
        F.col("href").alias("target"),
        F.col("label").alias("text"),
        "ident",
        "classes",
        "attrs",
        R.is_external(F.col("href"), schemes).alias("external"),
        R.is_recorded(F.col("href"), F.col("label"), schemes, needs_text).alias("recorded"),
        F.when(R.path_part(F.col("href")) == "", R.fragment(F.col("href"))).alias("_frag"),
    )
    known = (
        nodes.filter(F.col("measured") & F.col("kind").isin(*IDENTIFIED) & (F.col("ident") != ""))
        .select("doc_id", F.col("ident").alias("_frag"), F.lit(True).alias("_known"))
        .distinct()
    )
    notes = (
        nodes.filter((F.col("kind") == "Note") & F.col("measured"))
        .groupBy("doc_id")
        .agg(F.count("*").alias("notes"))
    )
    found = links.join(known, ["doc_id", "_frag"], "left").join(notes, "doc_id", "left")
    resolves = ~F.col("external") & F.coalesce("_known", F.lit(False))
    kind = R.link_kind(F.col("external"), resolves, F.lit(""))
    return (
        found.withColumn("kind", kind)
        .withColumn("apparatus", F.coalesce(F.col("notes") > 0, F.lit(False)))
        .withColumn("removed", (F.col("kind") != "cross-reference") | F.col("apparatus"))
        .drop("_frag", "_known", "notes")
    )


def strip_links(
    nodes: DataFrame, schemes=R.EXCLUDED_SCHEMES, needs_text=True, active: bool | None = None
) -> tuple[DataFrame, DataFrame]:
    """Take targets away, keep the words. Returns nodes and every classified link.

    A link with an identifier, class or attribute stays as a span; a bare one leaves its place to
    what it held.
    """
    active = ACTIVATIONS["strip_non_apparatus_hrefs"][0] if active is None else active
    links = materialise(classify_links(nodes, schemes, needs_text))
    if not active:
        links = links.withColumn("removed", F.lit(False))
        return nodes, links
    bare = (
        F.coalesce(F.col("ident") == "", F.lit(True))
        & F.coalesce(F.size("classes") <= 0, F.lit(True))
        & F.coalesce(F.size(F.map_keys("attrs")) <= 0, F.lit(True))
    )
    gone = links.filter(F.col("removed")).select(*DOC, "node", F.col("parent").alias("_up"), bare.alias("_bare"))
    # Only links are looked up, and a parent only where somebody wants it: with one row for each key, Spark drops a join nobody reads.
    link = F.coalesce(F.col("kind") == "Link", F.lit(False))
    marked = nodes.filter(link).join(gone.select(*DOC, "node", "_bare"), [*DOC, "node"], "left")
    kept = (
        marked.filter(~F.coalesce("_bare", F.lit(False)))
        .withColumn("href", F.when(F.col("_bare").isNull(), F.col("href")))
        .withColumn("kind", F.when(F.col("_bare").isNull(), F.col("kind")).otherwise(F.lit("Span")))
        .select(*_columns())
        .unionByName(nodes.filter(~link).select(*_columns()))
    )
    lifted = (
        gone.filter("_bare")
        .groupBy(*DOC, F.col("node").alias("parent"))
        .agg(F.max("_up").alias("_up"), F.lit(True).alias("_lift"))
    )
    rehung = kept.join(lifted, [*DOC, "parent"], "left").withColumn(
        "parent", F.when(F.col("_lift"), F.col("_up")).otherwise(F.col("parent"))
    )
    return rehung.select(*_columns()), links


def link_counts(links: DataFrame) -> DataFrame:
    """(doc_id, kind, before, removed, after) of classified links."""
    return links.groupBy("doc_id", "kind").agg(
        F.count("*").alias("before"),
        F.count_if("removed").alias("removed"),
        F.count_if(~F.col("removed")).alias("after"),
    )


def interlock(docs: DataFrame, links: DataFrame, active: bool | None = None) -> DataFrame:
    """(doc_id, engaged, in_book_links): in-book links kept because no note was recognised."""
    active = ACTIVATIONS["strip_non_apparatus_hrefs"][0] if active is None else active
    counted = links.groupBy("doc_id").agg(
        F.count_if(F.col("kind") != "web-link").alias("in_book_links"),
        F.bool_or("apparatus").alias("apparatus"),
    )
    n = F.coalesce("in_book_links", F.lit(0).cast("bigint"))
    return docs.select("doc_id").join(counted, "doc_id", "left").select(
        "doc_id",
        (F.lit(active) & ~F.coalesce("apparatus", F.lit(False)) & (n > 0)).alias("engaged"),
        n.alias("in_book_links"),
    )


# --- notes --------------------------------------------------------------------------------------


def number_notes(nodes: DataFrame) -> DataFrame:
    """Notes with their number in reading order; those in an image's description have none."""
    order = Window.partitionBy("doc_id").orderBy("part", "node")
    return (
        nodes.filter((F.col("kind") == "Note") & ~F.col("in_image"))
        .withColumn("number", F.row_number().over(order).cast("bigint"))
        .select("*")
    )


def number_images(nodes: DataFrame) -> DataFrame:
    """Images with their number in reading order, failures included; none inside a description."""
    order = Window.partitionBy("doc_id").orderBy("part", "node")
    return nodes.filter((F.col("kind") == "Image") & ~F.col("in_image")).withColumn(
        "number", F.row_number().over(order)
    )


def _attrs(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def convert_notes(
    nodes: DataFrame, active: bool | None = None, backlinks: bool | None = None
) -> tuple[DataFrame, DataFrame]:
    """Each note becomes a numbered reference and a document of its own behind the body.

    The first note's heading reads ``Footnotes``, later ones are blank and unlisted; every body
    begins ``Footnote N.`` and may end in a link back. Returns nodes and (doc_id, number, node).
    """
    active = ACTIVATIONS["one_file_per_note"][0] if active is None else active
    backlinks = ACTIVATIONS["footnote_backlinks"][0] if backlinks is None else backlinks
    numbered = materialise(number_notes(nodes))
    changes = numbered.select("doc_id", "number", "node")
    if not active:
        return nodes, changes.limit(0)
    ids = numbered.select("doc_id", F.col("node").alias("note"), F.col("number").alias("_n"), F.col("depth").alias("_d"))
    converted = (F.col("kind") == "Note") & ~F.col("in_image")
    body = nodes.filter(F.col("note").isNull() & ~converted)
    # Rows inside a note move to the note's own part, and its blocks begin segments of their own.
    inner = (
        nodes.filter(F.col("note").isNotNull() & ~converted)
        .join(ids, ["doc_id", "note"])
        .filter(~((F.col("kind") == "#pad") & (F.col("parent") == F.col("note"))))
        .withColumn("part", F.col("_n"))
        .withColumn("depth", F.col("depth") - F.col("_d") - 1)
        .withColumn("parent", F.when(F.col("parent") != F.col("note"), F.col("parent")))
        .withColumn(
            "text_seg", F.when(F.col("text_seg").isNotNull(), F.coalesce("read_block", "text_seg"))
        )
    )
    outer = ids.select("doc_id", "note", F.col("_n").alias("_on"), F.col("_d").alias("_od"))
    notes = (
        numbered.join(outer, ["doc_id", "note"], "left")
        .withColumn("part", F.coalesce("_on", F.lit(0).cast("bigint")))
        .withColumn("text_seg", F.when(F.col("_on").isNotNull(), F.coalesce("read_block", "text_seg")).otherwise(F.col("text_seg")))
        .withColumn("depth", F.col("depth") - F.coalesce(F.col("_od") + 1, F.lit(0)))
        .withColumn("parent", F.when(F.col("_on").isNull() | (F.col("parent") != F.col("note")), F.col("parent")))
        .withColumn("_name", F.col("number").cast("string"))
    )
    first = (
        inner.filter(F.col("parent").isNull())
        .groupBy("doc_id", "part")
        .agg(
            F.min_by(F.struct("node", "kind", "end_node"), "node").alias("first"),
            F.max_by(F.struct("node", "kind", "end_node"), "node").alias("last"),
        )
        .withColumnRenamed("part", "number")
    )
    bodies = materialise(
        notes.select("doc_id", "number", F.col("node").alias("at"), "_name").join(
            first, ["doc_id", "number"], "left"
        )
    )
    made = [*_reference_nodes(notes), *_note_nodes(bodies)]
    if backlinks:
        extra, inner = _backlinks(bodies, inner)
        made += extra
    result = body.select(*_columns()).unionByName(inner.select(*_columns()))
    for rows in made:
        result = result.unionByName(rows)
    return result, changes


def _reference_nodes(notes: DataFrame) -> list[DataFrame]:
    """The numbered link where a note stood, set apart by spaces, and its number."""
    common = {
        "doc_id": F.col("doc_id"),
        "part": F.col("part"),
        "root": F.col("root"),
        "pointer": F.col("pointer"),
        "text_seg": F.col("text_seg"),
        "read_block": F.col("read_block"),
    }
    node, depth = F.col("node"), F.col("depth")
    link = _made(
        notes,
        **common,
        node=node,
        end_node=node + 0.3,
        parent=F.col("parent"),
        depth=depth,
        sib=F.col("sib"),
        kind=F.lit("Link"),
        ident=F.concat(F.lit("fnref-"), "_name"),
        classes=F.array(F.lit("footnote-ref")),
        attrs=_attrs(NOTEREF_ATTRS),
        href=F.concat(F.lit("#fn-"), "_name"),
        label=F.col("_name"),
        measured=F.col("measured"),
    )
    parts = ((0.1, "#pad", F.lit(" ")), (0.2, "Str", F.col("_name")), (0.3, "#pad", F.lit(" ")))
    return [link] + [
        _made(
            notes, **common, node=node + step, end_node=node + step, parent=node, depth=depth + 1,
            kind=F.lit(kind), text=text, measured=F.lit(False),
        )
        for step, kind, text in parts
    ]


def _note_nodes(bodies: DataFrame) -> list[DataFrame]:
    """The heading of each note document and the label its body begins with."""
    at, name = F.col("at"), F.col("_name")
    common = {"doc_id": F.col("doc_id"), "part": F.col("number")}
    leading = F.col("number") == 1
    heading = _made(
        bodies, **common, node=at + 0.4, end_node=at + 0.45, kind=F.lit("Header"), level=F.lit(1),
        ident=F.concat(F.lit("fn-"), name), classes=F.when(~leading, F.array(F.lit("unlisted"))),
        label=F.when(leading, F.lit("Footnotes")).otherwise(F.lit("")), read_block=at + 0.4,
        text_seg=at + 0.4,
    )
    title = _made(
        bodies.filter(leading), **common, node=at + 0.45, end_node=at + 0.45, parent=at + 0.4,
        depth=F.lit(1), kind=F.lit("Str"), text=F.lit("Footnotes"), read_block=at + 0.4,
        text_seg=at + 0.4,
    )
    inline = F.coalesce(F.col("first.kind").isin("Para", "Plain"), F.lit(False))
    host = F.when(inline, F.col("first.node")).otherwise(at + 0.5)
    words = ((0.1, "Str", F.lit("Footnote")), (0.2, "Space", F.lit(" ")),
             (0.3, "Str", F.concat(name, F.lit("."))), (0.4, "Space", F.lit(" ")))
    own = _made(
        bodies.filter(~inline), **common, node=at + 0.5, end_node=at + 0.9, kind=F.lit("Para"),
        read_block=at + 0.5, text_seg=at + 0.5,
    )
    label = [
        _made(
            bodies, **common, node=host + step, end_node=host + step, parent=host, depth=F.lit(1),
            kind=F.lit(kind), text=text, read_block=host, text_seg=host,
        )
        for step, kind, text in words
    ]
    return [heading, title, own, *label]


def _backlinks(bodies: DataFrame, inner: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """A link back at the end of each note, in its last paragraph or in one of its own."""
    name, end = F.col("_name"), F.coalesce("last.end_node", F.col("at") + 0.9)
    inline = F.coalesce(F.col("last.kind").isin("Para", "Plain"), F.lit(False))
    host = F.when(inline, F.col("last.node")).otherwise(end + 0.5)
    common = {"doc_id": F.col("doc_id"), "part": F.col("number"), "read_block": host, "text_seg": host}
    own = _made(
        bodies.filter(~inline), **common, node=end + 0.5, end_node=end + 0.8, kind=F.lit("Para")
    )
    space = _made(
        bodies.filter(inline), **common, node=end + 0.6, end_node=end + 0.6, parent=host,
        depth=F.lit(1), kind=F.lit("Space"), text=F.lit(" "),
    )
    link = _made(
        bodies, **common, node=end + 0.7, end_node=end + 0.8, parent=host, depth=F.lit(1),
        kind=F.lit("Link"), classes=F.array(F.lit("footnote-back")), attrs=_attrs(BACKLINK_ATTRS),
        href=F.concat(F.lit("#fnref-"), name), label=name,
    )
    number = _made(
        bodies, **common, node=end + 0.8, end_node=end + 0.8, parent=end + 0.7, depth=F.lit(2),
        kind=F.lit("Str"), text=name, measured=F.lit(False),
    )
    longer = bodies.filter(inline).select(
        "doc_id", F.col("number").alias("part"), F.col("last.node").alias("node"), F.lit(0.9).alias("_more")
    )
    widened = inner.join(longer, [*DOC, "node"], "left").withColumn(
        "end_node", F.col("end_node") + F.coalesce("_more", F.lit(0.0))
    )
    return [own, space, link, number], widened.drop("_more")


# --- raw markup ---------------------------------------------------------------------------------

# Raw formats a writer emits, and elements that never wait for an end tag.
EMITTED = ("html", "xhtml", "html4", "html5")
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)


class _TagStream(HTMLParser):
    """Tags of several pieces of markup read as one stream; remembers which piece each came from."""

    def __init__(self):
        super().__init__()
        self.events, self.piece = [], None

    def handle_starttag(self, tag, attrs):
        self.events.append((True, tag, self.piece))

    def handle_endtag(self, tag):
        self.events.append((False, tag, self.piece))


def _orphans(pieces) -> set:
    """Pieces that hold a tag without a partner, until no more turn up."""
    bad: set = set()
    while True:
        stream = _TagStream()
        for place, text in pieces:
            if place not in bad:
                stream.piece = place
                stream.feed(text)
        stream.close()
        found, waiting = set(), []
        for opens, tag, piece in stream.events:
            if tag in VOID:
                continue
            if opens:
                waiting.append((tag, piece))
                continue
            match = next((i for i in range(len(waiting) - 1, -1, -1) if waiting[i][0] == tag), None)
            if match is None:
                found.add(piece)
            else:
                found.update(piece for _, piece in waiting[match + 1 :])
                del waiting[match:]
        found.update(piece for _, piece in waiting)
        if not found - bad:
            return bad
        bad |= found


_DROPPED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.LongType()),
        T.StructField("node", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
)


def balance_raw_html(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop raw markup whose tags have no partner. Returns nodes and (doc_id, part, node, text).

    Pairing tags is a walk over one document's raw nodes in order, so those alone are grouped;
    a group is the raw markup of one document, which was one input row.
    """
    emitted = F.coalesce(F.col("kind").isin(*tree.RAW) & F.lower(F.coalesce("tag", F.lit(""))).isin(*EMITTED), F.lit(False))
    raw = nodes.filter(emitted).select(*DOC, "node", F.coalesce("text", F.lit("")).alias("text"))

    def dropped(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["node"]))
        bad = _orphans([((r["part"], r["node"]), r["text"]) for r in rows])
        kept = [r for r in rows if (r["part"], r["node"]) in bad]
        return pa.Table.from_pylist(kept, schema=group.schema)

    gone = materialise(raw.groupBy("doc_id").applyInArrow(dropped, _DROPPED))
    return nodes.filter(~emitted).unionByName(_without(nodes.filter(emitted), gone)), gone


# --- identifiers --------------------------------------------------------------------------------


def bound_identifiers(nodes: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """Shorten identifiers that would make a link too long, and the links that lead to them.

    Returns nodes and (doc_id, old, new). The new name follows from the old alone, so only links
    with an over-long fragment are looked up.
    """
    if limit is None:
        none = nodes.select("doc_id", F.col("ident").alias("old"), F.col("ident").alias("new"))
        return nodes, none.limit(0)
    budget = limit - ANCHOR_RESERVE
    body = (F.col("root") != "meta") & F.col("kind").isin(*tree.ATTRIBUTES_AT)
    long_ident = body & (F.octet_length("ident") > budget)
    changes = materialise(
        nodes.filter(long_ident)
        .select("doc_id", F.col("ident").alias("old"))
        .distinct()
        .withColumn("new", bounded_identifier(F.col("old"), limit))
    )
    renamed = nodes.withColumn(
        "ident",
        F.when(F.coalesce(long_ident, F.lit(False)), bounded_identifier(F.col("ident"), limit)).otherwise(
            F.col("ident")
        ),
    )
    led = (F.col("kind") == "Link") & F.col("href").startswith("#") & (F.octet_length("href") > budget + 1)
    led = F.coalesce(led, F.lit(False))
    target = changes.select("doc_id", F.concat(F.lit("#"), "old").alias("href"), F.concat(F.lit("#"), "new").alias("_to"))
    links = (
        renamed.filter(led)
        .join(target, ["doc_id", "href"], "left")
        .withColumn("href", F.coalesce("_to", "href"))
    )
    return renamed.filter(~led).unionByName(links.select(*renamed.columns)), changes


def ensure_title(nodes: DataFrame, docs: DataFrame, prefix: str = "title-") -> tuple[DataFrame, DataFrame]:
    """Put a title heading before documents whose first block is no level-1 heading.

    ``docs`` holds doc_id, title. Returns nodes and (doc_id, ident). The name is a digest of the
    title, which no word of the document can produce.
    """
    blocks = nodes.filter((F.col("root") == "blocks") & (F.col("part") == 0) & (F.col("depth") == 0))
    first = blocks.groupBy("doc_id").agg(
        F.min_by(F.struct("kind", "level"), "node").alias("f"), F.min("node").alias("at")
    )
    wanting = materialise(
        docs.select("doc_id", "title")
        .join(first, "doc_id", "left")
        .filter(~F.coalesce((F.col("f.kind") == "Header") & (F.col("f.level") == 1), F.lit(False)))
        .withColumn("at", F.coalesce(F.col("at"), F.lit(0.0)) - 0.5)
        .withColumn("_id", F.concat(F.lit(prefix), F.left(F.sha2("title", 256), F.lit(8))))
        .withColumn("part", F.lit(0))
    )
    common = {"doc_id": F.col("doc_id"), "part": F.col("part"), "read_block": F.col("at"), "text_seg": F.col("at")}
    heading = _made(
        wanting, **common, node=F.col("at"), end_node=F.col("at") + 0.25, kind=F.lit("Header"),
        level=F.lit(1), ident=F.col("_id"), label=F.col("title"),
    )
    words = _made(
        wanting, **common, node=F.col("at") + 0.25, end_node=F.col("at") + 0.25,
        parent=F.col("at"), depth=F.lit(1), kind=F.lit("Str"), text=F.col("title"),
    )
    changes = wanting.select("doc_id", F.col("_id").alias("ident"))
    return nodes.select(*_columns()).unionByName(heading).unionByName(words), changes


# --- attributes, images and locators ------------------------------------------------------------

# Attributes any element admits, prefixes it admits, and what single kinds add.
GLOBAL_ATTRIBUTES = (
    "about accesskey autocapitalize autofocus border class content contenteditable datatype dir "
    "draggable enterkeyhint epub:type hidden id inert inlist inputmode is itemid itemprop itemref "
    "itemscope itemtype lang nonce popover prefix property rel resource rev role slot spellcheck "
    "style tabindex title translate typeof vocab"
).split()
GLOBAL_PREFIXES = ("aria-", "data-", "on", "xml:", "ns:")
ELEMENT_ATTRIBUTES = {
    "Header": ("h1-h6", ()),
    "Div": ("div", ()),
    "Span": ("span", ()),
    "CodeBlock": ("pre", ()),
    "Code": ("code", ()),
    "Table": ("table", ()),
    "Figure": ("figure", ()),
    "Image": (
        "img",
        tuple("alt crossorigin decoding height ismap loading referrerpolicy sizes src srcset usemap width".split()),
    ),
    "Link": ("a", tuple("download href hreflang ping referrerpolicy target type".split())),
}


def _admitted(kind: Column, name: Column) -> Column:
    ok = name.isin(*GLOBAL_ATTRIBUTES) | name.rlike("^(?:" + "|".join(GLOBAL_PREFIXES) + ")")
    for constructor, (_, names) in ELEMENT_ATTRIBUTES.items():
        if names:
            ok = ok | ((kind == constructor) & name.isin(*names))
    return ok | ~kind.isin(*ELEMENT_ATTRIBUTES)


def namespace_attrs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Put ``data-`` before attributes their element does not admit. Always the last rewrite.

    Returns nodes and (doc_id, node, kind, element, attribute), every rename named. No shuffle.
    """
    kind = F.col("kind")
    elements = F.create_map(*[F.lit(x) for k, (e, _) in ELEMENT_ATTRIBUTES.items() for x in (k, e)])
    renames = nodes.filter(F.col("attrs").isNotNull()).select(
        "doc_id",
        "node",
        "kind",
        elements[kind].alias("element"),
        F.explode(F.filter(F.map_keys("attrs"), lambda k: ~_admitted(kind, k))).alias("attribute"),
    )
    changed = nodes.withColumn(
        "attrs",
        F.transform_keys(
            "attrs",
            lambda k, _: F.when(_admitted(kind, k), k).otherwise(F.concat(F.lit("data-"), k)),
        ),
    )
    return changed, renames


def split_srcset(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take ``srcset`` and ``sizes`` off images; returns nodes and (doc_id, node, candidates)."""
    image = F.col("kind") == "Image"
    candidates = F.filter(
        F.transform(
            F.split(F.try_element_at("attrs", F.lit("srcset")), ","), lambda c: strip_whitespace(c)
        ),
        lambda c: c != "",
    )
    found = nodes.filter(image & F.map_contains_key("attrs", "srcset")).select(
        "doc_id", "node", candidates.alias("candidates")
    )
    plain = F.map_filter("attrs", lambda k, _: ~k.isin("srcset", "sizes"))
    return nodes.withColumn("attrs", F.when(image, plain).otherwise(F.col("attrs"))), found


def localise(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Point images, and the cover the metadata names, at the local files of ``paths``.

    ``paths`` holds locator, path. Only rows that carry a locator take part in the join.
    """
    cover = F.col("pointer").startswith("/meta/cover-image") & F.col("text").isNotNull()
    image = F.coalesce((F.col("kind") == "Image") & (F.col("src") != ""), F.lit(False))
    carries = image | F.coalesce(cover, F.lit(False))
    to = paths.groupBy(F.col("locator").alias("_loc")).agg(F.min("path").alias("_to"))
    carrying = (
        nodes.filter(carries)
        .withColumn("_loc", F.when(image, F.col("src")).otherwise(F.col("text")))
        .join(to, "_loc", "left")
        .withColumn("src", F.when(image, F.coalesce("_to", "src")).otherwise(F.col("src")))
        .withColumn("text", F.when(image, F.col("text")).otherwise(F.coalesce("_to", "text")))
    )
    return nodes.filter(~carries).unionByName(carrying.select(*nodes.columns))


# --- recovering notes from pages ----------------------------------------------------------------

# How extracted pages mark notes.
CONTAINER = "footnotes"
REFERENCE = "fnref:"
DEFINITION = "fn:"
BACKREF = "footnote-backref"


def _within(nodes: DataFrame, holders: DataFrame, name: str) -> DataFrame:
    """Rows inside a holder, with the position of the innermost as ``name``; a holder is not in itself."""
    found = innermost(nodes, holders.select("doc_id", "node", "end_node"), name, own=False)
    return found.filter(F.col(name).isNotNull())


def apparatus(nodes: DataFrame) -> DataFrame:
    """One row per document of pages: outcome, reason and counts of note recovery.

    Columns: doc_id, outcome, reason, references, definitions, unpaired, recovered, empty, and the
    container's position. A recovery that would leave an empty note is undone as a whole.
    """
    candidates = nodes.filter(F.col("root") == "html")
    marked = candidates.filter(
        (F.col("ident") == CONTAINER) | ((F.col("tag") == "sup") & F.col("ident").startswith(REFERENCE))
    )
    holding = candidates.join(marked.select("doc_id").distinct(), "doc_id", "left_semi")
    references = _references(holding)
    containers = (
        holding.filter(F.col("ident") == CONTAINER)
        .groupBy("doc_id")
        .agg(F.min_by(F.struct("node", "end_node", "closed"), "node").alias("c"))
        .select("doc_id", "c.*")
    )
    definitions = _definitions(holding, containers)
    empty = _empty_definitions(holding, definitions)
    refs = references.groupBy("doc_id", "ident").agg(F.count("*").alias("r"))
    defs = definitions.groupBy("doc_id", "ident").agg(F.count("*").alias("d"))
    zero = F.lit(0).cast("bigint")
    pairs = refs.join(defs, ["doc_id", "ident"], "full_outer").select(
        "doc_id", F.coalesce("r", zero).alias("r"), F.coalesce("d", zero).alias("d")
    )
    counted = pairs.groupBy("doc_id").agg(
        F.sum("r").alias("references"),
        F.sum("d").alias("definitions"),
        F.count_if((F.col("r") == 0) | (F.col("d") == 0)).alias("unpaired"),
        F.bool_or(F.col("d") > 1).alias("twice"),
        F.bool_or(F.col("r") != F.col("d")).alias("uneven"),
    )
    blanks = empty.groupBy("doc_id").agg(F.count("*").alias("blank"))
    n = lambda c: F.coalesce(c, zero)
    yes = lambda c: F.coalesce(c, F.lit(False))
    reason = (
        F.when((n("references") == 0) & F.col("node").isNull(), F.lit("no-apparatus"))
        .when(F.col("node").isNull(), F.lit("no-definitions"))
        .when(n("references") == 0, F.lit("no-references"))
        .when(~F.col("closed"), F.lit("unclosed-container"))
        .when(yes("twice"), F.lit("duplicate-target"))
        .when(yes("uneven"), F.lit("reference-definition-mismatch"))
        .when(n("blank") > 0, F.lit("empty-note"))
    )
    docs = nodes.select("doc_id").distinct()
    return (
        docs.join(containers, "doc_id", "left")
        .join(counted, "doc_id", "left")
        .join(blanks, "doc_id", "left")
        .withColumn("reason", reason)
        .select(
            "doc_id",
            F.when(F.col("reason").isNull(), F.lit("recovered"))
            .when(F.col("reason") == "no-apparatus", F.lit("not-recognised"))
            .otherwise(F.lit("skipped"))
            .alias("outcome"),
            "reason",
            n("references").alias("references"),
            n("definitions").alias("definitions"),
            n("unpaired").alias("unpaired"),
            F.when(F.col("reason").isNull(), n("references")).otherwise(zero).alias("recovered"),
            F.when(F.col("reason") == "empty-note", F.col("blank")).otherwise(zero).alias("empty"),
            F.col("node").alias("container"),
        )
    )


def _references(nodes: DataFrame) -> DataFrame:
    """(doc_id, node, ident): links in a reference mark that lead to a definition."""
    marks = nodes.filter((F.col("tag") == "sup") & F.col("ident").startswith(REFERENCE))
    anchors = _within(nodes.filter(F.col("tag").isin("a", "sup")), marks, "_mark").filter(
        F.col("href").startswith("#" + DEFINITION)
    )
    return anchors.select(
        "doc_id", "node", F.substring("href", len(DEFINITION) + 2, 1 << 30).alias("ident")
    )


def _definitions(nodes: DataFrame, containers: DataFrame) -> DataFrame:
    """(doc_id, node, end_node, ident): outermost items of the container.

    An item without a name right behind one whose end was never written still belongs to it.
    """
    items = nodes.filter((F.col("tag") == "li") | (F.col("ident") == CONTAINER))
    inside = _within(items, containers, "_c").filter(F.col("tag") == "li")
    order = Window.partitionBy("doc_id").orderBy("node")
    reach = F.max("end_node").over(order.rowsBetween(Window.unboundedPreceding, -1))
    before = F.lag("closed").over(order)
    outer = inside.withColumn("_reach", reach).withColumn("_before", before)
    stray = F.col("ident").isNull() & ~F.coalesce("_before", F.lit(True))
    ident = F.coalesce("ident", F.lit(""))
    named = F.when(ident.startswith(DEFINITION), F.substring(ident, len(DEFINITION) + 1, 1 << 30)).otherwise(ident)
    return outer.filter(
        (F.col("_reach").isNull() | (F.col("node") > F.col("_reach"))) & ~stray
    ).select("doc_id", "node", "end_node", named.alias("ident"))


def _empty_definitions(nodes: DataFrame, definitions: DataFrame) -> DataFrame:
    """(doc_id, node) of definitions without a word besides their link back."""
    backs = nodes.filter(
        (F.col("tag") == "a") & F.coalesce(F.array_contains("classes", BACKREF), F.lit(False))
    )
    mine = nodes.filter(F.col("text").isNotNull() | (F.col("tag") == "li"))
    texts = _within(mine, definitions, "_def").filter(F.col("text").isNotNull())
    returning = _within(
        nodes.filter(F.col("text").isNotNull() | (F.col("tag") == "a")), backs, "_back"
    ).select("doc_id", "node")
    said = (
        texts.filter(F.length(strip_whitespace(F.col("text"))) > 0)
        .join(returning, ["doc_id", "node"], "left_anti")
        .select("doc_id", F.col("_def").alias("node"))
        .distinct()
    )
    return definitions.select("doc_id", "node").join(said, ["doc_id", "node"], "left_anti")


def recover_apparatus(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mark note references and the note container of documents that pair exactly.

    Returns nodes and the outcome per document. Other documents keep their rows as they were.
    """
    outcome = apparatus(nodes)
    good = outcome.filter(F.col("outcome") == "recovered")
    marks = (
        _references(nodes)
        .join(good.select("doc_id"), "doc_id")
        .select("doc_id", "node", F.lit("doc-noteref").alias("_role"))
        .unionByName(
            good.select("doc_id", F.col("container").alias("node"), F.lit("doc-endnotes").alias("_role"))
        )
    )
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce("attrs", empty), lambda k, _: k != "role")
    marked = nodes.join(marks, ["doc_id", "node"], "left").withColumn(
        "attrs",
        F.when(
            F.col("_role").isNotNull(), F.map_concat(kept, F.create_map(F.lit("role"), F.col("_role")))
        ).otherwise(F.col("attrs")),
    )
    return marked.drop("_role"), outcome


# --- the chain and its log ----------------------------------------------------------------------

# Rewrite -> the activation behind it, in the order they run.
REWRITES = {
    "duplicate-caption-suppression": None,
    "callout-title-emphasis": None,
    "link-stripping": "strip_non_apparatus_hrefs",
    "note-conversion": "one_file_per_note",
    "raw-html-balance": None,
    "identifier-bounding": None,
    "attribute-namespacing": None,
}


#: What rewrites behind the notes look at.
_LATER = ("doc_id", "part", "node", "depth", "root", "kind", "tag", "level", "ident", "attrs", "href", "text")


def _chained(
    nodes: DataFrame, docs: DataFrame, href_limit: int | None, prefix: str, columns=None, written: bool = False
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The nodes of the whole chain in working form, and {rewrite: changes}.

    The nodes are written once behind the notes, and before the chain unless they are ``written`` already. With
    ``columns``, only those and what is looked at after the notes; the others are empty.
    """
    w = working(nodes) if written else materialise(working(nodes))
    w, captions = suppress_captions(w)
    w, callouts = emphasise_callouts(w)
    w, links = strip_links(w)
    w, notes = convert_notes(w)
    w = w.select(*_columns())
    if columns is None:
        w = materialise(w)
    else:
        held = [c for c in _columns() if c in columns or c in _LATER]
        kinds = {f.name: f.dataType for f in w.schema}
        few = materialise(w.select(*held))
        w = few.select(*[c if c in held else F.lit(None).cast(kinds[c]).alias(c) for c in _columns()])
    w, raw = balance_raw_html(w)
    w, titled = ensure_title(w, docs, prefix)
    w, bounded = bound_identifiers(w, href_limit)
    w, renamed = namespace_attrs(w)
    return w, {
        "duplicate-caption-suppression": captions,
        "callout-title-emphasis": callouts,
        "link-stripping": links.filter("removed"),
        "note-conversion": notes,
        "raw-html-balance": raw,
        "identifier-bounding": bounded.select("doc_id").unionByName(titled.select("doc_id")),
        "attribute-namespacing": renamed,
    }


def rewrite(
    nodes: DataFrame, docs: DataFrame, href_limit: int | None = 96, prefix: str = "title-", columns=None, written: bool = False
):
    """The whole chain. ``docs`` holds doc_id, title. Returns nodes and {rewrite: changes}.

    Positions of the nodes are labels (``labelled``). Where ``columns`` are named, only those are carried through.
    Say ``written`` where the nodes are a table already and need not be written once more.
    """
    w, done = _chained(nodes, docs, href_limit, prefix, columns, written)
    w = labelled(w)
    return (w if columns is None else w.select(*columns)), done


def changes(nodes: DataFrame, docs: DataFrame, href_limit: int | None = 96, prefix: str = "title-") -> dict[str, DataFrame]:
    """What ``rewrite`` would change, {rewrite: changes}, from the few kinds of nodes that rewrites look at.

    Words and spaces outside of figures, callouts and raw markup play no part in any change, so they are
    left out before the chain begins, and positions are not counted again.
    """
    acting = F.col("kind").isin("Link", "Note", "Image", "Figure", *tree.RAW) | F.col("kind").isin(*tree.BLOCKS)
    figures = F.col("kind").isin("Figure", "Div")
    # Words count where a caption or a callout may be compared or told.
    telling = nodes.filter(figures).select("doc_id").distinct()
    few = nodes.filter(acting | F.col("attrs").isNotNull() | F.col("ident").isNotNull())
    words = nodes.filter(~(acting | F.col("attrs").isNotNull() | F.col("ident").isNotNull())).join(telling, "doc_id", "left_semi")
    return _chained(few.unionByName(words), docs, href_limit, prefix, ())[1]


def transform_log(docs: DataFrame, changes: dict[str, DataFrame], activations=ACTIVATIONS) -> DataFrame:
    """One row per rewrite and document: name, fired, activation, justification, changes.

    A rewrite that did nothing is a row with zero, not an absence.
    """
    counted = None
    for name, rows in changes.items():
        one = rows.groupBy("doc_id").agg(F.count("*").alias("changes")).withColumn("name", F.lit(name))
        counted = one if counted is None else counted.unionByName(one)
    text = lambda v: F.lit(v).cast("string")
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("name"),
                text(act).alias("activation"),
                text(activations[act][1] if act else None).alias("justified_by"),
                F.lit(bool(activations[act][2]) if act else False).alias("device_judged"),
            )
            for i, (name, act) in enumerate(REWRITES.items())
        ]
    )
    n = F.coalesce("changes", F.lit(0).cast("bigint"))
    return (
        docs.select("doc_id", F.inline(rows))
        .join(counted, ["doc_id", "name"], "left")
        .withColumn("changes", n)
        .withColumn("fired", F.col("changes") > 0)
    )


def lineage_check(repairs: DataFrame, profile: str) -> DataFrame:
    """Add ``reason`` (the first of nine checks a repair fails, or NULL) and ``changed``.

    ``repairs`` holds command, canonical_sha256, profile_id, profile_resolved, kind, stated_kind,
    located, requested, observed_sha256, source_sha256, baseline_sha256, stated_baseline_sha256,
    api_version, stated_api_version, repaired_sha256. The order of the checks is meaning.
    """
    local = F.col("kind") == "markdown"
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    checks = (
        ("not-an-inspection", F.coalesce(F.col("command").isin("inspect", "prepare", "localise"), F.lit(False))),
        ("no-canonical-document", F.col("canonical_sha256").isNotNull()),
        (
            "profile-mismatch",
            F.coalesce(F.col("profile_resolved") & (F.col("profile_id") == profile), F.lit(False)),
        ),
        ("source-kind-mismatch", same("stated_kind", "kind")),
        ("source-mismatch", same("located", "requested")),
        ("source-unreadable", ~local | F.col("observed_sha256").isNotNull()),
        ("source-changed", ~local | same("observed_sha256", "source_sha256")),
        ("baseline-mismatch", same("baseline_sha256", "stated_baseline_sha256")),
        ("pandoc-api-version-mismatch", same("api_version", "stated_api_version")),
    )
    reason = F.lit(None).cast("string")
    for name, holds in reversed(checks):
        reason = F.when(~holds, F.lit(name)).otherwise(reason)
    return repairs.withColumn("reason", reason).withColumn(
        "changed", ~same("repaired_sha256", "canonical_sha256")
    )
