"""Packages, links between documents, limits and pictures."""

import warnings

import pytest
from epubs import SPRING, TOC, archive, members
from pictures import PICTURES
from pyspark.sql import functions as F

from corpusaudit.operators import links as L
from corpusaudit.operators import package as K
from corpusaudit.operators import verdicts as V
from corpusaudit.rules import REQUIREMENTS
from corpusaudit.sources import images as I
from corpusaudit.sources import packages as S

warnings.simplefilter("ignore")


def opened(spark, *books):
    rows = [(i, archive(b) if isinstance(b, list) else b) for i, b in enumerate(books)]
    files = spark.createDataFrame(rows, "package_id bigint, content binary")
    stored = S.packages_to_members(files)
    current = S.current_members(stored)
    paths, records = S.members_to_package(current)
    nodes = S.documents_to_nodes(S.content_documents(current, records))
    return stored, current, paths, records, nodes


def problems(spark, *books):
    stored, current, paths, records, nodes = opened(spark, *books)
    broken = K.broken_references(current, records, K.document_references(nodes))
    rows = K.problem_order(K.package_problems(stored, paths, records, nodes, broken)).collect()
    out = {i: [] for i in range(len(books))}
    for r in rows:
        out[r.package_id].append((r.kind, r.location))
    return out


def without(name):
    return [m for m in members() if m[0] != name]


def swapped(name, data):
    return [(n, data if n == name else d) for n, d in members()]


def test_problems_of_packages(spark):
    got = problems(
        spark,
        [*members(), ],
        without("META-INF/container.xml"),
        swapped("META-INF/container.xml", b"<no"),
        without("OPS/book.opf"),
        swapped("OPS/book.opf", b"<no"),
        without(TOC),
        swapped(SPRING, b"<html>"),
        [*members(), ("mimetype", b"x"), ("../up", b"x")],
        b"not a zip",
    )
    dead = ("broken-reference", TOC)
    assert got[0] == []
    assert got[1] == [("missing-container", "META-INF/container.xml")]
    assert got[2] == [("malformed-xml", "META-INF/container.xml")]
    assert got[3] == [("missing-package-document", "OPS/book.opf")]
    assert got[4] == [("malformed-xml", "OPS/book.opf")]
    assert got[5] == [("broken-reference", "OPS/book.opf"), ("missing-navigation", TOC)]
    assert got[6] == [("malformed-xml", SPRING)]
    assert got[7] == [("duplicate-archive-member", "mimetype"), ("unsafe-archive-path", "../up")]
    assert ("missing-container", "META-INF/container.xml") in got[8]
    assert ("unreadable-artifact", "") in got[8] and dead not in got[0]


def measured(spark, *bodies):
    _, current, _, _, nodes = opened(spark, *[members(b) for b in bodies])
    nodes = nodes.filter(F.col("document") == SPRING)
    links = L.links_of(nodes, L.R.EXCLUDED_SCHEMES, True, "package_id", "document")
    anchors = nodes.filter("ident IS NOT NULL").select("package_id", "document", "ident")
    found = L.resolve_in_package(links, current, anchors)
    return nodes, found, {r.package_id: r for r in L.link_facts(found, ("package_id",)).collect()}


def a(href, text="x", extra=""):
    return f'<a href="{href}"{extra}>{text}</a>'


def test_links_of_content_documents(spark):
    noteref = ' role="doc-noteref"'
    bodies = [
        "<p>" + a("#top") + a("#top", "") + a("https://x.org/") + a("mailto:me@x.org") + "</p><p id='top'/>",
        "<p id='t'>" + a("https://x.org/") + a("../toc.xhtml") + a("#gone") + a("no.xhtml")
        + a("#t", "1", ' epub:type="noteref"') + a("#t", "b", ' role="doc-backlink"') + "</p>",
        "<p id='n'>" + a("#n", "1", noteref) + a("#m", "2", noteref) + "</p>",
        "<ul><li>" + a("#x") * 3 + "<p>" + a("#x") * 9 + "</p></li></ul>",
        "<div><span>" + a("#x") * 4 + "</span><p>" + a("#x") * 4 + "</p><span>" + a("#x") * 4 + "</span></div>",
        "<p>" + a("caf&#233;-x.xhtml") + "</p>",
        "<p>" + a("https://x") + a("tel:1") + a("javascript:x") + a("data:,x") + a("//host/x") + "</p>",
    ]
    nodes, found, facts = measured(spark, *bodies)
    assert (facts[0].links, facts[0].recorded, facts[0].max_per_block) == (4, 1, 1)
    f = facts[1]
    assert (f.web_link, f.cross_reference, f.dead_link, f.footnote_reference, f.footnote_back_link) == (1, 1, 2, 1, 1)
    assert f.max_non_footnote_per_block == 3
    assert (facts[2].note_references, facts[2].note_unresolved) == (2, 1)
    assert facts[3].max_per_block == 9 and facts[3].recorded == 12
    assert facts[4].max_per_block == 4 and facts[4].recorded == 12
    assert facts[5].max_href_bytes == len("café-x.xhtml".encode())
    assert (facts[6].web_link, facts[6].recorded) == (3, 2)
    targets = {r.package_id: r.target_documents for r in L.note_targets(found).collect()}
    assert targets == {1: 1, 2: 1}
    ids = measured(spark, "<h1 id='a'/><p id='b'><span id='c'>x</span></p><p id='d'/>")[0]
    assert L.anchor_counts(ids, ("package_id",)).collect()[0].anchors == 4


def verdicts(spark, *rows):
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "doc_id bigint, requirement_id string, value bigint, applicable boolean, reliable boolean, relation string",
    )
    out = V.evaluate(V.gather_instruments(df)).collect()
    return [next(v for v in out if v.doc_id == i and v.requirement_id == r[0]) for i, r in enumerate(rows)], out


def test_limits_at_and_past_the_edge(spark):
    blocks, href, anchors = "recorded-links-per-block", "footnote-href-length", "anchors-per-chapter"
    got, every = verdicts(
        spark,
        (blocks, 128, True, True, None), (blocks, 129, True, True, None),
        (href, 96, True, True, None), (href, 97, True, True, None),
        (anchors, 1024, True, True, None), (anchors, 1025, True, True, None),
        (href, 0, False, True, None), (href, 200, True, False, None),
        (blocks, 129, True, True, "lower-bound"), (blocks, 128, True, True, "lower-bound"),
        (blocks, 500, True, True, "indeterminate"),
    )
    assert [v.verdict for v in got] == [
        "true", "false", "true", "false", "true", "false", "not_applicable", "unknown", "false",
        "unknown", "unknown",
    ]
    assert got[6].measurement is None and got[6].applicability is False
    assert got[7].applicability is True and got[8].measurement.basis == "projected"
    screens = [v for v in every if v.requirement_id == "footnotes-per-screen"]
    assert {(v.verdict, v.applicability, v.observed_limit.value) for v in screens} == {("unevaluable", None, 16)}
    assert len(every) == 11 * len(REQUIREMENTS)
    assert {v.verdict for v in every if v.requirement_id == "png-decoding"} == {"unknown"}


@pytest.mark.parametrize(
    "mix,want",
    [([], "not_applicable"), (["true"], "true"), (["true", "unknown"], "unknown"),
     (["unknown", "false"], "false"), (["true", "unevaluable"], "unevaluable"), (["not_applicable", "true"], "not_applicable")],
)
def test_combined_verdicts(spark, mix, want):
    df = spark.createDataFrame([(v,) for v in mix], "v string")
    assert df.agg(V.combine(F.col("v")).alias("c")).collect()[0].c == want


def test_refusal_order_and_inheritance(spark):
    df = spark.createDataFrame([(True, True, True), (False, True, True), (False, False, True), (False, False, False)], "m boolean, c boolean, t boolean")
    no = F.lit(False)
    got = [r[0] for r in df.select(V.first_refusal(F.col("m"), F.col("c"), F.col("t"), no, no)).collect()]
    assert got == ["malformed-content-document", "compatibility", "text-preservation", None]
    fact = spark.range(1).select(V.inherit(V.quantity(F.lit(3), F.lit("links"), F.lit("lower-bound"))).alias("q"))
    assert tuple(fact.collect()[0].q) == ("reported", None, "links", 3)


def test_pictures_from_their_bytes(spark):
    want = {
        "wide_png": ("image/png", True, "true"), "deep_png": ("image/png", True, "false"), "palette_png": ("image/png", True, "true"),
        "colour_jpeg": ("image/jpeg", True, "true"), "grey_progressive_jpeg": ("image/jpeg", True, "unknown"),
        "print_jpeg": ("image/jpeg", True, "unknown"), "odd_jpeg": ("image/jpeg", True, "unknown"),
        "webp": ("image/webp", True, "false"), "cut_webp": ("image/webp", False, "unknown"), "svg": ("image/svg+xml", True, "false"),
        "gif": ("image/gif", True, "unknown"), "cut_png": ("image/png", False, "unknown"), "words": (None, False, "unknown"),
    }
    cells = [(name, bytearray({**PICTURES, "words": b"no picture"}[name])) for name in want]
    df = spark.createDataFrame(cells, "name string, content binary")
    rows = {r.name: r for r in K.device_support(I.measure_images(df)).collect()}
    assert {n: (r.media_type, r.intact, r.device_support) for n, r in rows.items()} == want
    wide, colour = rows["wide_png"], rows["colour_jpeg"]
    assert (wide.width, wide.height, wide.colour_type, wide.alpha) == (640, 2, 2, False)
    assert (colour.width, colour.height, colour.scan_mode, colour.colour_model) == (3, 2, "baseline", "rgb")
    assert (rows["print_jpeg"].colour_model, rows["odd_jpeg"].colour_model) == ("cmyk", None)
    assert rows["grey_progressive_jpeg"].scan_mode == "progressive"
    fit = spark.createDataFrame([(960, 800), (100, 100), (None, 5)], "w int, h int")
    got = fit.select(I.fit_target(F.col("w"), F.col("h"), 480, 800).alias("t"), I.fits(F.col("w"), F.col("h"), 480, 800).alias("f")).collect()
    assert tuple(got[0].t) == (480, 400, 50) and tuple(got[1].t) == (100, 100, 100)
    assert [r.f for r in got] == [False, True, False]


def test_pictures_are_matched_by_bytes(spark):
    want = spark.createDataFrame([(1, "a", "s1", False), (1, "b", "s2", False), (1, "c", "s3", True), (1, "d", "s9", False)], "package_id bigint, reference string, sha256 string, is_cover boolean")
    have = spark.createDataFrame([(1, "s1", False, True), (1, "s2", True, False), (1, "s3", False, True)], "package_id bigint, sha256 string, cover boolean, referenced boolean")
    got = {r.reference: r.reason for r in K.image_mismatch(want, have).collect()}
    assert got == {"a": None, "b": "unreferenced-resource", "c": "cover-not-declared", "d": "absent-resource"}
    seen = spark.createDataFrame([(1, "s", 9, "z"), (1, "s", 2, "a"), (1, "t", 5, "b")], "doc_id bigint, sha256 string, node int, name string")
    assert sorted(r.name for r in K.first_resources(seen).collect()) == ["a", "b"]


def test_upper_median(spark):
    rows = [(1, p, False) for p in (10, 20, 30, 100)] + [(1, 5, True), (2, 100, False)]
    df = spark.createDataFrame(rows, "doc_id bigint, scale_percent int, cover boolean")
    got = {r.doc_id: r for r in K.image_reduction(df).collect()}
    assert (got[1].images, got[1].reduced, got[1].minimum, got[1].median, got[1].maximum) == (4, 3, 10, 30, 100)
    assert (got[2].reduced, got[2].median) == (0, 100)


def test_remote_references(spark):
    images = spark.createDataFrame(
        [(1, "https://x/b", 5), (1, "https://x/a", 9), (1, "https://x/b", 12), (1, "local.png", 2), (2, "ftp://y", 3), (2, "gopher://z", 1)],
        "doc_id bigint, src string, node int",
    )
    covers = spark.createDataFrame([(1, "https://x/c"), (2, "https://x/d")], "doc_id bigint, cover string")
    got = sorted((r.doc_id, r.identifier, r.locator, r.occurrences) for r in L.remote_references(images, covers).collect())
    assert got == [
        (1, "cover-image", "https://x/c", 1), (1, "image-1", "https://x/b", 2), (1, "image-2", "https://x/a", 1),
        (2, "cover-image", "https://x/d", 1),
    ]
    assert [tuple(r) for r in L.first_unsupported(images).collect()] == [(2, "gopher://z")]


def test_chapters_are_read_as_they_stand(spark):
    body = "<p id='x'>a <ul><li>" + a("#x") + "</li></ul> b " + a("#x") + "<![CDATA[ <i> ]]></p>"
    empty = [(n, b"" if n == SPRING else d) for n, d in members()]
    _, _, _, _, nodes = opened(spark, members(body), empty)
    links = nodes.filter((F.col("package_id") == 0) & (F.col("document") == SPRING) & (F.col("kind") == "Link")).orderBy("node").collect()
    tags = {r.node: r.tag for r in nodes.filter((F.col("package_id") == 0) & (F.col("document") == SPRING)).collect()}
    assert [tags[r.read_block] for r in links] == ["li", "p"]
    lost = nodes.filter((F.col("package_id") == 1) & (F.col("document") == SPRING)).collect()
    assert [(r.kind, r.well_formed) for r in lost] == [("#malformed", False)]


def test_only_the_last_member_of_a_name_is_current(spark):
    twice = [*members(), (SPRING, b"<html/>")]
    stored, current, *_ = opened(spark, twice)
    assert stored.count() == 8 and current.count() == 7
    assert bytes(current.filter(F.col("name") == SPRING).first().content) == b"<html/>"


def test_nodes_of_archives_need_no_contents(spark):
    """Links, identifiers and text read from archives are those of the documents, and nothing else is in the plan."""
    twice = [*members('<p id="x">a <a href="#x">low <b>tide</b></a> b<!--c--> c</p><ul><li>d</li><li>e</li></ul>'), (TOC, b"<no")]
    rows = [(0, archive(members())), (1, archive(twice)), (2, b"not a zip"), (3, archive(swapped(SPRING, b"<html>")))]
    files = spark.createDataFrame(rows, "package_id bigint, content binary")
    stored, current, _, records, nodes = opened(spark, members(), twice, b"not a zip", swapped(SPRING, b"<html>"))
    columns = ("package_id", "document", "well_formed", "node", "end_node", "sib", "kind", "ident", "href", "read_block", "label")
    found = S.archived_nodes(files, records, ("Link",), columns, named=True)
    wanted = nodes.filter("kind IN ('Link', '#malformed') OR ident IS NOT NULL").select(*columns)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))
    read = S.archived_nodes(files, records, ("Link",), ("package_id", "document", "kind", "node", "text"), text=True)
    segments = S.documents_to_segments(S.content_documents(current, records)).select("package_id", "document", "seq", "text")
    assert sorted(S.archived_segments(read).collect()) == sorted(segments.collect())
    assert sorted(S.member_names(files).collect()) == sorted(current.select("package_id", "name").collect())
    digests = S.packages_to_members(files, columns=("package_id", "name", "sha256"))
    assert sorted(map(repr, digests.collect())) == sorted(map(repr, stored.select("package_id", "name", "sha256").collect()))


def test_link_rules_of_books_shuffle_no_contents(spark, monkeypatch):
    from corpusaudit.plans import package_queries as Q

    written = []
    keep = Q.materialise
    monkeypatch.setattr(Q, "materialise", lambda df, *by: written.append(df.columns) or keep(df, *by))
    Q.package_links(spark, "/root/testdata/sf0.001")
    assert [c for c in written if "content" in c] == [["package_id", "content"]]
