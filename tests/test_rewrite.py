"""Structure and rewriting of small trees, before and after."""

from pyspark.sql import functions as F
from trees import attr, div, figure, header, image, link, nodes, note, para, raw, text

from corpusaudit.operators import observations as O
from corpusaudit.operators import rewrite as W
from corpusaudit.operators import structure as S
from corpusaudit.sources.html import pages_to_nodes, pages_to_segments


def lines(df, order="text_seg"):
    return {r.doc_id: r.text.split("\n") for r in S.render_text(S.segments(df), order).collect()}


def test_baseline_of_a_restructured_book(spark):
    doc = [header(1, "Opening"), para("Before note.", note(para("Note wording moves."))),
           figure([para("River map")], para(image("River map", "f.png"))), para("Final block.")]
    got = S.render_text(S.visible_segments(nodes(spark, doc))).collect()[0].text.split("\n")
    assert got == ["Opening", "Before note. Note wording moves.", "River map", "Final block."]


def test_captions_of_their_own_stay(spark):
    doc = [figure([para("Says more")], para(image("River map", "f.png"))), para("After")]
    got = S.render_text(S.visible_segments(nodes(spark, doc))).collect()[0].text.split("\n")
    assert got == ["River map", "Says more", "After"]


def test_measures(spark):
    lists = {"t": "OrderedList", "c": [[7, {"t": "Decimal"}, {"t": "Period"}], [[para("seven")]]]}
    roman = {"t": "OrderedList", "c": [[1, {"t": "LowerRoman"}, {"t": "Period"}], [[para("i")]]]}
    plain = {"t": "OrderedList", "c": [[1, {"t": "Decimal"}, {"t": "Period"}], [[para("one")]]]}
    terms = {"t": "DefinitionList", "c": [[text("term"), [[para("meaning", note(para("deep")))]]]]}
    broken = div(attr("", ["Pagebreak"]), para("p"))
    marked = para({"t": "Span", "c": [attr("s1", [], [["role", "doc-pagebreak"]]), text("q")]})
    doc = [header(2, "T", "t"), lists, roman, plain, terms, broken, marked, para(image("", "a.png"), image("x", "b.png"))]
    row = S.measure(nodes(spark, doc)).collect()[0]
    assert (row.ordered_lists, row.renumbered_lists, row.page_breaks) == (3, 2, 2)
    assert (row.images, row.images_without_alt, row.notes, row.headings) == (2, 1, 1, 1)
    assert row.identifiers == 2
    assert row.blocks == 10  # heading, three items, term, meaning, note, two paragraphs, pictures


def test_unsupported_and_unknown_constructs(spark):
    doc = [para({"t": "Strikeout", "c": text("gone")}, {"t": "Sparkle", "c": text("new")})]
    meta = {"title": {"t": "MetaInlines", "c": [{"t": "Strikeout", "c": text("old")}]}, "author": {"t": "MetaList", "c": [{"t": "MetaString", "c": " A "}, {"t": "MetaInlines", "c": text("B C")}]}}
    tree = nodes(spark, doc, meta=meta)
    got = {r.kind: (r.n, r.recognised) for r in S.unsupported_constructs(S.construct_counts(tree)).collect()}
    assert got == {"Strikeout": (2, True), "Sparkle": (1, False)}
    places = S.construct_locations(tree, ["Strikeout"]).collect()[0].locations
    assert places == ["/meta/title/c/0", "/blocks/0/c/0"]
    said = {r.name: r.value for r in S.meta_text(tree).collect()}
    assert said == {"title": "old", "author": "A, B C"}


def test_derived_captions_go(spark):
    fig = lambda cap: figure([para(cap)], para(image("River ( map )", "f.png")))
    again = [fig("River (map)"), para("River (map)"), para("End")]
    other = [fig("River (map)"), para("River (map) and more")]
    kept, gone = W.suppress_captions(W.working(nodes(spark, again, other)))
    assert [r.doc_id for r in gone.collect()] == [1]
    captions = W.dense(kept).filter(F.col("pointer").contains("/c/1/1/0/c/"))
    assert {r.doc_id for r in captions.collect()} == {2}


def test_callout_titles(spark):
    plain = {"t": "Plain", "c": text("Note this")}
    good = [div(attr("", ["callout-title"]), div(attr("", ["callout-title-inner"]), plain)), para("x")]
    two = [div(attr("", ["callout-title"]), div(attr("", ["callout-title-inner"]), plain, plain))]
    out, found = W.emphasise_callouts(W.working(nodes(spark, good, two)))
    assert [(r.doc_id, r.text) for r in found.collect()] == [(1, "Note this")]
    kinds = [r.kind for r in W.dense(out).filter("doc_id = 1").orderBy("node").collect()]
    assert kinds == ["Para", "Strong", "Str", "Space", "Str", "Para", "Str"]
    assert lines(W.dense(out))[1] == ["Note this", "x"]


MIXED = [header(1, "Top", "top"), para(link("site", "https://x.org/"), link("in", "#top"), link("gone", "#no"), link("kept", "https://y.org/", attr("", ["c"])))]


def test_links_are_stripped_by_kind(spark):
    noted = [*MIXED, para("n", note(para("note")))]
    out, links = W.strip_links(W.working(nodes(spark, MIXED, noted)))
    left = W.dense(out).filter("kind = 'Link'").collect()
    assert [(r.doc_id, r.href) for r in left] == [(1, "#top")]
    spans = W.dense(out).filter("kind = 'Span'").collect()
    assert {r.doc_id for r in spans} == {1, 2} and all(r.href is None for r in spans)
    locks = {r.doc_id: r.engaged for r in W.interlock(out.select("doc_id").distinct(), links).collect()}
    assert locks == {1: True, 2: False}
    words = lines(W.dense(out))
    assert words[1] == words[2][:2] == ["Top", "siteingonekept"]


def test_notes_become_documents(spark):
    inner = note(para("outer", note({"t": "CodeBlock", "c": [attr(), "deep"]})))
    doc = [header(1, "Top"), para("a", inner, "b"), para(image("alt", "x.png"), note(para("last")))]
    out, changes = W.convert_notes(W.working(nodes(spark, doc)), backlinks=True)
    assert sorted(r.number for r in changes.collect()) == [1, 2, 3]
    dense = W.dense(out)
    assert lines(dense)[1] == [
        "Top", "a 1 b", "alt 3", "Footnotes", "Footnote 1. outer 2  1", "Footnote 2.", "deep", "2",
        "Footnote 3. last 3",
    ]
    links = dense.filter("kind = 'Link'").orderBy("node").collect()
    assert [r.href for r in links] == ["#fn-1", "#fn-3", "#fn-2", "#fnref-1", "#fnref-2", "#fnref-3"]
    heads = dense.filter("kind = 'Header' AND ident LIKE 'fn-%'").orderBy("node").collect()
    assert [(r.ident, r.classes) for r in heads] == [("fn-1", None), ("fn-2", ["unlisted"]), ("fn-3", ["unlisted"])]
    spans = {(r.node, r.end_node) for r in dense.collect()}
    assert len(spans) == dense.count() and all(a <= b for a, b in spans)


def test_raw_markup_is_balanced(spark):
    fine = [para(raw("<i>"), "x", raw("</i>"), raw("<br>"))]
    stray = [{"t": "RawBlock", "c": ["html", "<div>"]}, para("y"), {"t": "RawBlock", "c": ["html", "</section>"]}]
    # Dropping the first piece orphans the second one's partner.
    chain = [para(raw("<b></u>"), "z", raw("</b>"))]
    out, gone = W.balance_raw_html(W.working(nodes(spark, fine, stray, chain)))
    assert sorted((r.doc_id, r.text) for r in gone.collect()) == [
        (2, "</section>"), (2, "<div>"), (3, "</b>"), (3, "<b></u>"),
    ]
    assert W.dense(out).filter("kind LIKE 'Raw%'").count() == 3


def test_identifiers_and_titles(spark):
    long = "i" * 90
    doc = [para({"t": "Span", "c": [attr(long), text("x")]}, link("go", "#" + long), link("far", "#" + "j" * 90))]
    out, changes = W.bound_identifiers(W.working(nodes(spark, doc)), 96)
    new = changes.collect()[0].new
    assert len(new) == 77
    hrefs = [r.href for r in W.dense(out).filter("kind = 'Link'").orderBy("node").collect()]
    assert hrefs == ["#" + new, "#" + "j" * 90]
    titles = spark.createDataFrame([(1, "T"), (2, "U")], "doc_id bigint, title string")
    headed, added = W.ensure_title(W.working(nodes(spark, doc, [header(1, "Own"), para("p")])), titles)
    assert [r.doc_id for r in added.collect()] == [1]
    assert lines(W.dense(headed)) == {1: ["T", "xgofar"], 2: ["Own", "p"]}


def test_attributes_and_srcset(spark):
    pairs = [["width", "5"], ["role", "x"], ["aria-label", "y"]]
    pic = [["width", "5"], ["srcset", "a.png 1x, b.png 2x"], ["bgcolor", "red"]]
    doc = [para({"t": "Span", "c": [attr("", [], pairs), text("x")]}, image("i", "a.png", attr("", [], pic)))]
    base = W.working(nodes(spark, doc))
    out, renamed = W.namespace_attrs(base)
    got = sorted((r.kind, r.element, r.attribute) for r in renamed.collect())
    assert got == [("Image", "img", "bgcolor"), ("Span", "span", "width")]
    attrs = {r.kind: r.attrs for r in out.filter("attrs IS NOT NULL").collect()}
    assert attrs["Span"] == {"data-width": "5", "role": "x", "aria-label": "y"}
    plain, found = W.split_srcset(base)
    assert found.collect()[0].candidates == ["a.png 1x", "b.png 2x"]
    assert plain.filter("kind = 'Image'").collect()[0].attrs == {"width": "5", "bgcolor": "red"}


def test_localised_references(spark):
    meta = {"cover-image": {"t": "MetaString", "c": "https://x/c.png"}}
    tree = nodes(spark, [para(image("a", "https://x/a.png"), image("b", "b.png"))], meta=meta)
    paths = spark.createDataFrame([("https://x/a.png", "a.png"), ("https://x/c.png", "c.png")], "locator string, path string")
    out = W.localise(W.working(tree), paths)
    assert sorted(r.src for r in out.filter("kind = 'Image'").collect()) == ["a.png", "b.png"]
    assert out.filter("root = 'meta'").collect()[0].text == "c.png"


REF = '<p>Alpha.<sup id="fnref:{0}"><a href="#fn:{0}">{0}</a></sup></p>'
DEF = '<li id="fn:{0}">Body {0}. <a class="footnote-backref" href="#fnref:{0}">b</a></li>'
BOX = '<div id="footnotes"><ol>{}</ol></div>'


def page(*parts):
    return "<html><body><article>" + "".join(parts) + "</article></body></html>"


def test_note_recovery_outcomes(spark):
    refs = REF.format(1) + REF.format(2)
    empty = DEF.format(1) + '<li id="fn:2"><a class="footnote-backref" href="#fnref:2">b</a></li>'
    stray = DEF.format(1) + DEF.format(2).replace("Body", "<p><li>Body", 1)
    pages = [
        page(refs, BOX.format(DEF.format(1) + DEF.format(2))),
        page(refs),
        page(refs, BOX.format(DEF.format(1))),
        page(refs, BOX.format(empty)),
        page(refs, BOX.format(stray)),
        page("<p>none</p>"),
        page(BOX.format(DEF.format(1))),
        page(refs, BOX.format(DEF.format(1) + DEF.format(1) + DEF.format(2))),
        page(refs, '<div id="footnotes"><ol>' + DEF.format(1) + DEF.format(2) + "</ol>"),
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "k bigint, h string")
    tree = pages_to_nodes(df, "k", "h")
    marked, outcome = W.recover_apparatus(tree)
    got = {r.doc_id: (r.outcome, r.reason) for r in outcome.collect()}
    assert got == {
        0: ("recovered", None), 1: ("skipped", "no-definitions"),
        2: ("skipped", "reference-definition-mismatch"), 3: ("skipped", "empty-note"),
        4: ("skipped", "empty-note"), 5: ("not-recognised", "no-apparatus"),
        6: ("skipped", "no-references"), 7: ("skipped", "duplicate-target"),
        8: ("skipped", "unclosed-container"),
    }
    roles = marked.filter(F.col("attrs")["role"].isNotNull()).groupBy("doc_id").count().collect()
    assert [(r.doc_id, r["count"]) for r in roles] == [(0, 3)]


def test_the_whole_chain_loses_no_word(spark):
    doc = [header(2, "Second", "s"), para("see", link("it", "#s"), note(para("why", link("w", "https://x/")))), para(raw("<b>"), "end")]
    titles = spark.createDataFrame([(1, "Whole")], "doc_id bigint, title string")
    out, changes = W.rewrite(nodes(spark, doc), titles)
    assert lines(out)[1] == ["Whole", "Second", "seeit 1", "Footnotes", "Footnote 1. whyw", "end"] or lines(out)[1] == [
        "Whole", "Second", "seeit 1", "end", "Footnotes", "Footnote 1. whyw",
    ]
    log = {r.name: (r.fired, r.changes) for r in W.transform_log(titles, changes).collect()}
    assert log["link-stripping"] == (True, 2) and log["note-conversion"] == (True, 1)
    assert log["raw-html-balance"] == (True, 1) and log["callout-title-emphasis"] == (False, 0)


def test_page_segments_agree(spark):
    html = "<html><head><title>t</title></head><body>a<p>b<b>c<p>d <img alt='e'/><br>f</p><script>x</p></script>g</body></html>"
    df = spark.createDataFrame([(1, html)], "k bigint, h string")
    direct = [r.text for r in pages_to_segments(df, "k", "h").orderBy("seq").collect()]
    assert direct == ["a", "bc", "d e f", "g"]
    built = S.segments(pages_to_nodes(df, "k", "h"), collapse=True).orderBy("text_seg").collect()
    assert [r.text for r in built] == direct


def test_repair_candidates_and_worklist(spark):
    docs = spark.createDataFrame([(1, True, "skipped"), (2, True, "recovered"), (3, False, "skipped")], "doc_id bigint, engaged boolean, recovery_outcome string")
    assert [r.doc_id for r in O.repair_candidates(docs).collect()] == [1]
    merged = O.merge_observations(docs.select("doc_id"), [], ["theme-adaptation", "code-block-reflow"])
    rows = O.worklist(merged, docs.select("doc_id", "engaged")).collect()
    assert sorted((r.doc_id, r.item, r.owner) for r in rows) == [
        (1, "link-interlock", "agent"), (1, "theme-adaptation", "human"), (2, "link-interlock", "agent"),
        (2, "theme-adaptation", "human"), (3, "theme-adaptation", "human"),
    ]


def test_trees_that_cannot_be_read_are_refused(spark):
    from corpusaudit.operators import structure as S
    from corpusaudit.sources import tree as T

    quotes = lambda n: '{"blocks":' + '[{"t":"BlockQuote","c":' * n + "[]" + "}]" * n + "}"
    rows = [(1, '{"blocks":[]}'), (2, "[]"), (3, '{"meta":'), (4, None), (5, quotes(300)), (6, quotes(T.MAX_DEPTH + 5)), (7, quotes(60_000))]
    trees = spark.createDataFrame(rows, "doc_id bigint, tree string")
    got = {r.doc_id: r.reason for r in T.tree_refusals(trees, "doc_id", "tree").collect()}
    assert got == {2: "not-an-object", 3: "not-json", 4: "not-json", 6: "too-deep", 7: "too-deep"}
    nodes = T.trees_to_nodes(trees, "doc_id", "tree")
    assert nodes.filter("doc_id = 5").count() == 300
    assert sorted(r.doc_id for r in S.measure(nodes, trees).filter("blocks = 0").collect()) == [1, 2, 3, 4, 5, 6, 7]
