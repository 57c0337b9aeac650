"""Ways of reading trees that must tell the same as the plain one."""

import json

from trees import attr, div, figure, header, image, link, nodes, note, para, raw

from corpusaudit.operators import rewrite as W
from corpusaudit.operators import structure as S
from corpusaudit.sources import tree as T

PLAIN = {"t": "Plain", "c": [{"t": "Str", "c": "line"}, {"t": "SoftBreak"}, {"t": "Str", "c": "two"}]}
DOCS = [
    [header(1, "A b", "a"), para("low tide", link("see the shore", "#a"), note(para("and so"), para("on")), "is far off")],
    [para("x  y", image("a tide", "t.png"), raw("<i>"), "z", raw("</i>"))],
    [figure([{"t": "Plain", "c": [{"t": "Str", "c": "tide"}]}], para("tide")), para("tide")],
    [div(attr("", ["callout-title"]), div(attr("", ["callout-title-inner"]), PLAIN)), {"t": "Odd", "c": [{"t": "Str", "c": "alone"}, {"t": "Space"}]}],
    [{"t": "Para", "c": [{"t": "Str", "c": "a b"}, {"t": "Space"}, {"t": "Str", "c": "c"}]}],
    [{"t": "Para", "c": [{"t": "Str", "c": "a"}, {"t": "Space"}, {"t": "Str", "c": "b c"}]}],
    [{"t": "Para", "c": [{"t": "Str", "c": [{"t": "Str", "c": "within"}]}, {"t": "Str"}, "stray"]}],
]


def _trees(spark):
    rows = [(i, json.dumps({"meta": {"title": {"t": "MetaString", "c": "T"}}, "blocks": d})) for i, d in enumerate(DOCS, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, tree string")


def test_digests_made_while_reading_are_those_of_the_node_table(spark):
    made = T.trees_to_digests(_trees(spark), "doc_id", "tree")
    want = S.subtree_digests(T.trees_to_nodes(_trees(spark), "doc_id", "tree"))
    names = sorted(want.columns)
    assert sorted(map(tuple, made.select(names).collect()), key=repr) == sorted(map(tuple, want.select(names).collect()), key=repr)
    tops = T.trees_to_digests(_trees(spark), "doc_id", "tree", top=True)
    assert {r.depth for r in tops.collect()} == {0}
    whole = {r.doc_id: r.digest for r in S.tree_digest(None, tops).collect()}
    assert whole == {r.doc_id: r.digest for r in S.tree_digest(T.trees_to_nodes(_trees(spark), "doc_id", "tree")).collect()}
    assert whole[5] != whole[6]


def test_runs_say_the_same_in_fewer_rows(spark):
    each = T.trees_to_nodes(_trees(spark), "doc_id", "tree")
    runs = T.trees_to_nodes(_trees(spark), "doc_id", "tree", runs=True)
    assert runs.count() < each.count()
    assert {(r.level, r.list_start, r.text) for r in runs.filter("kind = '#run' AND text = 'is far off'").collect()} == {(3, 2, "is far off")}
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(S.construct_counts(runs, runs=True)) == rows(S.construct_counts(each))
    assert rows(S.render_text(S.visible_segments(runs))) == rows(S.render_text(S.visible_segments(each)))
    titles = spark.createDataFrame([(i, f"D {i}") for i in range(1, len(DOCS) + 1)], "doc_id bigint, title string")
    (a, log_a), (b, log_b) = W.rewrite(runs, titles), W.rewrite(each, titles)
    assert rows(S.construct_counts(a, runs=True)) == rows(S.construct_counts(b))
    assert rows(S.render_text(S.segments(a), "text_seg")) == rows(S.render_text(S.segments(b), "text_seg"))
    assert all(log_a[k].count() == log_b[k].count() for k in log_b)


def test_rows_left_out_change_no_other(spark):
    each = {r.node: r for r in nodes(spark, DOCS[0], meta={"t": {"t": "MetaString", "c": "T"}}).collect()}
    tree = json.dumps({"meta": {"t": {"t": "MetaString", "c": "T"}}, "blocks": DOCS[0]})
    full = T.read_tree(1, tree)
    assert len(full) == len(each)
    assert T.read_tree(1, tree, unwanted=T.WORDS) == [r for r in full if r[8] not in T.WORDS]
    assert T.read_tree(1, tree, wanted=("Link", "Str")) == [r for r in full if r[8] in ("Link", "Str")]
    assert T.read_tree(1, tree, roots=("meta",)) == [r for r in full if r[6] == "meta"]
