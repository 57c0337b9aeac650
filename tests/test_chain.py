"""What the chain of rewrites writes and carries, and what readers leave out for it."""

from corpusaudit.operators import rewrite as W
from corpusaudit.session import BATCH_BYTES
from corpusaudit.sources.tree import trees_to_nodes
from tests.trees import attr, header, link, nodes, note, para

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
DOC = [header(2, "Second", "s"), para("see", link("it", "#s"), note(para("why", link("w", "https://x/")))), para("end")]


def test_a_chain_for_few_columns_writes_only_those_and_has_the_same_rows(spark, monkeypatch):
    titles = spark.createDataFrame([(1, "Whole")], "doc_id bigint, title string")
    whole = W.rewrite(nodes(spark, DOC), titles)[0].select("doc_id", "kind", "text")
    written = []
    keep = W.materialise
    monkeypatch.setattr(W, "materialise", lambda df, *by: (written.append(df.columns), keep(df, *by))[1])
    few = W.rewrite(nodes(spark, DOC).localCheckpoint(), titles, columns=("doc_id", "kind", "text"), written=True)[0]
    assert sorted(map(str, few.collect())) == sorted(map(str, whole.collect()))
    passed_on = [c for c in written if "tag" in c and "depth" in c and "pointer" not in c]
    assert len(passed_on) == 1 and not {"label", "classes", "end_node", "parent"} & set(passed_on[0])


def test_only_links_are_looked_up_where_links_lose_their_target(spark):
    w = W.working(nodes(spark, DOC)).localCheckpoint()
    few = W.strip_links(w)[0].select("doc_id", "kind")
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    rows = W.strip_links(w)[0].collect()
    lone = next(r for r in rows if r.text == "w")
    assert next(r.kind for r in rows if r.node == lone.parent) == "Para"


def test_words_come_from_trees_that_hold_a_telling_node(spark):
    import json

    trees = [(1, json.dumps({"blocks": [para("a b", link("c", "#x"))]})), (2, json.dumps({"blocks": [{"t": "Div", "c": [attr(), [para("d e")]]}]}))]
    table = spark.createDataFrame(trees, "doc_id bigint, tree string")
    before = spark.conf.get(LIMIT)
    try:
        spark.conf.set(LIMIT, f"{64 << 20}b")
        rows = trees_to_nodes(table, "doc_id", "tree", runs=True, telling=("Div",)).select("doc_id", "kind", "text").collect()
        assert spark.conf.get(LIMIT) == f"{BATCH_BYTES}b"
    finally:
        spark.conf.set(LIMIT, before)
    assert sorted((r.doc_id, r.kind) for r in rows) == [(1, "Link"), (1, "Para"), (2, "#run"), (2, "Div"), (2, "Para")]
