from trees import header, link, nodes, note, para

from corpusaudit.operators import structure as S
from corpusaudit.operators.layers import layered


def test_values_come_from_the_layer_that_says_them_last(spark):
    shape = "k string, version long, gone boolean, a int, b string"
    low = spark.createDataFrame(
        [("x", 1, False, 1, "one"), ("x", 2, False, None, "two"), ("y", 5, False, 7, None), ("z", 1, None, 3, "z"), (None, 1, False, 9, None)], shape
    )
    high = spark.createDataFrame([("x", 2, False, 4), ("y", 5, True, None), ("y", 4, False, 8), ("z", None, False, 6)], "k string, version long, gone boolean, a int")
    got = {r.k: r for r in layered({"low": low, "high": high}, ["k"], ["a", "b"]).collect()}
    assert got["x"][1:] == (4, "high", ["low"], "two", "low", [])
    assert got["y"][1:] == (None, "high", ["low"], None, "high", [])
    assert got["z"][1:] == (3, "low", ["high"], "z", "low", [])
    assert got[None][1:] == (9, "low", [], None, None, [])
    assert len(got) == 4


def test_equal_subtrees_agree_wherever_they_stand(spark):
    same = para("tide", link("out", "#x"), note(para("low")))
    docs = [[header(1, "A", "a"), same], [para("first"), same, same], [header(1, "A", "a"), same]]
    found = S.subtree_digests(nodes(spark, *docs))
    rows = found.collect()
    paras = {r.digest for r in rows if r.kind == "Para" and r.size > 5}
    assert len(paras) == 1
    often = {(r.kind, r.n, r.documents, r.doc_id) for r in S.repeated_subtrees(found).collect() if r.digest in paras}
    assert often == {("Para", 4, 3, 1)}
    whole = {r.doc_id: r.digest for r in S.tree_digest(nodes(spark, *docs)).collect()}
    assert whole[1] == whole[3] != whole[2]
    sizes = {r.doc_id: r.size for r in rows if r.kind == "Header"}
    assert sizes == {1: 2, 3: 2}


def test_order_counts_and_nothing_is_an_empty_table(spark):
    a, b = para("a"), para("b")
    whole = {r.doc_id: r.digest for r in S.tree_digest(nodes(spark, [a, b], [b, a])).collect()}
    assert whole[1] != whole[2]
    assert S.subtree_digests(nodes(spark, [])).collect() == []
