"""Words side by side that are folded before a tree is parsed give the rows they give one by one."""

import json

import pytest
from trees import attr, figure, header, image, link, note, para, raw, text

from corpusaudit.sources import tree as T

WAYS = ({"wanted": frozenset(("Link", "Note", "Header"))}, {"runs": True}, {"unwanted": frozenset(T.WORDS)}, {"wanted": ()})
WHOLE = [
    header(1, "spring \\ \"tides\"", "s"),
    para("the sea rises ", link("here and there", "#s"), " at night", note(para("or by day"), para("é é")), raw("<i>"), "a b"),
    figure([para("one two three")], para(image("a map", "m.png"))),
    {"t": "DefinitionList", "c": [[text("high water"), [[para("a b")]]]]},
    {"t": "LineBlock", "c": [text("one two"), text("three four")]},
    {"t": "Odd", "c": [text("x y z"), *text("u v w")]},
]
# Words where lists are read by place, words outside of blocks, runs of which a part is written in another way.
ODD = [
    {"t": "Note", "c": text("a b c")},
    {"t": "Link", "c": text("a b c")},
    {"t": "LineBlock", "c": text("a b")},
    {"t": "Figure", "c": [attr(), text("a b"), text("c d")]},
    *text("words in no block"),
    {"t": "Para", "c": [*text("a b"), {"c": "c", "t": "Str"}, *text("d e"), {"t": "Str", "c": 5}, {"t": "Str", "c": '"},{"t":"Str","c":"'}]},
]


def written(blocks):
    return json.dumps({"meta": {"title": {"t": "MetaInlines", "c": text("a b c")}}, "blocks": blocks}, separators=(",", ":"))


@pytest.mark.parametrize("blocks", [WHOLE, ODD, *([b] for b in ODD)])
def test_folded_words_give_the_same_rows(blocks, monkeypatch):
    tree = written(blocks)
    got = [T.read_or_refuse(1, tree, **way) for way in WAYS]
    monkeypatch.setattr(T, "fold", lambda t: t)
    assert got == [T.read_or_refuse(1, tree, **way) for way in WAYS]


def test_words_nobody_asks_for_are_not_parsed_one_by_one(monkeypatch):
    seen = []
    loads = json.loads
    monkeypatch.setattr(T.json, "loads", lambda t: seen.append(len(t)) or loads(t))
    tree = written([para("word " * 1000, link("a b", "#s"))])
    assert [r[14] for r in T.read_tree(1, tree, wanted=("Link",))] == ["#s"]
    assert seen[0] < len(tree) / 5


@pytest.mark.parametrize("broken", ['{"blocks":{"t":"Str","c":"a"},{"t":"Space"}}', '{"blocks":[{"t":"Str","c":"a"},{"t":"Space"}', '[{"t":"Str","c":"a"},{"t":"Space"}]'])
def test_what_is_no_tree_is_refused_as_before(broken, monkeypatch):
    got = T.read_or_refuse(1, broken, wanted=())
    monkeypatch.setattr(T, "fold", lambda t: t)
    assert got == T.read_or_refuse(1, broken, wanted=()) and got[1] is not None
