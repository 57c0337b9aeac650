"""Small document trees for the tests."""

import json

from corpusaudit.sources.tree import trees_to_nodes


def text(words):
    """Inlines of a plain line."""
    out = []
    for i, word in enumerate(words.split(" ")):
        out += [{"t": "Space"}] if i else []
        out.append({"t": "Str", "c": word})
    return out


def attr(ident="", classes=(), pairs=()):
    return [ident, list(classes), [list(p) for p in pairs]]


def para(*inlines):
    return {"t": "Para", "c": [x for i in inlines for x in (text(i) if isinstance(i, str) else [i])]}


def header(level, words, ident=""):
    return {"t": "Header", "c": [level, attr(ident), text(words)]}


def link(words, target, a=None):
    return {"t": "Link", "c": [a or attr(), text(words), [target, ""]]}


def note(*blocks):
    return {"t": "Note", "c": list(blocks)}


def image(alt, src, a=None):
    return {"t": "Image", "c": [a or attr(), text(alt) if alt else [], [src, ""]]}


def div(a, *blocks):
    return {"t": "Div", "c": [a, list(blocks)]}


def figure(caption, *blocks):
    return {"t": "Figure", "c": [attr(), [None, caption], list(blocks)]}


def raw(markup, block=False):
    return {"t": "RawBlock" if block else "RawInline", "c": ["html", markup]}


def nodes(spark, *documents, meta=None):
    rows = [(i, json.dumps({"meta": meta or {}, "blocks": d})) for i, d in enumerate(documents, 1)]
    return trees_to_nodes(spark.createDataFrame(rows, "doc_id bigint, tree string"), "doc_id", "tree")
