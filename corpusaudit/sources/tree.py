"""Document trees as JSON ``{"t": kind, "c": content}`` -> one row per node."""

import hashlib
import json
import re
import sys

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusaudit.schema import NODES
from corpusaudit.sources.rows import dealt, pruned, read_files

# The vocabulary of document trees.
BLOCKS = (
    "BlockQuote BulletList CodeBlock DefinitionList Div Figure Header HorizontalRule LineBlock "
    "OrderedList Para Plain RawBlock Table"
).split()
INLINES = (
    "Cite Code Emph Image LineBreak Link Math Note Quoted RawInline SmallCaps SoftBreak Space "
    "Span Str Strikeout Strong Subscript Superscript Underline"
).split()
META = "MetaBlocks MetaBool MetaInlines MetaList MetaMap MetaString".split()
OTHER = META + (
    "Attr AttributeList Blocks Caption Cell Citation Inlines ListAttributes Meta Pandoc "
    "ReaderOptions Row SimpleTable TableBody TableFoot TableHead WriterOptions"
).split()
SUB_TYPES = (
    "AlignCenter AlignDefault AlignLeft AlignRight AuthorInText ColWidth ColWidthDefault Decimal "
    "DefaultDelim DefaultStyle DisplayMath DoubleQuote Example InlineMath LowerAlpha LowerRoman "
    "NormalCitation OneParen Period SingleQuote SuppressAuthor TwoParens UpperAlpha UpperRoman"
).split()
# Constructs that are carried with full meaning; others are reported.
MODELLED = (
    "Plain Para CodeBlock BlockQuote OrderedList BulletList DefinitionList Header HorizontalRule "
    "Figure Div Str Emph Strong Superscript Subscript SmallCaps Quoted Code Space SoftBreak "
    "LineBreak Link Image Note Span"
).split()

LEAF_BLOCKS = ("CodeBlock", "Header", "LineBlock", "Para", "Plain")
RAW = ("RawBlock", "RawInline")
# Where a kind keeps its identifier, classes and attributes.
ATTRIBUTES_AT = {
    "Header": 1, "Div": 0, "Span": 0, "CodeBlock": 0, "Code": 0, "Table": 0, "Figure": 0,
    "Image": 0, "Link": 0,
}
# Kinds whose visible inlines are the second part of their content.
LABELLED = ("Cite", "Image", "Link", "Quoted", "Span")
SPACES = ("LineBreak", "SoftBreak", "Space")
# Words and spaces that stand side by side, where they come as one row: ``level`` of its nodes are Str and
# ``list_start`` are Space, and it reaches from the first position to the last.
RUN = "#run"
# The parts of a tree, in reading order.
ROOTS = ("meta", "blocks")
# Kinds that hold nothing but their own text.
WORDS = ("Str", *SPACES)
_SAID = frozenset((*WORDS, RUN))

_NOT_NODES = frozenset(SUB_TYPES + [k for k in OTHER if k not in META])
_BLOCKS, _INLINES = frozenset(BLOCKS), frozenset(INLINES)
_OPEN = _BLOCKS | _INLINES | frozenset(META)
_VERBATIM = frozenset(("Code", "Math", "CodeBlock", *RAW))
_RUNNING = ("Str", "Space")


#: Nodes inside nodes; a tree that goes deeper is refused as a whole.
MAX_DEPTH = 500
#: Calls a node may take: a node, its lists and its parts.
_CALLS = 12


class TooDeep(ValueError):
    """A tree that goes deeper than MAX_DEPTH."""


class Folded(ValueError):
    """Folded words stand where items of a list count one by one."""


#: Words and spaces side by side in a list of a tree's JSON. A quote within a string has a backslash before it, so a match
#: is never inside one, and only in a list do objects follow a bracket or a comma.
_OPEN_ITEM = r'\{"t":"S'
_REST = r'(?:tr","c":"(?:[^"\\\x00-\x1f]++|\\.)*+"|pace")\}'
_SIDE_BY_SIDE = re.compile(rf"{_OPEN_ITEM}(?<=[\[,]{_OPEN_ITEM}){_REST}(?:,{_OPEN_ITEM}{_REST})++(?=[\],])")
_SPACE, _FIRST, _NEXT = '{"t":"Space"}', '{"t":"Str","c":"', '"},{"t":"Str","c":"'
_FOLD = "#folded"


def _folded(match):
    items = match[0]
    texts = items.replace(_SPACE, '{"t":"Str","c":" "}')[len(_FIRST) : -2]
    return '{"%s":"%d %d %s"}' % (_FOLD, texts.count(_NEXT) + 1, items.count(_SPACE), texts.replace(_NEXT, ""))


def fold(text):
    """A tree's JSON with words and spaces side by side as one object: how many, how many spaces, and their text.

    Most of a tree is words, and each costs as much to parse as any node.
    """
    return text if f'"{_FOLD}"' in text else _SIDE_BY_SIDE.sub(_folded, text)


def _items(value):
    """The items of a list that count one by one; none of what is no list."""
    if not isinstance(value, list):
        return ()
    for item in value:
        if type(item) is dict and _FOLD in item:
            raise Folded
    return value


def _runs_on(item):
    return isinstance(item, dict) and item.get("t") in _RUNNING


def _at(value, *path):
    for step in path:
        if not isinstance(value, list) or step >= len(_items(value)):
            return None
        value = value[step]
    return value


def _text(value):
    return value if isinstance(value, str) else None


class TreeReader:
    """Reads one tree into rows in the order of the node schema.

    Only rows of the kinds ``wanted`` are made, or all but the ``unwanted``, and of the ``roots`` named; positions
    are those of the whole tree. With ``runs``, words and spaces side by side are one row.
    """

    def __init__(self, doc_id, wanted=None, unwanted=(), roots=ROOTS, runs=False):
        self.doc_id = doc_id
        self.rows = []
        self.children = {}
        self.nodes = 0
        self.said = []
        self.runs = runs
        self.roots = roots
        self.chosen = lambda kind: (wanted is None or kind in wanted) and kind not in unwanted
        #: Whether words side by side may be folded (``fold``), as no row of a single one is asked for.
        self.folds = runs or not (self.chosen("Str") or self.chosen("Space"))

    def read(self, tree):
        if not isinstance(tree, dict):
            return []
        for root in ROOTS:
            self.wants = self.chosen if root in self.roots else lambda kind: False
            self.words = self.wants("Str") or self.wants("Space")
            place = (None, 0, root, None, None, root == "blocks", root == "blocks", False, None)
            self._walk(tree.get(root), "/" + root, place)
        return self.rows

    # A place: parent, depth, root, reading block, segment, measured, visible, inside an image,
    # innermost note.

    def _row(self, kind, pointer, place):
        parent, depth, root, read, seg, measured, _, in_image, note = place
        if depth > MAX_DEPTH:
            raise TooDeep
        sib = self.children.get(parent, 0)
        self.children[parent] = sib + 1
        node = self.nodes
        self.nodes += 1
        row = [
            self.doc_id, node, node, parent, depth, sib, root, pointer, kind, None, None, None,
            None, None, None, None, None, None, read, seg, measured, in_image, None, None, note,
            True,
        ]
        if self.wants(kind):
            self.rows.append(row)
        return row

    def _run(self, items, first, pointer, place, folded=0):
        """Read the words and spaces that stand side by side from an item on; returns the place behind them.

        ``folded``: how many items more than there are stood before.
        """
        texts, spaces, at, behind = [], 0, first, len(items)
        add = texts.append
        while at < behind:
            item = items[at]
            if not isinstance(item, dict):
                break
            kind, content = item.get("t"), item.get("c")
            if kind == "Str":
                if not isinstance(content, str):
                    if isinstance(content, (list, dict)):
                        break
                    content = ""
                add(content)
            elif kind == "Space" and not isinstance(content, (list, dict)):
                add(" ")
                spaces += 1
            else:
                break
            at += 1
        if not texts:
            return first
        parent, depth, root, read, seg, measured, visible, in_image, note = place
        if depth > MAX_DEPTH:
            raise TooDeep
        sib, node = self.children.get(parent, 0), self.nodes
        self.children[parent] = sib + len(texts)
        self.nodes += len(texts)
        self.said += texts
        if not self.words:
            return at
        alone = visible and seg is None
        if self.runs and not alone:
            self.rows.append([
                self.doc_id, node, self.nodes - 1, parent, depth, sib, root, f"{pointer}/{first + folded}", RUN, None, len(texts) - spaces, None,
                None, None, None, None, spaces, None, read, seg, measured, in_image, None, "".join(texts), note,
                True,
            ])
            return at
        for i, text in enumerate(texts):
            kind = items[first + i]["t"]
            if self.wants(kind):
                self.rows.append([
                    self.doc_id, node + i, node + i, parent, depth, sib + i, root, f"{pointer}/{first + folded + i}", kind, None, None,
                    None, None, None, None, None, None, None, read, node + i if alone else seg, measured, in_image, None, text,
                    note, True,
                ])
        return at

    def _fold(self, folded, first, pointer, place):
        """Read folded words as ``_run`` reads them item by item; returns how many items they are."""
        many, spaces, text = folded.split(" ", 2)
        many, spaces = int(many), int(spaces)
        parent, depth, root, read, seg, measured, visible, in_image, note = place
        if depth > MAX_DEPTH:
            raise TooDeep
        if self.words and (not self.runs or (visible and seg is None)):
            raise Folded
        sib, node = self.children.get(parent, 0), self.nodes
        self.children[parent] = sib + many
        self.nodes += many
        self.said.append(text)
        if self.words:
            self.rows.append([
                self.doc_id, node, self.nodes - 1, parent, depth, sib, root, f"{pointer}/{first}", RUN, None, many - spaces, None,
                None, None, None, None, spaces, None, read, seg, measured, in_image, None, text, note,
                True,
            ])
        return many

    def _walk(self, value, pointer, place):
        if isinstance(value, list):
            at, behind, folded = 0, len(value), 0
            while at < behind:
                item = value[at]
                if isinstance(item, dict):
                    if _FOLD in item:
                        if self.words and any(_runs_on(i) for i in (*value[at - 1 : at], *value[at + 1 : at + 2])):
                            raise Folded  # one run, part of which is written in another way
                        folded += self._fold(item[_FOLD], at + folded, pointer, place) - 1
                        at += 1
                        continue
                    if item.get("t") in _RUNNING:
                        reached = self._run(value, at, pointer, place, folded)
                        if reached > at:
                            at = reached
                            continue
                self._walk(item, f"{pointer}/{at + folded}", place)
                at += 1
        elif isinstance(value, dict):
            kind = _text(value.get("t"))
            if kind is None or kind in _NOT_NODES:
                for key, item in value.items():
                    self._walk(item, f"{pointer}/{key}", place)
            else:
                self._node(kind, value, pointer, place)

    def _node(self, kind, value, pointer, place):
        content = value.get("c")
        row = self._row(kind, pointer, place)
        node, before = row[1], len(self.said)
        self._facts(kind, content, row)
        if row[23] is not None and kind not in RAW:
            self.said.append(row[23])
        inside = [node, row[4] + 1, *place[2:]]
        if kind in LEAF_BLOCKS:
            if place[5]:
                inside[3] = row[18] = node
        elif kind not in _INLINES:
            row[18] = None
        if place[6] and inside[4] is None and (kind in LEAF_BLOCKS or kind in _INLINES):
            inside[4] = row[19] = node
        self._content(kind, value, content, pointer + "/c", row, inside)
        row[2] = self.nodes - 1
        if kind in ("Link", "Image", "Header"):
            row[22] = "".join(self.said[before:]).strip()

    def _facts(self, kind, content, row):
        at = ATTRIBUTES_AT.get(kind)
        if at is not None:
            row[11] = _text(_at(content, at, 0)) or None
            row[12] = [c for c in (_at(content, at, 1) or []) if isinstance(c, str)] or None
            pairs = _at(content, at, 2) or []
            row[13] = {str(_at(p, 0)): str(_at(p, 1)) for p in pairs} or None
        if kind == "Header":
            row[10] = _at(content, 0) if isinstance(_at(content, 0), int) else 0
        elif kind == "Link":
            row[14] = _text(_at(content, 2, 0)) or ""
        elif kind == "Image":
            row[15] = _text(_at(content, 2, 0)) or ""
        elif kind == "OrderedList":
            start, style = _at(content, 0, 0), _at(content, 0, 1)
            row[16] = start if isinstance(start, int) and not isinstance(start, bool) else None
            row[17] = _text(style.get("t")) if isinstance(style, dict) else None
        if kind in ("Str", "MetaString"):
            row[23] = _text(content) or ""
        elif kind in SPACES:
            row[23] = " "
        elif kind in ("Code", "Math", "CodeBlock"):
            row[23] = _text(_at(content, 1)) or ""
        elif kind in RAW:
            row[9], row[23] = _text(_at(content, 0)), _text(_at(content, 1)) or ""

    def _content(self, kind, value, content, pointer, row, inside):
        """Descend: each part of a node decides what is measured and what is visible below it."""
        if kind in _VERBATIM:
            return
        if kind == "Para" or kind == "Plain":
            self._walk(content, pointer, inside)
        elif kind in LABELLED:
            visible = list(inside)
            if kind == "Link" or kind == "Image":
                visible[5] = False
                visible[7] = inside[7] or kind == "Image"
            self._walk(_at(content, 0), pointer + "/0", [*inside[:5], False, False, *inside[7:]])
            self._walk(_at(content, 1), pointer + "/1", visible)
        elif kind == "Header":
            self._walk(_at(content, 2), pointer + "/2", inside)
        elif kind == "Note":
            self._note(content, pointer, inside)
        elif kind == "Figure":
            self._walk(_at(content, 1, 0), pointer + "/1/0", [*inside[:5], False, False, *inside[7:]])
            self._walk(_at(content, 1, 1), pointer + "/1/1", inside)
            self._walk(_at(content, 2), pointer + "/2", inside)
        elif kind == "DefinitionList":
            for i, entry in enumerate(_items(content)):
                self._term(_at(entry, 0), f"{pointer}/{i}/0", inside)
                self._walk(_at(entry, 1), f"{pointer}/{i}/1", inside)
        elif kind == "LineBlock":
            for i, line in enumerate(_items(content)):
                if i:
                    self._pad("\n", pointer, inside)
                self._walk(line, f"{pointer}/{i}", inside)
        elif kind in _OPEN:
            self._walk(content, pointer, inside)
        else:
            # A kind nobody named: its text still shows, its facts are not measured.
            unmeasured = [*inside[:5], False, *inside[6:]]
            for key, item in value.items():
                self._walk(item, f"{pointer[:-2]}/{key}", unmeasured)

    def _pad(self, text, pointer, inside):
        row = self._row("#pad", pointer, inside)
        row[23] = text
        self.said.append(text)
        return row

    def _term(self, inlines, pointer, inside):
        row = self._row("#term", pointer, inside)
        below = [row[1], row[4] + 1, *inside[2:]]
        if inside[5]:
            below[3] = row[18] = row[1]
        if inside[6] and below[4] is None:
            below[4] = row[19] = row[1]
        self._walk(inlines, pointer, below)
        row[2] = self.nodes - 1

    def _note(self, blocks, pointer, inside):
        """A note is set apart from the words around it, and its blocks from each other."""
        if not inside[7]:
            inside = [*inside[:8], inside[0]]
        self._pad(" ", pointer, inside)
        for i, block in enumerate(_items(blocks)):
            if i:
                self._pad(" ", pointer, inside)
            self._walk(block, f"{pointer}/{i}", inside)
        self._pad(" ", pointer, inside)


def read_or_refuse(doc_id, text, **chosen):
    """(rows, reason): the rows of one tree, or why there are none. ``chosen`` is for the reader."""
    limit = sys.getrecursionlimit()
    try:
        sys.setrecursionlimit(max(limit, 1000 + _CALLS * MAX_DEPTH))
        reader = TreeReader(doc_id, **chosen)
        if reader.folds and text:
            try:
                tree = json.loads(fold(text))
                return (reader.read(tree), None) if isinstance(tree, dict) else ([], "not-an-object")
            except Folded:
                reader = TreeReader(doc_id, **chosen)
        tree = json.loads(text or "")
        if not isinstance(tree, dict):
            return [], "not-an-object"
        return reader.read(tree), None
    except (TooDeep, RecursionError):
        return [], "too-deep"
    except ValueError:
        return [], "not-json"
    finally:
        sys.setrecursionlimit(limit)


def read_tree(doc_id, text, **chosen):
    """Rows of one tree; a tree that cannot be read gives none, and a row of ``tree_refusals``."""
    return read_or_refuse(doc_id, text, **chosen)[0]


def read_digests(doc_id, text, wanted=None, top=False):
    """(doc_id, node, parent, depth, root, kind, size, digest) of the nodes of one tree with all below them.

    What ``structure.subtree_digests`` makes of the node table, made while a tree is at hand: children
    come behind their node, so one pass from the last node to the first meets them all before it.
    Only nodes of the kinds ``wanted``, or only the ``top`` ones, have a row.
    """
    found, below, leaves = [], {}, {}
    for row in reversed(read_tree(doc_id, text)):
        node, parent, kind = row[1], row[3], row[8]
        children = below.pop(node, None)
        if children is None and kind in WORDS:
            digest = leaves.get((kind, row[23]))
            if digest is None:
                digest = leaves[kind, row[23]] = _digest(row, ())
        else:
            digest = _digest(row, children or ())
        if parent is not None:
            held = below.get(parent)
            if held is None:
                below[parent] = [digest]
            else:
                held.append(digest)
        if (wanted is None or kind in wanted) and not (top and row[4]):
            found.append((doc_id, node, parent, row[4], row[6], kind, row[2] - node + 1, digest))
    return found


def _digest(row, children):
    """Digest of a node's own facts and its children's digests, the last child first."""
    parts = ["\x00" if row[i] is None else str(row[i]) for i in _OWN]
    parts.append("\x00" if row[12] is None else " ".join(row[12]))
    parts.append("\x00" if row[13] is None else ";".join(sorted(f"{k}={v}" for k, v in row[13].items())))
    own = hashlib.sha256("\x1f".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
    return hashlib.sha256((own + "".join(reversed(children))).encode()).hexdigest()


# Places of a node's own facts, in the order they are digested.
_OWN = [NODES.fieldNames().index(c) for c in "kind tag level ident href src list_start list_style text".split()]
_DIGESTS = T.StructType(
    [
        *[NODES[c] for c in ("doc_id", "node", "parent", "depth", "root", "kind")],
        T.StructField("size", T.LongType()),
        T.StructField("digest", T.StringType()),
    ]
)


def trees_to_digests(trees: DataFrame, key: str, tree: str, kinds=None, top: bool = False, deal: bool = True) -> DataFrame:
    """Digests of the subtrees of document trees, of the named kinds, or only those of the ``top`` nodes.

    Columns and digests are those of ``structure.subtree_digests``. No node is shuffled or written.
    """
    wanted = frozenset(kinds) if kinds else None

    def rows(doc_id, text):
        return read_digests(doc_id, text, wanted, top)

    chosen = dealt(trees.select(key, tree), key, deal=deal)
    return read_files(chosen, rows, _DIGESTS, (key, tree))


_REFUSAL = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("reason", T.StringType(), False)])


def tree_refusals(trees: DataFrame, key: str, tree: str, deal: bool = True) -> DataFrame:
    """(doc_id, reason) of every document whose tree cannot be read. Rows are dealt out unless they are already."""

    def refused(doc_id, text):
        reason = read_or_refuse(doc_id, text, wanted=())[1]
        return [] if reason is None else [(doc_id, reason)]

    chosen = dealt(trees.select(key, tree), key, deal=deal)
    return read_files(chosen, refused, _REFUSAL, (key, tree))


def trees_to_nodes(
    trees: DataFrame, key: str, tree: str, kinds=None, columns=None, deal: bool = True, without=(), roots=ROOTS, runs=False,
    telling=(),
) -> DataFrame:
    """The ``nodes`` table of document trees, of the named kinds and columns where a job needs few.

    Trees are dealt out by their key first, unless they are already. Kinds in ``without`` are left out, and
    parts of the tree that are not among ``roots``. With ``runs``, words and spaces side by side come as one row (``RUN``): their text is the same, there are far
    fewer rows, and nothing that looks at other kinds sees a difference. With ``telling``, words and spaces without
    facts of their own come from trees that hold a node of those kinds alone.
    """
    wanted = frozenset(kinds) if kinds else None
    unwanted = frozenset(without)
    schema, keep = pruned(NODES, columns)

    def rows(doc_id, text):
        found = read_tree(doc_id, text, wanted=wanted, unwanted=unwanted, roots=roots, runs=runs)
        if telling and not any(row[8] in telling for row in found):
            found = [row for row in found if row[8] not in _SAID]
        return map(keep, found)

    chosen = dealt(trees.select(key, tree), key, deal=deal)
    return read_files(chosen, rows, schema, (key, tree))
