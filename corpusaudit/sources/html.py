"""Web pages and content documents -> one row per node.

Reading is tolerant: stray end tags are passed over, an open paragraph ends where a block
begins, list items, table cells and links do not nest in their own kind.
"""

import re
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from corpusaudit.schema import NODES, SEGMENTS
from corpusaudit.sources.rows import arrow_rows, dealt, pruned

# What counts as a reading block for link density, and what holds blocks.
READING_BLOCKS = frozenset(
    "p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd figcaption td th".split()
)
IMPLICIT_CONTAINERS = frozenset("section div body".split())
# What starts a segment of visible text. A different list on purpose.
TEXT_BLOCKS = frozenset(
    "address article aside blockquote dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 "
    "header li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("head script style template".split())
NOTEREF = frozenset(("noteref", "doc-noteref"))

# Fixed values of HTML: elements without content, and what ends an open paragraph.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr main nav ol p pre section table ul".split()
)
# A tag that starts ends an open one of the named kind, up to the named boundary.
ENDS_SIBLING = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "a": (("a",), ("td", "th", "table")),
}
# Tag -> kind of node, in the vocabulary of document trees.
KINDS = {
    "a": "Link", "img": "Image", "p": "Para", "pre": "CodeBlock", "code": "Code",
    "ol": "OrderedList", "ul": "BulletList", "dl": "DefinitionList", "table": "Table",
    "blockquote": "BlockQuote", "figure": "Figure", "div": "Div", "section": "Div",
    "span": "Span", "s": "Strikeout", "del": "Strikeout", "strike": "Strikeout",
    "em": "Emph", "i": "Emph", "strong": "Strong", "b": "Strong", "u": "Underline",
    "sup": "Superscript", "sub": "Subscript", "br": "LineBreak", "hr": "HorizontalRule",
    "h1": "Header", "h2": "Header", "h3": "Header", "h4": "Header", "h5": "Header",
    "h6": "Header",
}
LABELLED = frozenset(("a", "h1", "h2", "h3", "h4", "h5", "h6"))


class Element:
    """One open element while a page is read."""

    __slots__ = ("row", "tag", "children", "read", "seg", "inline", "skipped", "label", "noteref")


class PageReader(HTMLParser):
    """Reads one page into ``rows``, each a list in the order of the node schema.

    Without ``words`` no rows of running text are made; positions and labels are those of the whole page.
    """

    def __init__(self, doc_id, words=True):
        super().__init__(convert_charrefs=True)
        self.doc_id = doc_id
        self.words = words
        self.rows = []
        self.nodes = 0
        self.open = []
        self.segments = 0
        self.top = 0

    def _segment(self):
        self.segments += 1
        return self.segments

    def _row(self, kind, tag, text=None, seg=None, read=None):
        """Append one node under the innermost open element and return its row."""
        above = self.open[-1] if self.open else None
        sib = above.children if above else self.top
        if above:
            above.children += 1
        else:
            self.top += 1
        node = self.nodes
        self.nodes += 1
        row = [
            self.doc_id, node, node, above.row[1] if above else None, len(self.open), sib, "html",
            (above.row[7] if above else "") + "/" + str(sib), kind, tag, None, None, None, None,
            None, None, None, None, read, seg, not (above and above.skipped), False, None, text,
            None, True,
        ]
        self.rows.append(row)
        return row

    def handle_starttag(self, tag, attrs):
        tag = tag.rsplit(":", 1)[-1]
        self._implied_ends(tag)
        self._open(tag, attrs)
        if tag in VOID:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self._implied_ends(tag)
        self._open(tag.rsplit(":", 1)[-1], attrs)
        self._close()

    def handle_endtag(self, tag):
        tag = tag.rsplit(":", 1)[-1]
        for depth in range(len(self.open) - 1, -1, -1):
            found = self.open[depth].tag
            if found == tag:
                while len(self.open) > depth + 1:
                    self._close(written=False)
                self._close()
                return
            if tag not in TEXT_BLOCKS and tag not in ("html", "body") and found in TEXT_BLOCKS:
                return

    def handle_data(self, data):
        if not self.open and not data.strip():
            return
        above = self.open[-1] if self.open else None
        if above is not None and above.tag in ("script", "style"):
            return
        if self.words:
            self._row("Str", None, data, above.seg if above else None, above.read if above else None)
        else:
            self.nodes += 1
            if above:
                above.children += 1
            else:
                self.top += 1
        for element in self.open:
            if element.label is not None:
                element.label.append(data)

    def _implied_ends(self, tag):
        if tag in ENDS_PARAGRAPH:
            self._end_open(("p",), TEXT_BLOCKS - {"p"})
        if tag in ENDS_SIBLING:
            self._end_open(*ENDS_SIBLING[tag])

    def _end_open(self, tags, boundary):
        for depth in range(len(self.open) - 1, -1, -1):
            found = self.open[depth].tag
            if found in tags:
                while len(self.open) > depth:
                    self._close(written=False)
                return
            if found in boundary:
                return

    def _open(self, tag, attrs):
        above = self.open[-1] if self.open else None
        skipped = tag in SKIPPED or bool(above and above.skipped)
        values = {}
        for key, value in attrs:
            values.setdefault(key, value or "")
        row = self._row(KINDS.get(tag, "Element"), tag)
        row[11] = values.pop("id", None)
        row[12] = values.pop("class", "").split() or None
        row[14] = values.get("href") if tag == "a" else None
        row[15] = values.get("src") if tag == "img" else None
        row[13] = values or None
        row[20] = not skipped
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            row[10] = int(tag[1])
        if tag == "ol":
            start = values.get("start", "")
            row[16] = int(start) if start.lstrip("-").isdigit() else 1
            row[17] = values.get("type")
        el = Element()
        el.row, el.tag, el.children, el.skipped = row, tag, 0, skipped
        el.label = [] if tag in LABELLED else None
        el.inline = False
        el.noteref = False
        self._place(el, above, row[1])
        row[18] = el.read if tag in READING_BLOCKS or tag not in IMPLICIT_CONTAINERS else None
        if not skipped and above is not None and el.seg is not None and el.inline:
            marks = " ".join(v for k, v in values.items() if k.rsplit(":", 1)[-1] in ("role", "type"))
            el.noteref = not NOTEREF.isdisjoint(marks.lower().split())
        if el.seg is not None and tag == "br":
            row[19], row[23] = el.seg, " "
        if tag == "img":
            row[22] = values.get("alt")
            if el.seg is not None:
                row[19], row[23] = el.seg, values.get("alt") or ""
        self.open.append(el)
        if el.noteref:
            self._row("#pad", None, " ", el.seg)

    def _place(self, el, above, node):
        """Decide the reading block and the text segment of one element."""
        if el.skipped:
            el.read = el.seg = None
            return
        if el.tag in READING_BLOCKS:
            el.read = node
            if above:
                above.read = None
        elif el.tag in IMPLICIT_CONTAINERS:
            el.read = None
            if above:
                above.read = None
        elif above is None:
            el.read = None
        else:
            if above.read is None:
                above.read = node
            el.read = above.read
        inside = above is not None and above.seg is not None
        if el.tag == "body":
            el.seg = self._segment()
        elif not inside:
            el.seg = None
        elif el.tag in TEXT_BLOCKS and not above.inline:
            el.seg = self._segment()
        else:
            el.seg, el.inline = above.seg, True

    def _close(self, written=True):
        el = self.open[-1]
        el.row[25] = written
        if el.noteref:
            self._row("#pad", None, " ", el.seg)
        self.open.pop()
        el.row[2] = self.nodes - 1
        if el.label is not None:
            el.row[22] = " ".join("".join(el.label).split())
        above = self.open[-1] if self.open else None
        if above is not None and above.seg is not None and not el.inline and el.seg is not None:
            above.seg = self._segment()

    def finish(self):
        self.close()
        while self.open:
            self._close(written=False)
        return self.rows


def _local(name):
    """Name of an element or attribute without its namespace, as the tolerant reader sees it."""
    return name.rsplit("}", 1)[-1].lower()


def _attribute(name):
    space, _, local = name.rpartition("}")
    return "epub:" + local if space.endswith("/ops") else local


def read_element(doc_id, root, words=True):
    """Rows of one well-formed document: its own tree as it stands, with nothing implied."""
    reader = PageReader(doc_id, words)
    waiting = [(root, False)]
    add = waiting.append
    local, attribute = {}, {}  # names met before
    while waiting:
        element, leaving = waiting.pop()
        if leaving:
            reader._close()
        elif isinstance(element.tag, str):
            tag = local.get(element.tag) or local.setdefault(element.tag, _local(element.tag))
            attrs = [(attribute.get(k) or attribute.setdefault(k, _attribute(k)), v) for k, v in element.items()] if element.attrib else ()
            reader._open(tag, attrs)
            if element.text:
                reader.handle_data(element.text)
            if len(element):
                add((element, True))
                for child in reversed(element):
                    add((child, False))
                continue
            reader._close()
        # Else it is a comment or an instruction.
        if element.tail and element is not root:
            reader.handle_data(element.tail)
    return reader.rows


def segments_of(doc_id, rows):
    """(doc_id, seq, text) of the rows of one page: visible text, one row per block."""
    pieces = {}
    for row in rows:
        if row[19] is not None and row[23] is not None:
            pieces.setdefault(row[19], []).append(row[23])
    kept = (" ".join("".join(parts).split()) for _, parts in sorted(pieces.items()))
    return [(doc_id, i, text) for i, text in enumerate(t for t in kept if t)]


_REFERENCE = re.compile(r"&(#(?:[0-9]+|[xX][0-9a-fA-F]+);|[A-Za-z][A-Za-z0-9]*;)?")


def written_out(html):
    """A page in which an ampersand that begins no closed reference is written as one, so that it stays as it is."""
    known = lambda m: m[1] is not None and (m[1][0] == "#" or m[1] in html5)
    return _REFERENCE.sub(lambda m: m[0] if known(m) else "&amp;" + m[0][1:], html)


def read_page(doc_id, html, closed=False):
    """Rows of one page. ``closed``: only references that end in a semicolon are undone, as XML has it.

    Without it ``&amp`` is undone as well, as in a browser.
    """
    reader = PageReader(doc_id)
    reader.feed(written_out(html or "") if closed else html or "")
    return reader.finish()


def read_segments(doc_id, html, closed=False):
    """(doc_id, seq, text) of one page: visible text, one row per block, white space collapsed."""
    return segments_of(doc_id, read_page(doc_id, html, closed))


def pages_to_nodes(
    pages: DataFrame, key: str, html: str, kinds=None, keep=(), named=False, only=None, deal=True, closed=False
) -> DataFrame:
    """The ``nodes`` table of pages. Filter and prune ``pages`` first: nothing is pushed through.

    ``kinds`` names the kinds to emit where a job needs only some, such as links; positions
    stay those of the whole page. ``named`` adds nodes of any kind with an identifier. ``keep`` names columns of the page to repeat on its nodes, which
    saves a join back. ``only`` names the node columns wanted. Pages are dealt out by their key first, unless
    ``deal`` is false. ``closed`` leaves references without a semicolon as they are (``read_page``).
    """
    wanted = frozenset(kinds) if kinds else None
    nodes, prune = pruned(NODES, only)
    columns = (key, html, *keep)

    def rows(doc_id, text, *kept):
        read = read_page(doc_id, text, closed)
        if wanted is not None:
            read = [r for r in read if r[8] in wanted or (named and r[11])]
        return [[*prune(r), *kept] for r in read]

    chosen = dealt(pages.select(*columns), key, deal=deal)
    schema = StructType([*nodes.fields, *[chosen.schema[c] for c in keep]])
    return chosen.mapInArrow(arrow_rows(rows, schema, columns), schema)


def pages_to_segments(pages: DataFrame, key: str, html: str, deal=True, closed=False) -> DataFrame:
    """Visible text of every page, one row per block, without building the node table."""
    chosen = dealt(pages.select(key, html), key, deal=deal)
    read = lambda doc_id, text: read_segments(doc_id, text, closed)
    return chosen.mapInArrow(arrow_rows(read, SEGMENTS, (key, html)), SEGMENTS)
