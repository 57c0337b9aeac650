"""Queries over trees with figures, callouts, lists of their own numbering, page breaks and tables.

The trees are made from ``documents`` by Spark. Each line of a text is a block, whose shape is the length
of the line modulo eight: a figure whose caption the next paragraph repeats (0) or not (1), a callout
title (2), one with a second line (3), an ordered list (4), a page break (5), a table (6), a paragraph (7), which
stands in a block of a kind nobody knows if an eighth of the length is odd.
"""

from pyspark.sql import functions as F

from corpusaudit.operators import rewrite as W
from corpusaudit.operators import structure as S
from corpusaudit.plans.tables import SQL_WS, query, table
from corpusaudit.session import materialise
from corpusaudit.sources.rows import dealt
from corpusaudit.sources.tree import trees_to_nodes

_NONE = '["",[],[]]'
_TABLE = '{"t":"Table","c":[%s,[null,[]],[],[%s,[]],[],[%s,[]]]}' % (_NONE, _NONE, _NONE)


def _blocks(line):
    """The JSON of the block, or blocks, of one line."""
    quoted = F.substring(F.to_json(F.struct(line.alias("c"))), 6, 1 << 30)
    said = F.concat(F.lit('{"t":"Str","c":'), F.left(quoted, F.length(quoted) - 1), F.lit("}"))
    more = F.to_json(F.struct(F.lit("Str").alias("t"), F.concat(line, F.lit(" more")).alias("c")))
    size = F.length(line)
    block = lambda kind, inlines: F.concat(F.lit('{"t":"%s","c":[' % kind), inlines, F.lit("]}"))
    div = lambda name, *inner: F.concat(F.lit('{"t":"Div","c":[["",["%s"],[]],[' % name), *inner, F.lit("]]}"))
    picture = F.concat(F.lit('{"t":"Image","c":[%s,[' % _NONE), said, F.lit('],["p.png",""]]}'))
    figure = F.concat(
        F.lit('{"t":"Figure","c":[%s,[null,[' % _NONE), block("Para", said), F.lit("]],["), block("Plain", picture), F.lit("]]},")
    )
    style = F.when(size % 2 == 0, F.lit("Decimal")).otherwise(F.lit("LowerRoman"))
    numbered = F.concat(
        F.lit('{"t":"OrderedList","c":[['), 1 + size % 3, F.lit(',{"t":"'), style, F.lit('"},{"t":"Period"}],[['), block("Plain", said), F.lit("]]]}")
    )
    shapes = {
        0: F.concat(figure, block("Para", said)),
        1: F.concat(figure, block("Para", more)),
        2: div("callout-title", div("callout-title-inner", block("Plain", said))),
        3: div("callout-title", div("callout-title-inner", block("Plain", said), F.lit(","), block("Plain", said))),
        4: numbered,
        5: div("PageBreak", block("Para", said)),
        6: F.lit(_TABLE),
    }
    out = F.when(F.floor(size / 8) % 2 == 1, block("Aside", block("Para", said))).otherwise(block("Para", said))
    for shape, json in shapes.items():
        out = F.when(size % 8 == shape, json).otherwise(out)
    return out


def _nodes(spark, folder):
    docs = dealt(table(spark, folder, "documents", "doc_id", "text", "lang"), "doc_id")
    lines = F.split("text", "\n")
    first = F.to_json(F.struct(F.lit("MetaString").alias("t"), F.element_at(lines, 1).alias("c")))
    heading = F.to_json(F.struct(F.lit("Str").alias("t"), F.element_at(lines, 1).alias("c")))
    tongue = F.concat(F.lit('{"t":"Str","c":"'), "lang", F.lit('"}'))
    para = lambda x: F.concat(F.lit('{"t":"Para","c":['), x, F.lit("]}"))
    meta = F.concat(
        F.lit('{"tags":{"t":"MetaList","c":['), first, F.lit(',{"t":"MetaInlines","c":['), tongue, F.lit(']}]},"abstract":{"t":"MetaBlocks","c":['),
        para(heading), F.lit(","), para(tongue), F.lit("]}}"),
    )
    blocks = F.array_join(F.transform(lines, _blocks), ",")
    tree = F.concat(F.lit('{"meta":'), meta, F.lit(',"blocks":['), blocks, F.lit("]}"))
    return trees_to_nodes(docs.select("doc_id", tree.alias("tree")), "doc_id", "tree", deal=False)


_SQL_LINES = f"""
WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS t FROM documents),
s AS (SELECT *, length(t) % 8 AS shape, regexp_replace(t, '{SQL_WS}', '', 'g') AS bare FROM l)"""


@query(
    "suppressed_captions",
    _SQL_LINES + " SELECT doc_id, bare AS text, count(*) AS n FROM s WHERE shape = 0 AND bare <> '' GROUP BY ALL",
)
def suppressed_captions(spark, folder):
    """Captions that only say again what the picture and the next paragraph say."""
    _, gone = W.suppress_captions(W.working(_nodes(spark, folder)))
    return gone.groupBy("doc_id", "text").agg(F.count("*").alias("n"))


@query("callout_titles", _SQL_LINES + " SELECT doc_id, t AS text, count(*) AS n FROM s WHERE shape = 2 GROUP BY ALL")
def callout_titles(spark, folder):
    """Callout titles that became strong lines, exact nestings only."""
    _, made = W.emphasise_callouts(W.working(_nodes(spark, folder)))
    return made.groupBy("doc_id", "text").agg(F.count("*").alias("n"))


@query(
    "figures_rewritten",
    _SQL_LINES
    + """, k AS (SELECT doc_id, unnest(['Figure', 'Image', 'Para', 'Plain', 'Div', 'Strong', 'OrderedList', 'Table', 'Aside', 'Str']) AS kind,
  unnest([(shape < 2)::INT, (shape < 2)::INT, CASE shape WHEN 0 THEN 2 - (bare <> '')::INT WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 5 THEN 1 WHEN 7 THEN 1 ELSE 0 END,
    CASE WHEN shape IN (0, 1, 4) THEN 1 WHEN shape = 3 THEN 2 ELSE 0 END, CASE shape WHEN 3 THEN 2 WHEN 5 THEN 1 ELSE 0 END, (shape = 2)::INT,
    (shape = 4)::INT, (shape = 6)::INT, (shape = 7 AND length(t) // 8 % 2 = 1)::INT, CASE shape WHEN 0 THEN 3 - (bare <> '')::INT WHEN 1 THEN 3 WHEN 3 THEN 2 WHEN 6 THEN 0 ELSE 1 END]) AS c FROM s
  UNION ALL SELECT doc_id, unnest(['Para', 'Str']), unnest([2, 3]) FROM documents)
SELECT doc_id, kind, sum(c)::BIGINT AS n FROM k GROUP BY ALL HAVING sum(c) > 0""",
)
def figures_rewritten(spark, folder):
    """Nodes of every kind behind the rewrites of captions and callouts."""
    kept, _ = W.suppress_captions(materialise(W.working(_nodes(spark, folder))))
    kept, _ = W.emphasise_callouts(materialise(kept))
    return S.construct_counts(kept)


@query(
    "figure_measures",
    _SQL_LINES
    + """ SELECT doc_id, count(*) FILTER (shape < 2) AS images, count(*) FILTER (shape < 2 AND bare = '') AS images_without_alt,
  count(*) FILTER (shape = 4) AS ordered_lists, count(*) FILTER (shape = 4 AND (length(t) % 3 <> 0 OR length(t) % 2 = 1)) AS renumbered_lists,
  count(*) FILTER (shape = 5) AS page_breaks FROM s GROUP BY doc_id""",
)
def figure_measures(spark, folder):
    measured = S.measure(_nodes(spark, folder), table(spark, folder, "documents", "doc_id"))
    return measured.select("doc_id", "images", "images_without_alt", "ordered_lists", "renumbered_lists", "page_breaks")


@query(
    "figure_metadata",
    """WITH d AS (SELECT doc_id, lang, trim(string_split(text, chr(10))[1], E' \\t\\x0B\\f\\r') AS head FROM documents)
SELECT doc_id, 'tags' AS name, CASE WHEN head <> '' THEN head || ', ' ELSE '' END || lang AS value FROM d
UNION ALL SELECT doc_id, 'abstract', CASE WHEN head <> '' THEN head || ' ' ELSE '' END || lang FROM d""",
)
def figure_metadata(spark, folder):
    """Metadata of lists and of blocks as the text a reader would see."""
    return S.meta_text(_nodes(spark, folder))


@query(
    "unknown_constructs",
    _SQL_LINES
    + """, k AS (SELECT doc_id, unnest(['Table', 'Aside']) AS kind, unnest([true, false]) AS recognised, unnest([(shape = 6)::INT, (shape = 7 AND length(t) // 8 % 2 = 1)::INT]) AS c FROM s)
SELECT doc_id, kind, sum(c)::BIGINT AS n, recognised FROM k GROUP BY ALL HAVING sum(c) > 0""",
)
def unknown_constructs(spark, folder):
    """Constructs that a target cannot show, those of the vocabulary and those nobody knows."""
    return S.unsupported_constructs(S.construct_counts(_nodes(spark, folder)))
