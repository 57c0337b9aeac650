"""Queries over document trees: structure, rewriting, projections and observations.

The trees are made from ``documents`` by Spark: the first line is a heading, every further line a
paragraph, and single words stand for what the text itself lacks. ``and`` becomes a note that
says the same; ``the``, ``la`` link to the heading; ``of`` links to the web and has a class; ``is``
links nowhere; ``les``, ``der`` are struck out; ``que``, ``los`` are raw markup.
"""

from pyspark.sql import functions as F

from corpusaudit.functions.text import codepoint
from corpusaudit.operators import links as LK
from corpusaudit.operators import observations as O
from corpusaudit.operators import preservation as P
from corpusaudit.operators import rewrite as W
from corpusaudit.operators import structure as S
from corpusaudit.operators import verdicts as V
from corpusaudit.operators.layers import layered
from corpusaudit.plans.tables import query, sql_words, table
from corpusaudit.rules import GLYPHS
from corpusaudit.session import materialise
from corpusaudit.sources.rows import dealt
from corpusaudit.sources.tree import MAX_DEPTH, MODELLED, WORDS, trees_to_digests, trees_to_nodes
from corpusaudit.sources.tree import tree_refusals as refused_trees

_STR = '{"t":"Str","c":"%s"}'
_EMPTY = '["",[],[]]'
_CLASSED = '["",["ext"],[["width","5"]]]'


def _link(word, attr, target):
    return '{"t":"Link","c":[%s,[%s],["%s",""]]}' % (attr, _STR % word, target)


def _words(line, anchor):
    """The inlines of one line as JSON text."""
    escaped = F.to_json(F.struct(line.alias("c")))
    escaped = F.substring(escaped, 7, 1 << 30)
    escaped = F.left(escaped, F.length(escaped) - 2)
    # What single words stand for; looked up word by word, as each pass over the finished JSON is one over seven times the text.
    stands = {w: F.lit('{"t":"Strikeout","c":[%s]}' % (_STR % w)) for w in ("les", "der")}
    for word in ("the", "la"):
        head, tail = _link(word, _EMPTY, "#@").split("@")
        stands[word] = F.concat(F.lit(head), anchor, F.lit(tail))
    stands["of"] = F.lit(_link("of", _CLASSED, "https://example.org/of"))
    stands["is"] = F.lit(_link("is", _EMPTY, "#nowhere"))
    stands["and"] = F.lit('{"t":"Note","c":[{"t":"Para","c":[%s]}]}' % (_STR % "and"))
    stands["que"] = F.lit('{"t":"RawInline","c":["html","<i>"]}')
    stands["los"] = F.lit('{"t":"RawInline","c":["html","</i>"]}')

    def inline(word):
        said = F.when((F.length(word) > 3) | ~word.isin(*stands), F.concat(F.lit('{"t":"Str","c":"'), word, F.lit('"}')))
        for name, node in stands.items():
            said = said.when(word == name, node)
        return said

    return F.array_join(F.transform(F.split(escaped, " "), inline), ',{"t":"Space"},')


def _trees(spark, folder):
    docs = dealt(table(spark, folder, "documents", "doc_id", "text", "lang"), "doc_id")
    lines = F.split("text", "\n")
    docs = docs.withColumn("lines", lines)
    first = F.element_at("lines", 1)
    anchor = F.regexp_replace(F.lower(first), r'[ "\\\t]+', "-")
    docs = docs.withColumn("anchor", anchor).withColumn(
        "level", F.when(F.col("lang") == "de", F.lit("2")).otherwise(F.lit("1"))
    )
    plain = F.to_json(F.struct(first.alias("c")))
    title = F.concat(F.lit('{"t":"Str",'), F.substring(plain, 2, 1 << 30))
    heading = F.concat(
        F.lit('{"t":"Header","c":['), "level", F.lit(',["'), "anchor", F.lit('",[],[]],['), title, F.lit("]]}")
    )
    rest = F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))
    paras = F.transform(
        rest, lambda line: F.concat(F.lit('{"t":"Para","c":['), _words(line, F.col("anchor")), F.lit("]}"))
    )
    blocks = F.array_join(F.concat(F.array(heading), paras), ",")
    meta = F.concat(
        F.lit('{"title":{"t":"MetaInlines","c":['), title,
        F.lit(']},"lang":{"t":"MetaString","c":"'), "lang", F.lit('"}}'),
    )
    tree = F.concat(F.lit('{"meta":'), meta, F.lit(',"blocks":['), blocks, F.lit("]}"))
    return docs.select("doc_id", tree.alias("tree"))


def _nodes(spark, folder, kinds=None, columns=None, **how):
    return trees_to_nodes(_trees(spark, folder), "doc_id", "tree", kinds, columns, deal=False, **how)


#: What visible text is made of, and what ``structure.measure`` looks at.
_SHOWN = ("doc_id", "node", "end_node", "pointer", "kind", "text_seg", "text")
_MEASURED = ("doc_id", "node", "kind", "measured", "ident", "classes", "attrs", "list_start", "list_style", "read_block", "label")


def _linked(spark, folder):
    """Only the nodes link rules look at, read once and kept."""
    return materialise(W.working(_nodes(spark, folder, ("Link", "Note", "Header"))))


_SQL_TOKENS = r"""
WITH l AS (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents),
head AS (SELECT doc_id, lang, ls[1] AS head, len(ls) AS n_lines,
                regexp_replace(lower(ls[1]), '[ "\\\t]+', '-', 'g') AS anchor FROM l),
line AS (SELECT doc_id, unnest(range(2, len(ls) + 1)) AS ln, unnest(ls[2:]) AS line FROM l),
word AS (SELECT doc_id, ln, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS w
         FROM (SELECT doc_id, ln, string_split(line, ' ') AS ws FROM line)),
n AS (SELECT head.doc_id, lang, anchor, n_lines, count(w) AS words, count(DISTINCT ln) AS lines,
  count(*) FILTER (w = 'and') AS notes, count(*) FILTER (w IN ('the', 'la')) AS xref,
  count(*) FILTER (w = 'of') AS web, count(*) FILTER (w = 'is') AS dead,
  count(*) FILTER (w IN ('les', 'der')) AS struck, count(*) FILTER (w = 'que') AS opens,
  count(*) FILTER (w = 'los') AS shuts
  FROM head LEFT JOIN word USING (doc_id) GROUP BY ALL)"""


@query(
    "tree_constructs",
    _SQL_TOKENS
    + """ SELECT doc_id, kind, c::BIGINT AS n FROM (SELECT doc_id,
  unnest(['Header', 'Para', 'Link', 'Note', 'Strikeout', 'RawInline', 'Str', 'Space']) AS kind,
  unnest([1, lines + notes, xref + web + dead, notes, struck, opens + shuts,
          2 + words - opens - shuts, words - lines]) AS c FROM n) WHERE c > 0""",
)
def tree_constructs(spark, folder):
    return S.construct_counts(_nodes(spark, folder, None, ("doc_id", "kind", "level", "list_start"), runs=True), runs=True)


@query(
    "tree_measures",
    _SQL_TOKENS
    + """ SELECT doc_id, (1 + lines + notes)::BIGINT AS blocks, notes, (xref + web + dead) AS links,
  1::BIGINT AS headings, (anchor <> '')::BIGINT AS identifiers, 0::BIGINT AS images FROM n""",
)
def tree_measures(spark, folder):
    return S.measure(_nodes(spark, folder, None, _MEASURED, without=WORDS), table(spark, folder, "documents", "doc_id")).select(
        "doc_id", "blocks", "notes", "links", "headings", "identifiers", "images"
    )


@query(
    "unsupported_constructs",
    _SQL_TOKENS
    + """ SELECT doc_id, kind, n, true AS recognised FROM (
  SELECT doc_id, 'Strikeout' AS kind, struck AS n FROM n
  UNION ALL SELECT doc_id, 'RawInline', opens + shuts FROM n) WHERE n > 0""",
)
def unsupported_constructs(spark, folder):
    return S.unsupported_constructs(S.construct_counts(_nodes(spark, folder, None, ("doc_id", "kind"), without=MODELLED)))


@query(
    "struck_locations",
    _SQL_TOKENS
    + """ SELECT doc_id, count(*) AS n, list('/blocks/' || (ln - 1) || '/c/' || (2 * (pos - 1)) ORDER BY ln, pos) AS locations
FROM word WHERE w IN ('les', 'der') GROUP BY doc_id""",
)
def struck_locations(spark, folder):
    struck = _nodes(spark, folder, ("Strikeout",), ("doc_id", "node", "pointer", "kind"))
    places = S.construct_locations(struck, ("Strikeout",))
    return places.select("doc_id", "n", "locations")


@query(
    "tree_metadata",
    _SQL_TOKENS
    + """ SELECT doc_id, 'title' AS name, trim(head) AS value FROM head WHERE trim(head) <> ''
          UNION ALL SELECT doc_id, 'lang', lang FROM head""",
)
def tree_metadata(spark, folder):
    return S.meta_text(_nodes(spark, folder, None, ("doc_id", "node", "depth", "root", "pointer", "kind", "text"), roots=("meta",)))


_SQL_TEXT = (
    _SQL_TOKENS
    + r""", shown AS (SELECT doc_id, ln, trim(string_agg(CASE w WHEN 'and' THEN ' and ' WHEN 'que' THEN '' WHEN 'los' THEN '' ELSE w END,
                       ' ' ORDER BY pos), E' \t\x0B\f\r') AS t FROM word GROUP BY doc_id, ln
         UNION ALL SELECT doc_id, 1, trim(head, E' \t\x0B\f\r') FROM head),
whole AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY ln) AS text FROM shown WHERE t <> '' GROUP BY doc_id)"""
)


@query("tree_text", _SQL_TEXT + " SELECT doc_id, sha256(text) AS digest, length(text)::BIGINT AS chars FROM whole")
def tree_text(spark, folder):
    text = S.render_text(S.visible_segments(materialise(_nodes(spark, folder, None, _SHOWN, runs=True))))
    return text.select(
        "doc_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("bigint").alias("chars")
    )


@query(
    "tree_digests",
    """SELECT doc_id, count(*) OVER (PARTITION BY text, lang) AS copies, min(doc_id) OVER (PARTITION BY text, lang) AS first FROM documents""",
)
def tree_digests(spark, folder):
    """How many documents have the same tree as each, and the first of them."""
    tops = trees_to_digests(_trees(spark, folder), "doc_id", "tree", top=True, deal=False)
    digests = materialise(S.tree_digest(None, tops))
    groups = digests.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    return digests.join(groups, "digest").select("doc_id", "copies", "first")


@query(
    "repeated_blocks",
    _SQL_TOKENS
    + """, p AS (SELECT doc_id, line.ln, line, CASE WHEN list_has_any(string_split(line, ' '), ['the', 'la']) THEN anchor END AS anchor FROM line JOIN head USING (doc_id)),
b AS (SELECT 'Para' AS kind, doc_id, 2 * ln AS at, struct_pack(l := line, a := anchor, note := false) AS what FROM p
  UNION ALL SELECT 'Para', doc_id, 2 * ln + 1, struct_pack(l := 'and', a := NULL, note := true) FROM word WHERE w = 'and'
  UNION ALL SELECT 'Header', doc_id, 0, struct_pack(l := head, a := anchor || '|' || (lang = 'de')::INT, note := false) FROM head)
SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS documents, min(doc_id) AS first FROM b GROUP BY kind, what""",
)
def repeated_blocks(spark, folder):
    """Every different heading and paragraph of the corpus, with all below it: how often, in how many documents, where first."""
    subtrees = trees_to_digests(_trees(spark, folder), "doc_id", "tree", ("Header", "Para"), deal=False)
    return S.repeated_subtrees(subtrees).select("kind", "n", "documents", F.col("doc_id").alias("first"))


@query(
    "link_stripping",
    _SQL_TOKENS
    + """ SELECT doc_id, kind, before, CASE WHEN kind = 'cross-reference' AND notes = 0 THEN 0 ELSE before END AS removed,
  CASE WHEN kind = 'cross-reference' AND notes = 0 THEN before ELSE 0 END AS after
FROM (SELECT doc_id, notes, unnest(['cross-reference', 'web-link', 'dead-link']) AS kind,
             unnest([CASE WHEN anchor <> '' THEN xref ELSE 0 END, web, CASE WHEN anchor <> '' THEN dead ELSE dead + xref END]) AS before FROM n)
WHERE before > 0""",
)
def link_stripping(spark, folder):
    return W.link_counts(W.classify_links(_linked(spark, folder)))


@query(
    "link_interlock",
    _SQL_TOKENS
    + """ SELECT doc_id, notes = 0 AND xref + dead > 0 AS engaged, (xref + dead)::BIGINT AS in_book_links FROM n""",
)
def link_interlock(spark, folder):
    docs = table(spark, folder, "documents", "doc_id")
    return W.interlock(docs, W.classify_links(_linked(spark, folder)))


@query(
    "note_numbers",
    _SQL_TOKENS
    + """ SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln, pos) AS number,
  '/blocks/' || (ln - 1) || '/c/' || (2 * (pos - 1)) AS pointer FROM word WHERE w = 'and'""",
)
def note_numbers(spark, folder):
    nodes = W.working(_nodes(spark, folder, ("Note",)))
    return W.number_notes(nodes).select("doc_id", "number", "pointer")


_SQL_REWRITTEN = (
    _SQL_TOKENS
    + r""", num AS (SELECT *, sum((w = 'and')::INT) OVER (PARTITION BY doc_id ORDER BY ln, pos) AS k FROM word),
shown AS (SELECT doc_id, 0 AS part, ln::DOUBLE AS ln, trim(string_agg(CASE w WHEN 'and' THEN ' ' || k || ' ' WHEN 'que' THEN ''
             WHEN 'los' THEN '' ELSE w END, ' ' ORDER BY pos), E' \t\x0B\f\r') AS t FROM num GROUP BY doc_id, ln
  UNION ALL SELECT doc_id, 0, 1, trim(head, E' \t\x0B\f\r') FROM head
  UNION ALL SELECT doc_id, 0, 0, 'Document ' || doc_id FROM head WHERE lang = 'de'
  UNION ALL SELECT doc_id, 1, -1, 'Footnotes' FROM num WHERE w = 'and' AND k = 1
  UNION ALL SELECT doc_id, k, 0, 'Footnote ' || k || '. and' FROM num WHERE w = 'and'),
whole AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY part, ln) AS text FROM shown WHERE t <> '' GROUP BY doc_id)"""
)


def _titles(spark, folder):
    return table(spark, folder, "documents", "doc_id").withColumn(
        "title", F.concat(F.lit("Document "), "doc_id")
    )


def _rewritten(spark, folder, *columns):
    return W.rewrite(_nodes(spark, folder, runs=True), _titles(spark, folder), columns=columns)


#: What the text of rewritten nodes is made of.
_SAYING = ("doc_id", "node", "kind", "text_seg", "text")


@query(
    "rewritten_text",
    _SQL_REWRITTEN + " SELECT doc_id, sha256(text) AS digest, length(text)::BIGINT AS chars FROM whole",
)
def rewritten_text(spark, folder):
    nodes, _ = _rewritten(spark, folder, *_SAYING)
    text = S.render_text(S.segments(nodes), "text_seg")
    return text.select(
        "doc_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("bigint").alias("chars")
    )


@query(
    "rewritten_loss",
    _SQL_TEXT
    + f""" SELECT doc_id, len({sql_words('text')})::BIGINT AS baseline, 0::BIGINT AS missing FROM whole""",
)
def rewritten_loss(spark, folder):
    """Rewriting moves words and adds labels; it must lose none."""
    nodes = materialise(_nodes(spark, folder, runs=True))
    rewritten, _ = W.rewrite(nodes, _titles(spark, folder), columns=_SAYING, written=True)
    before = S.render_text(S.visible_segments(nodes)).withColumnRenamed("text", "baseline")
    after = S.render_text(S.segments(rewritten), "text_seg").withColumnRenamed("text", "derived")
    pairs = before.join(after, "doc_id", "left").fillna("", ["derived"])
    totals = P.loss_totals(pairs, "doc_id", "baseline", "derived", normalise=False)
    return totals.select("doc_id", "baseline", "missing")


# With one kind of tag, what stays is what a stack pairs: an end tag finds a partner where the
# running balance, floored at zero, is above zero.
_SQL_DROPPED = (
    _SQL_TOKENS
    + """, t AS (SELECT doc_id, ln, pos, CASE w WHEN 'que' THEN 1 ELSE -1 END AS d FROM word WHERE w IN ('que', 'los')),
s AS (SELECT *, sum(d) OVER (PARTITION BY doc_id ORDER BY ln, pos) AS run FROM t),
f AS (SELECT *, run - least(0, min(run) OVER (PARTITION BY doc_id ORDER BY ln, pos)) AS level FROM s),
e AS (SELECT doc_id, arg_max(level, (ln, pos)) AS left_open, -least(0, min(run)) AS no_start FROM f GROUP BY doc_id),
gone AS (SELECT doc_id, (left_open + no_start)::BIGINT AS dropped FROM e WHERE left_open + no_start > 0)"""
)


@query(
    "rewritten_constructs",
    _SQL_DROPPED
    + """ SELECT doc_id, kind, c::BIGINT AS n FROM (SELECT doc_id, unnest(['Header', 'Para', 'Link', 'Span', 'Strikeout', 'RawInline', 'Str', 'Space']) AS kind,
  unnest([1 + (lang = 'de')::INT + notes, lines + notes,
          notes + CASE WHEN notes = 0 AND anchor <> '' THEN xref ELSE 0 END, web, struck, opens + shuts - coalesce(dropped, 0),
          2 + words - opens - shuts + 3 * notes + (notes > 0)::INT + (lang = 'de')::INT, words - lines + 2 * notes]) AS c
  FROM n LEFT JOIN gone USING (doc_id)) WHERE c > 0""",
)
def rewritten_constructs(spark, folder):
    """Nodes of every kind behind the whole chain."""
    nodes, _ = _rewritten(spark, folder, "doc_id", "kind", "level", "list_start")
    return S.construct_counts(nodes, runs=True)


@query(
    "transform_log",
    _SQL_DROPPED
    + """, c AS (SELECT doc_id, unnest(['duplicate-caption-suppression', 'callout-title-emphasis', 'link-stripping',
    'note-conversion', 'raw-html-balance', 'identifier-bounding', 'attribute-namespacing']) AS name,
  unnest([0, 0, web + dead + CASE WHEN notes > 0 OR anchor = '' THEN xref ELSE 0 END, notes, coalesce(dropped, 0),
    (lang = 'de')::INT + (strlen(anchor) > 77)::INT, web])::BIGINT AS changes FROM n LEFT JOIN gone USING (doc_id))
SELECT doc_id, name, changes, changes > 0 AS fired,
  CASE name WHEN 'link-stripping' THEN 'strip_non_apparatus_hrefs' WHEN 'note-conversion' THEN 'one_file_per_note' END AS activation
FROM c""",
)
def transform_log(spark, folder):
    """Every rewrite of every document, the ones that did nothing too; no rewritten nodes are built for it."""
    changes = W.changes(materialise(_nodes(spark, folder, runs=True, telling=("Figure", "Div"))), _titles(spark, folder))
    log = W.transform_log(table(spark, folder, "documents", "doc_id"), changes)
    return log.select("doc_id", "name", "changes", "fired", "activation")


@query("raw_markup_balance", _SQL_DROPPED + " SELECT * FROM gone")
def raw_markup_balance(spark, folder):
    """Raw markup dropped per document, counted."""
    _, gone = W.balance_raw_html(W.working(_nodes(spark, folder, ("RawInline", "RawBlock"))))
    return gone.groupBy("doc_id").agg(F.count("*").alias("dropped"))


@query(
    "bounded_links",
    _SQL_TOKENS
    + """ SELECT doc_id, CASE WHEN strlen(anchor) <= 77 THEN anchor ELSE
  left(anchor, list_max(list_filter(range(0, 69), lambda k: strlen(left(anchor, k)) <= 68))) || '-' || left(sha256(anchor), 8) END AS ident,
  xref AS links FROM n WHERE anchor <> ''""",
)
def bounded_links(spark, folder):
    nodes = materialise(W.working(_nodes(spark, folder, ("Header", "Link"))))
    bounded, _ = W.bound_identifiers(nodes, 96)
    heads = bounded.filter(F.col("ident").isNotNull()).select("doc_id", "ident")
    links = (
        bounded.filter(F.col("kind") == "Link")
        .select("doc_id", F.substring("href", 2, 1 << 30).alias("ident"))
        .groupBy("doc_id", "ident")
        .agg(F.count("*").alias("links"))
    )
    return heads.join(links, ["doc_id", "ident"], "left").select(
        "doc_id", "ident", F.coalesce("links", F.lit(0).cast("bigint")).alias("links")
    )


@query(
    "renamed_attributes",
    _SQL_TOKENS
    + """ SELECT doc_id, 'Span' AS kind, 'span' AS element, 'width' AS attribute, web AS n FROM n WHERE web > 0""",
)
def renamed_attributes(spark, folder):
    w, _ = W.strip_links(_linked(spark, folder))
    _, renamed = W.namespace_attrs(w)
    return renamed.groupBy("doc_id", "kind", "element", "attribute").agg(F.count("*").alias("n"))


def _source_facts(spark, folder):
    """One row of facts per tree: structure, links, constructs and glyphs."""
    nodes = materialise(_nodes(spark, folder, runs=True))
    links = W.classify_links(W.working(nodes.filter(F.col("kind").isin("Link", "Note", "Header"))))
    blocks = nodes.filter(F.col("kind") == "Link").select(
        "doc_id", F.col("node").cast("double").alias("node"), "read_block"
    )
    recorded = F.col("recorded")
    per_block = (
        links.join(blocks, ["doc_id", "node"])
        .groupBy("doc_id", "read_block")
        .agg(
            F.count_if(recorded).alias("r"),
            F.count_if(recorded & (F.col("kind") == "dead-link")).alias("u"),
            F.max(F.when(recorded, F.octet_length("target"))).alias("b"),
        )
        .groupBy("doc_id")
        .agg(
            F.sum("r").alias("recorded"),
            F.max("r").alias("max_per_block"),
            F.max("b").cast("bigint").alias("max_href_bytes"),
            F.sum("u").alias("unresolved_recorded"),
        )
    )
    kinds = nodes.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "Strikeout").alias("strikeouts"),
        F.count_if(F.col("kind") == "Table").alias("tables"),
        F.count_if(F.col("kind") == "CodeBlock").alias("code_blocks"),
        S.visible_glyphs(GLYPHS).alias("glyphs"),
    )
    facts = S.measure(nodes).join(kinds, "doc_id").join(per_block, "doc_id", "left")
    return materialise(LK.over_all(facts, table(spark, folder, "documents", "doc_id"), "doc_id"))


_SQL_PROJECTED = (
    _SQL_TOKENS
    + """, blk AS (SELECT doc_id, ln, count(*) FILTER (w IN ('the', 'la', 'is')) AS r FROM word GROUP BY doc_id, ln),
top AS (SELECT doc_id, max(r) AS top FROM blk GROUP BY doc_id)"""
)


@query(
    "projected_verdicts",
    _SQL_PROJECTED
    + """ SELECT doc_id, requirement_id, CASE requirement_id
  WHEN 'footnotes-per-screen' THEN 'unevaluable'
  WHEN 'recorded-links-per-block' THEN CASE WHEN xref + dead = 0 THEN 'not_applicable'
     WHEN notes = 0 AND dead = 0 AND anchor <> '' AND top > 128 THEN 'false' ELSE 'unknown' END
  WHEN 'footnote-href-length' THEN CASE WHEN xref + dead = 0 THEN 'not_applicable' ELSE 'unknown' END
  WHEN 'anchors-per-chapter' THEN CASE WHEN anchor = '' THEN 'not_applicable' ELSE 'unknown' END
  ELSE 'unknown' END AS verdict
FROM n LEFT JOIN top USING (doc_id), (VALUES ('anchors-per-chapter'), ('footnotes-per-screen'), ('footnote-href-length'),
  ('recorded-links-per-block'), ('image-media-type'), ('png-decoding'), ('jpeg-decoding')) r(requirement_id)""",
)
def projected_verdicts(spark, folder):
    verdicts = V.evaluate(V.project(_source_facts(spark, folder)))
    return verdicts.select("doc_id", "requirement_id", "verdict")


@query(
    "source_observations",
    _SQL_PROJECTED
    + """ SELECT doc_id, name, applicability, fired, value FROM (SELECT doc_id,
  unnest(['ordered-list-numbering-loss', 'page-break-content-destruction', 'unrenderable-images', 'alt-text-fallback-absence',
   'colour-meaning-collapse', 'strikethrough-inversion', 'table-relationship-loss', 'code-block-reflow', 'boundary-chrome-presence',
   'unrenderable-glyphs', 'diagram-text-legibility', 'footnote-target-reliability', 'link-footnote-dilution']) AS name,
  unnest([false, true, false, false, false, true, true, true, true, true, false, notes > 0, xref + dead > 0]) AS applicability,
  unnest([false, false, NULL, NULL, NULL, struck > 0, false, false, NULL, glyphs > 0, NULL, NULL, NULL]) AS fired,
  unnest([0, 0, NULL, 0, NULL, struck, 0, 0, NULL, glyphs, NULL, NULL, coalesce(top, 0)])::BIGINT AS value
FROM n LEFT JOIN top USING (doc_id) JOIN (SELECT doc_id, """
    + " + ".join(f"len(regexp_extract_all(text, '{codepoint(g)}'))" for g in GLYPHS)
    + """ AS glyphs FROM documents) g USING (doc_id))""",
)
def source_observations(spark, folder):
    seen = O.source_observations(_source_facts(spark, folder))
    return seen.select("doc_id", "name", "applicability", "fired", F.col("measurement.value").alias("value"))


@query(
    "judgement_worklist",
    _SQL_PROJECTED
    + """ SELECT doc_id, item, 'agent' AS owner FROM (
  SELECT doc_id, 'boundary-chrome-presence' AS item FROM n
  UNION ALL SELECT doc_id, 'link-footnote-dilution' FROM n WHERE xref + dead > 0
  UNION ALL SELECT doc_id, 'link-interlock' FROM n WHERE notes = 0 AND xref + dead > 0)""",
)
def judgement_worklist(spark, folder):
    facts = _source_facts(spark, folder)
    merged = O.merge_observations(facts.select("doc_id"), [O.source_observations(facts)])
    return O.worklist(merged, link_interlock(spark, folder)).select("doc_id", "item", "owner")


@query(
    "merged_judgements",
    _SQL_PROJECTED
    + """, o AS (SELECT doc_id, name, applicability, fired, 0 AS layer FROM (SELECT doc_id,
  unnest(['strikethrough-inversion', 'table-relationship-loss', 'link-footnote-dilution', 'footnote-target-reliability']) AS name,
  unnest([true, true, xref + dead > 0, notes > 0]) AS applicability, unnest([struck > 0, false, NULL, NULL]) AS fired FROM n)
UNION ALL SELECT doc_id, name, NULL, NULL, -1 FROM n, (VALUES ('theme-adaptation'), ('colour-image-presentation')) v(name)
UNION ALL SELECT doc_id, 'theme-adaptation', true, CASE WHEN lang <> 'fr' THEN toxic = 1 END, 1 FROM labels JOIN documents USING (doc_id)
UNION ALL SELECT doc_id, 'strikethrough-inversion', true, quality = 0, 1 FROM labels
UNION ALL SELECT doc_id, name, true, false, 2 FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations) JOIN documents USING (doc_id),
  (VALUES ('strikethrough-inversion'), ('link-footnote-dilution')) v(name))
SELECT doc_id, name, arg_max(struct_pack(a := applicability), layer).a AS applicability, arg_max(struct_pack(f := fired), layer).f AS fired FROM o GROUP BY ALL""",
)
def merged_judgements(spark, folder):
    """What was measured, what a device showed and what a person said; the last layer that reached an observation wins.

    Labels stand for the device's judgements, undecided for French documents, and a conversation about a
    document for the person's. Device-judged observations nobody reached are rows without a decision.
    """
    names = (
        "strikethrough-inversion", "table-relationship-loss", "link-footnote-dilution", "footnote-target-reliability",
        "theme-adaptation", "colour-image-presentation",
    )
    measured = O.source_observations(_source_facts(spark, folder), names)
    docs = table(spark, folder, "documents", "doc_id", "lang")
    labels = table(spark, folder, "labels").join(docs, "doc_id")
    said = lambda name, fired: F.struct(F.lit(name).alias("name"), fired.alias("fired"))
    shown = F.when(F.col("lang") != "fr", F.col("toxic") == 1)
    device = labels.select(
        "doc_id", F.inline(F.array(said("theme-adaptation", shown), said("strikethrough-inversion", F.col("quality") == 0)))
    )
    talked = table(spark, folder, "conversations", F.col("conv_id").alias("doc_id")).distinct().join(docs, "doc_id", "left_semi")
    no = F.lit(False)
    person = talked.select("doc_id", F.inline(F.array(said("strikethrough-inversion", no), said("link-footnote-dilution", no))))
    merged = O.merge_observations(docs.select("doc_id"), [measured, O.judged(device), O.judged(person)], names)
    return merged.select("doc_id", "name", "applicability", "fired")


@query(
    "layered_facts",
    """WITH r AS (
  SELECT doc_id, 'measured' AS layer, 0 AS place, 1::BIGINT AS version, false AS gone, length(text) % 2 = 0 AS sound, length(text)::BIGINT AS size FROM documents
  UNION ALL SELECT l.doc_id, 'device', 1, 2 + quality, quality = 0 AND toxic = 1, CASE WHEN lang <> 'fr' THEN toxic = 0 END, NULL FROM labels l JOIN documents USING (doc_id)
  UNION ALL SELECT conv_id, 'person', 2, count(*), false, NULL, sum(length(text))::BIGINT FROM conversations GROUP BY conv_id),
s AS (SELECT doc_id, list_sort(list({'v': version, 'p': place, 'x': CASE WHEN NOT gone THEN sound END, 'l': layer}) FILTER (gone OR sound IS NOT NULL))[-1] AS a,
             list_sort(list({'v': version, 'p': place, 'x': CASE WHEN NOT gone THEN size END, 'l': layer}) FILTER (gone OR size IS NOT NULL))[-1] AS b,
             list_sort(list({'p': place, 'l': layer}) FILTER (NOT gone AND sound IS NOT NULL)) AS sa, list_sort(list({'p': place, 'l': layer}) FILTER (NOT gone AND size IS NOT NULL)) AS sb
      FROM r GROUP BY doc_id)
SELECT doc_id, a.x AS sound, a.l AS sound_from, list_filter(list_transform(coalesce(sa, []), lambda e: e.l), lambda e: e <> coalesce(a.l, '')) AS sound_over,
       b.x AS size, b.l AS size_from, list_filter(list_transform(coalesce(sb, []), lambda e: e.l), lambda e: e <> coalesce(b.l, '')) AS size_over FROM s""",
)
def layered_facts(spark, folder):
    """Two facts of each document from three layers: what was measured, a device's word, and what people wrote."""
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    size = F.length("text").cast("bigint")
    no = F.lit(False)
    measured = docs.select("doc_id", F.lit(1).alias("version"), no.alias("gone"), (size % 2 == 0).alias("sound"), size.alias("size"))
    device = table(spark, folder, "labels").join(docs.select("doc_id", "lang"), "doc_id").select(
        "doc_id",
        (F.col("quality") + 2).alias("version"),
        ((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("gone"),
        F.when(F.col("lang") != "fr", F.col("toxic") == 0).alias("sound"),
    )
    person = table(spark, folder, "conversations", F.col("conv_id").alias("doc_id"), "text").groupBy("doc_id").agg(
        F.count("*").alias("version"), F.sum(F.length("text")).alias("size")
    ).withColumn("gone", no)
    return layered({"measured": measured, "device": device, "person": person}, ["doc_id"], ["sound", "size"])


@query(
    "tree_refusals",
    _SQL_TOKENS
    + """ SELECT doc_id, CASE length(text) % 8 WHEN 0 THEN 'not-json' WHEN 1 THEN 'not-an-object' WHEN 2 THEN 'not-json' WHEN 3 THEN 'too-deep' END AS reason,
  CASE WHEN length(text) % 8 > 3 THEN 1 + lines + notes ELSE 0 END::BIGINT AS blocks FROM n JOIN documents USING (doc_id)""",
)
def tree_refusals(spark, folder):
    """Trees of which half are cut, no object, missing or too deep: each document has its row."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    kind = F.pmod(F.char_length("text"), F.lit(8))
    deep = lambda n: '{"blocks":' + '[{"t":"BlockQuote","c":' * n + "[]" + "}]" * n + "}"
    broken = (
        F.when(kind == 0, F.concat(F.lit('{"meta":'), F.col("doc_id")))
        .when(kind == 1, F.lit("[]"))
        .when(kind == 3, F.lit(deep(MAX_DEPTH + 5)))
        .when(kind > 3, F.col("tree"))
    )
    trees = _trees(spark, folder).join(docs, "doc_id").select("doc_id", broken.alias("tree"))
    blocks = S.measure(trees_to_nodes(trees, "doc_id", "tree", None, _MEASURED, without=WORDS), docs).select("doc_id", "blocks")
    return blocks.join(refused_trees(trees, "doc_id", "tree"), "doc_id", "left").select("doc_id", "reason", "blocks")
