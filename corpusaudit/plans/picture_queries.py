"""Queries over pictures that pages name: references, what became of retrieving them, and local files.

The pages are made from ``documents`` by Spark: each line with a run of small letters shows a picture
named by the first one, whose length decides whether the page can name it so; the first line's is the
cover. The log of attempts comes from another table: a word of ``conversations`` was tried in the turns
it was said in, and word and turn decide what came of it.
"""

from pyspark.sql import functions as F

from corpusaudit.operators import links as L
from corpusaudit.operators import package as K
from corpusaudit.operators import retrieval as R
from corpusaudit.operators import rewrite as W
from corpusaudit.plans.tables import query, table
from corpusaudit.session import materialise
from corpusaudit.sources.html import pages_to_nodes
from corpusaudit.sources.rows import dealt

SITE = "https://pics.example/"
TURNS = 4


def _locator(word):
    size = F.length(word)
    return (
        F.when(size % 9 == 0, F.concat(F.lit("ftp://pics.example/"), word))
        .when(size % 9 == 1, F.concat(F.lit("art/"), word))
        .otherwise(F.concat(F.lit(SITE), word))
    )


def _picture_pages(spark, folder):
    docs = dealt(table(spark, folder, "documents", "doc_id", "text"), "doc_id")
    word = lambda line: F.regexp_extract(line, "[a-z]+", 0)

    def shown(line):
        src = _locator(word(line))
        return F.when(word(line) == "", F.lit("<p>none</p>")).otherwise(
            F.concat(F.lit('<p><img alt="" sizes="9px" src="'), src, F.lit('" srcset="'), src, F.lit(" 1x,\n "), src, F.lit('w 2x, "></p>'))
        )

    lines = F.split("text", "\n")
    html = F.concat(F.lit("<html><body>"), F.array_join(F.transform(lines, shown), ""), F.lit("</body></html>"))
    first = word(F.element_at(lines, 1))
    return docs.select("doc_id", html.alias("html"), F.when(first != "", _locator(first)).alias("cover"))


def _images(spark, folder):
    """Image nodes in working form, and the cover of each document."""
    pages = _picture_pages(spark, folder)
    return W.working(pages_to_nodes(pages, "doc_id", "html", ("Image",), deal=False)), pages.select("doc_id", "cover")


def _log(spark, folder):
    said = table(spark, folder, "conversations", "turn", "text")
    words = said.select((F.col("turn") % TURNS + 1).cast("long").alias("at"), F.explode(F.regexp_extract_all("text", F.lit("([a-z]+)"), 1)).alias("w")).distinct()
    size = F.length("w")
    outcome = (
        F.when((size + F.col("at")) % 5 == 0, F.lit("http-error"))
        .when((size % 4 == 0) | ((size > 1) & (F.left("w", F.lit(1)) == F.right("w", F.lit(1)))), F.lit("redirected"))
        .otherwise(F.lit("retrieved"))
    )
    target = F.when(size % 4 == 0, F.substring("w", 2, 1 << 30)).otherwise(F.reverse("w"))
    log = words.withColumn("outcome", outcome).select(
        F.concat(F.lit(SITE), "w").alias("locator"),
        "at",
        "outcome",
        F.when(F.col("outcome") == "redirected", F.concat(F.lit(SITE), target)).alias("target"),
    )
    return materialise(log)


def _references(spark, folder):
    images, covers = _images(spark, folder)
    return L.remote_references(images, covers)


_SQL_PICTURES = f"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS ln, regexp_extract(unnest(ls), '[a-z]+') AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
p AS (SELECT *, CASE length(w) % 9 WHEN 0 THEN 'ftp://pics.example/' WHEN 1 THEN 'art/' ELSE '{SITE}' END || w AS src,
      row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS number FROM l WHERE w <> ''),
seen AS (SELECT doc_id, w, src AS locator, min(ln) AS first, count(*) AS occurrences FROM p WHERE src LIKE 'https:%' GROUP BY ALL),
refs AS (SELECT doc_id, 'image-' || row_number() OVER (PARTITION BY doc_id ORDER BY first) AS identifier,
                row_number() OVER (PARTITION BY doc_id ORDER BY first) AS ord, w, locator, occurrences FROM seen),
log AS (SELECT DISTINCT turn % {TURNS} + 1 AS stamp, unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM conversations),
told AS (SELECT w, stamp, CASE WHEN (length(w) + stamp) % 5 = 0 THEN 'http-error'
    WHEN length(w) % 4 = 0 OR (length(w) > 1 AND left(w, 1) = right(w, 1)) THEN 'redirected' ELSE 'retrieved' END AS outcome,
  CASE WHEN length(w) % 4 = 0 THEN substr(w, 2) ELSE reverse(w) END AS target FROM log),
state AS (SELECT t.stamp AS now, w, arg_max(outcome, told.stamp) AS outcome, arg_max(target, told.stamp) AS target
  FROM range(1, {TURNS + 1}) t(stamp) JOIN told ON told.stamp <= t.stamp GROUP BY ALL),
asked AS (SELECT DISTINCT doc_id % {TURNS} + 1 AS now, w FROM refs UNION SELECT DISTINCT {TURNS}, w FROM refs),
walk AS (SELECT now, w AS start, w AS cur, [w] AS path, 0 AS hops, false AS round FROM asked
  UNION ALL SELECT walk.now, start, target, list_append(path, target), hops + 1, list_contains(path, target)
  FROM walk JOIN state ON state.now = walk.now AND state.w = cur WHERE outcome = 'redirected' AND NOT round),
ended AS (SELECT now, start, arg_max(cur, hops) AS final, max(hops) AS hops, bool_or(round) AS round FROM walk GROUP BY ALL),
ends AS (SELECT e.now, start AS w, final, e.hops, CASE WHEN round THEN 'redirect-cycle' ELSE coalesce(outcome, 'not-attempted') END AS outcome
  FROM ended e LEFT JOIN state s ON s.now = e.now AND s.w = final)"""


@query(
    "remote_pictures",
    _SQL_PICTURES + " SELECT doc_id, identifier, locator, occurrences FROM refs",
)
def remote_pictures(spark, folder):
    """Every remote picture of a document once, numbered as first seen."""
    return _references(spark, folder)


@query(
    "unsupported_pictures",
    _SQL_PICTURES + " SELECT doc_id, arg_min(src, ln) AS locator FROM p WHERE src LIKE 'ftp:%' GROUP BY doc_id",
)
def unsupported_pictures(spark, folder):
    return L.first_unsupported(_images(spark, folder)[0])


@query(
    "retrieval_status",
    _SQL_PICTURES
    + f""" SELECT r.doc_id, bool_and(outcome = 'retrieved') AS retrieved, arg_min(outcome, ord) FILTER (outcome <> 'retrieved') AS boundary,
  count(*) FILTER (hops > 0 AND outcome <> 'redirect-cycle') AS redirected, count(*) FILTER (outcome = 'redirect-cycle') AS cyclic,
  count(*) FILTER (outcome = 'not-attempted') AS untried FROM refs r JOIN ends e ON e.now = doc_id % {TURNS} + 1 AND e.w = r.w GROUP BY ALL""",
)
def retrieval_status(spark, folder):
    """Whether all pictures of a document were retrieved by its time, what failed first, and where redirects led."""
    refs = materialise(
        _references(spark, folder).select(
            "doc_id", "locator", (F.col("doc_id") % TURNS + 1).alias("when"), F.coalesce(F.regexp_extract("identifier", r"\d+", 0).try_cast("int"), F.lit(0)).alias("ord")
        )
    )
    tried = materialise(R.outcomes(refs.select("locator", "when"), _log(spark, folder), slot=2))
    counts = refs.join(tried, ["when", "locator"]).groupBy("doc_id").agg(
        F.count_if((F.col("hops") > 0) & (F.col("outcome") != R.CYCLE)).alias("redirected"),
        F.count_if(F.col("outcome") == R.CYCLE).alias("cyclic"),
        F.count_if(F.col("outcome") == R.NOT_ATTEMPTED).alias("untried"),
    )
    return R.retrieval_status(refs, tried).join(counts, "doc_id")


@query(
    "localised_pictures",
    _SQL_PICTURES
    + f""" SELECT doc_id, number, CASE WHEN outcome = 'retrieved' THEN 'files/' || final ELSE src END AS src
FROM p LEFT JOIN ends e ON e.now = {TURNS} AND e.w = p.w AND src LIKE 'https:%'""",
)
def localised_pictures(spark, folder):
    """Every picture of every page behind localisation by what the log says in the end."""
    images, covers = _images(spark, folder)
    images = materialise(images)
    asked = L.remote_references(images, covers).select("locator", F.lit(TURNS).cast("long").alias("when")).distinct()
    tried = R.outcomes(asked, _log(spark, folder), slot=2).filter("outcome = 'retrieved'")
    paths = tried.select("locator", F.concat(F.lit("files/"), F.element_at(F.split("final", "/"), -1)).alias("path"))
    return W.number_images(W.localise(images, paths)).select("doc_id", F.col("number").cast("bigint").alias("number"), "src")


@query(
    "picture_candidates",
    _SQL_PICTURES + " SELECT doc_id, number, [src || ' 1x', src || 'w 2x'] AS candidates, false AS kept FROM p",
)
def picture_candidates(spark, folder):
    """The candidates that pictures named beside their source, taken off the nodes."""
    images = materialise(_images(spark, folder)[0])
    plain, found = W.split_srcset(images)
    kept = F.map_contains_key("attrs", "srcset") | F.map_contains_key("attrs", "sizes")
    numbers = W.number_images(plain).select("doc_id", "node", F.col("number").cast("bigint").alias("number"), kept.alias("kept"))
    return numbers.join(found, ["doc_id", "node"], "left").select("doc_id", "number", "candidates", "kept")


@query(
    "first_pictures",
    _SQL_PICTURES + " SELECT doc_id, sha256(src) AS sha256, min(number) AS number, arg_min(src, number) AS src FROM p GROUP BY doc_id, sha256(src)",
)
def first_pictures(spark, folder):
    """The first picture of every content in a document; a picture's source stands for its bytes here."""
    numbered = W.number_images(materialise(_images(spark, folder)[0])).withColumn("sha256", F.sha2("src", 256))
    pictures = numbered.select("doc_id", "sha256", "node", F.col("number").cast("bigint").alias("number"), "src")
    return K.first_resources(pictures).select("doc_id", "sha256", "number", "src")
