"""Text queries over documents, benchmark and conversations."""

from pyspark.sql import functions as F

from corpusaudit.functions import text as X
from corpusaudit.operators import preservation as P
from corpusaudit.plans.tables import SQL_WS, query, sql_words, table
from corpusaudit.sources import documents as D

# Declared losses of the text_loss queries; two of them are unusable on purpose.
DECLARED = [("the", 2), ("of", 1), ("and", 50), ("two words", 1), ("un", -1)]
_DECLARED_SQL = "(VALUES ('the', 2), ('of', 1), ('and', 50)) t(token, allowed)"


def _docs(spark, folder, *columns):
    return table(spark, folder, "documents", *columns)


def _pairs(spark, folder):
    """Every document beside a derived text that lost its last line."""
    derived = F.regexp_replace("text", r"\n[^\n]*\z", "")
    return _docs(spark, folder, "doc_id", "text").select(
        "doc_id", F.col("text").alias("baseline"), derived.alias("derived")
    )


def _declared(spark):
    rows = spark.createDataFrame(DECLARED, "token string, allowed bigint")
    return P.validate_declared(rows).filter(F.col("reason").isNull()).drop("reason")


_SQL_PAIRS = r"""
pairs AS (SELECT doc_id, nfc_normalize(text) AS baseline,
                 nfc_normalize(regexp_replace(text, '\n[^\n]*\z', '')) AS derived
          FROM documents)"""


def _sql_counts(name: str, source: str, items: str, key: str = "doc_id") -> str:
    return f"""
{name} AS (SELECT {key}, item, count(*) AS n
           FROM (SELECT {key}, unnest({items}) AS item FROM {source}) GROUP BY {key}, item)"""


_SQL_LOSS = (
    f"WITH {_SQL_PAIRS}, {_sql_counts('b', 'pairs', sql_words('baseline'))},"
    f"{_sql_counts('d', 'pairs', sql_words('derived'))},"
    f"""
net AS (SELECT coalesce(b.doc_id, d.doc_id) AS doc_id, coalesce(b.item, d.item) AS token,
               greatest(coalesce(b.n, 0) - coalesce(d.n, 0), 0) AS missing,
               greatest(coalesce(d.n, 0) - coalesce(b.n, 0), 0) AS added
        FROM b FULL JOIN d ON b.doc_id = d.doc_id AND b.item = d.item),
allowed AS (SELECT net.*, least(missing, coalesce(allowed, 0)) AS expected
            FROM net LEFT JOIN {_DECLARED_SQL} USING (token))"""
)


@query(
    "word_counts",
    f"SELECT doc_id, len({sql_words('nfc_normalize(text)')})::BIGINT AS words FROM documents",
)
def word_counts(spark, folder):
    return _docs(spark, folder, "doc_id", "text").select(
        "doc_id", X.word_count(X.nfc(F.col("text"))).alias("words")
    )


@query(
    "token_multiset",
    f"""SELECT doc_id, token, count(*) AS n FROM
        (SELECT doc_id, unnest({sql_words('text')}) AS token FROM documents) GROUP BY ALL""",
)
def token_multiset(spark, folder):
    return P.token_counts(_docs(spark, folder, "doc_id", "text"), "doc_id", "text")


@query(
    "text_loss",
    _SQL_LOSS
    + """ SELECT doc_id, token, missing::BIGINT AS missing, expected::BIGINT AS expected,
                 (missing - expected)::BIGINT AS unexpected FROM allowed WHERE missing > 0""",
)
def text_loss(spark, folder):
    return P.token_losses(
        _pairs(spark, folder), "doc_id", "baseline", "derived", _declared(spark)
    )


@query(
    "text_loss_totals",
    _SQL_LOSS
    + f"""
, totals AS (SELECT doc_id, sum(missing) AS missing, sum(added) AS added, sum(expected) AS expected
             FROM allowed GROUP BY doc_id)
SELECT doc_id, len({sql_words('baseline')})::BIGINT AS baseline,
       len({sql_words('derived')})::BIGINT AS artifact,
       coalesce(added, 0)::BIGINT AS added, coalesce(missing, 0)::BIGINT AS missing,
       coalesce(expected, 0)::BIGINT AS expected,
       coalesce(missing - expected, 0)::BIGINT AS unexpected, baseline = derived AS identical
FROM pairs LEFT JOIN totals USING (doc_id)""",
)
def text_loss_totals(spark, folder):
    return P.loss_totals(_pairs(spark, folder), "doc_id", "baseline", "derived", _declared(spark))


@query(
    "char_loss",
    f"""WITH {_SQL_PAIRS},
{_sql_counts('b', 'pairs', "string_split(baseline, '')")},
{_sql_counts('d', 'pairs', "string_split(derived, '')")},
net AS (SELECT coalesce(b.doc_id, d.doc_id) AS doc_id,
               greatest(coalesce(b.n, 0) - coalesce(d.n, 0), 0) AS missing,
               greatest(coalesce(d.n, 0) - coalesce(b.n, 0), 0) AS added
        FROM b FULL JOIN d ON b.doc_id = d.doc_id AND b.item = d.item),
totals AS (SELECT doc_id, sum(missing) AS missing, sum(added) AS added FROM net GROUP BY doc_id)
SELECT doc_id, length(baseline)::BIGINT AS baseline, length(derived)::BIGINT AS artifact,
       added::BIGINT AS added, missing::BIGINT AS missing
FROM pairs JOIN totals USING (doc_id)""",
)
def char_loss(spark, folder):
    return P.char_losses(_pairs(spark, folder), "doc_id", "baseline", "derived")


_SQL_DECLARED = f"""SELECT doc_id, token, allowed,
          CASE WHEN len({sql_words('token')}) <> 1 OR {sql_words('token')}[1] <> token
               THEN 'invalid-token' WHEN allowed < 0 THEN 'invalid-count' END AS reason
        FROM (SELECT DISTINCT doc_id, unnest(string_split(nfc_normalize(text), ' ')) AS token,
                     n_chars - 400 AS allowed FROM documents)"""


@query("declared_losses", _SQL_DECLARED)
@query("declared_losses_every_word", _SQL_DECLARED)
def declared_losses(spark, folder):
    """A declaration for everything between two spaces of the whole text, each once."""
    rows = _docs(spark, folder, "doc_id", "text", "n_chars").select(
        "doc_id",
        F.explode(F.array_distinct(F.split(X.nfc(F.col("text")), " "))).alias("token"),
        (F.col("n_chars") - 400).alias("allowed"),
    )
    return P.validate_declared(rows)


@query(
    "multiset_ops",
    f"""WITH {_SQL_PAIRS},
x AS (SELECT doc_id, unnest({sql_words('baseline')}) AS token FROM pairs),
y AS (SELECT doc_id, unnest({sql_words('derived')}) AS token FROM pairs),
s AS (SELECT doc_id, token, count(*) AS n FROM (FROM x EXCEPT ALL FROM y) GROUP BY ALL),
i AS (SELECT doc_id, token, count(*) AS n FROM (FROM x INTERSECT ALL FROM y) GROUP BY ALL),
a AS (SELECT doc_id, token, count(*) AS n FROM (FROM x UNION ALL FROM y) GROUP BY ALL)
SELECT a.doc_id, a.token, coalesce(s.n, 0)::BIGINT AS subtract,
       coalesce(i.n, 0)::BIGINT AS intersect, a.n::BIGINT AS added
FROM a LEFT JOIN s USING (doc_id, token) LEFT JOIN i USING (doc_id, token)""",
)
def multiset_ops(spark, folder):
    pairs = _pairs(spark, folder)
    left = P.token_counts(pairs, "doc_id", "baseline")
    right = P.token_counts(pairs, "doc_id", "derived")
    return P.multiset_ops(left, right, "doc_id", "token")


@query(
    "nfc_forms",
    """SELECT doc_id, sha256(nfc_normalize(replace(text, 'é', 'e' || chr(769)))) AS form,
              sha256(text) = sha256(nfc_normalize(text)) AS already FROM documents""",
)
def nfc_forms(spark, folder):
    apart = F.replace(F.col("text"), F.lit("é"), F.lit("é"))
    return _docs(spark, folder, "doc_id", "text").select(
        "doc_id",
        F.sha2(X.nfc(apart), 256).alias("form"),
        (X.nfc(F.col("text")) == F.col("text")).alias("already"),
    )


@query(
    "whitespace_forms",
    f"""SELECT doc_id, sha256(trim(regexp_replace(text, '{SQL_WS}+', ' ', 'g'))) AS collapsed,
               sha256(regexp_replace(text, '{SQL_WS}+', '', 'g')) AS removed FROM documents""",
)
def whitespace_forms(spark, folder):
    text = F.col("text")
    return _docs(spark, folder, "doc_id", "text").select(
        "doc_id",
        F.sha2(X.collapse_whitespace(text), 256).alias("collapsed"),
        F.sha2(X.remove_whitespace(text), 256).alias("removed"),
    )


@query(
    "short_extractions",
    f"""SELECT doc_id, len({sql_words('nfc_normalize(text)')})::BIGINT AS measured_words
        FROM documents WHERE measured_words < 300""",
)
def short_extractions(spark, folder):
    return P.extraction_failures(_docs(spark, folder, "doc_id", "text"), "doc_id", "text")


# Code points a reader may not draw; the second column is what the queries count.
GLYPHS = ("U+00E9", "U+0065", "U+21A9", "U+251C")


@query(
    "glyph_hits",
    """SELECT doc_id, glyph, (length(text) - length(replace(text, ch, '')))::BIGINT AS n
       FROM documents, (VALUES ('U+00E9', chr(233)), ('U+0065', 'e'), ('U+21A9', chr(8617)),
                               ('U+251C', chr(9500))) g(glyph, ch)
       WHERE contains(text, ch)""",
)
def glyph_hits(spark, folder):
    counts = F.array(
        *[
            F.struct(
                F.lit(name).alias("glyph"),
                X.glyph_count(F.col("text"), X.codepoint(name)).alias("n"),
            )
            for name in GLYPHS
        ]
    )
    hits = _docs(spark, folder, "doc_id", "text").select("doc_id", F.inline(counts))
    return hits.filter(F.col("n") > 0)


@query(
    "author_hits",
    """SELECT conv_id, turn, role AS author,
          CASE WHEN length(role) > 0 AND length(text) > 0 THEN
            ((length(text) - length(replace(text, role, ''))) // length(role))::BIGINT END AS n
       FROM conversations""",
)
def author_hits(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.col("role").alias("author"),
        X.occurrences(F.col("text"), F.col("role")).alias("n"),
    )


_SQL_OPENED = f"""regexp_replace(before, '(?s)^.*(?:\\n|[.!?]{SQL_WS})', '')"""


@query(
    "sentence_quotes",
    # The checking engine has no look-ahead, so a sentence end takes its white space along;
    # collapsing white space afterwards makes the two equal.
    f"""WITH hit AS (SELECT doc_id, text, instr(text, 'on') AS pos FROM documents),
cut AS (SELECT doc_id, pos, substr(text, greatest(pos - 160, 1), pos - greatest(pos - 160, 1)) AS before,
               substr(text, pos + 2, 160) AS after FROM hit WHERE pos > 0),
ends AS (SELECT *, regexp_extract(after, '(?s)^(.*?(?:\\n|[.!?](?:{SQL_WS}|\\z)))', 1) AS closed
         FROM cut)
SELECT doc_id, trim(regexp_replace({_SQL_OPENED} || 'on'
         || CASE WHEN closed <> '' THEN closed ELSE after END, '{SQL_WS}+', ' ', 'g')) AS quote
FROM ends""",
)
def sentence_quotes(spark, folder):
    quote = X.sentence_around(F.col("text"), F.lit("on"))
    return (
        _docs(spark, folder, "doc_id", "text")
        .select("doc_id", quote.alias("quote"))
        .filter(F.col("quote").isNotNull())
    )


@query(
    "language_tags",
    r"""WITH said AS (SELECT doc_id, source AS stated, CASE WHEN n_chars > 1000 THEN lang END AS written
                      FROM documents)
SELECT doc_id,
  CASE WHEN regexp_full_match(pick, '[A-Za-z]{2,8}(-[A-Za-z0-9]+)*') THEN pick ELSE 'und' END AS language,
  CASE WHEN pick IS NULL THEN 'default'
       WHEN NOT regexp_full_match(pick, '[A-Za-z]{2,8}(-[A-Za-z0-9]+)*') THEN 'unusable'
       WHEN stated IS NOT NULL THEN 'extraction' ELSE 'metadata' END AS language_source
FROM (SELECT doc_id, CASE WHEN stated LIKE '%1' THEN stated END AS stated, written,
             coalesce(CASE WHEN stated LIKE '%1' THEN stated END, written) AS pick FROM said)""",
)
def language_tags(spark, folder):
    docs = _docs(spark, folder, "doc_id", "lang", "source", "n_chars").select(
        "doc_id",
        F.when(F.col("source").endswith("1"), F.col("source")).alias("stated"),
        F.when(F.col("n_chars") > 1000, F.col("lang")).alias("written"),
    )
    return D.with_language(docs, stated="stated", written="written").select(
        "doc_id", "language", "language_source"
    )


@query(
    "document_digests",
    """SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS byte_size FROM documents""",
)
def document_digests(spark, folder):
    return D.with_digest(_docs(spark, folder, "doc_id", "text"), "text").drop("text")


@query(
    "stated_authors",
    """SELECT conv_id, turn, coalesce(nullif(CASE WHEN role = 'user' THEN '' ELSE role END, ''),
              nullif(regexp_extract(text, '^[A-Za-z]+'), '')) AS author FROM conversations""",
)
def stated_authors(spark, folder):
    turns = table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", F.lit("")).otherwise(F.col("role")).alias("author"),
        F.regexp_extract("text", r"^[A-Za-z]+", 0).alias("authors"),
    )
    return D.with_author(turns, "author", "authors").select("conv_id", "turn", "author")
