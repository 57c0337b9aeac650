"""Queries over single facts: decoding, labels, panels, inherited quantities, repairs and kept reports."""

from pyspark.sql import functions as F

from corpusaudit.functions import text as X
from corpusaudit.operators import observations as O
from corpusaudit.operators import rewrite as W
from corpusaudit.operators import verdicts as V
from corpusaudit.plans.corpus_queries import _NOTED, _noted_pages
from corpusaudit.plans.tables import query, table
from corpusaudit.plans.tree_queries import _SQL_TOKENS, _linked
from corpusaudit.rules import PANEL
from corpusaudit.session import materialise, new_folder
from corpusaudit.sources import documents as D
from corpusaudit.sources import images as I
from corpusaudit.sources import stores
from corpusaudit.sources.html import pages_to_nodes


@query(
    "decoded_documents",
    """SELECT doc_id, CASE WHEN lang <> 'fr' OR length(text) % 2 = 0 THEN sha256(text) END AS digest,
  CASE WHEN lang = 'fr' AND length(text) % 2 = 1 THEN 'not-utf8' END AS refusal FROM documents""",
)
def decoded_documents(spark, folder):
    """Documents as bytes; French ones of odd length are cut within a character."""
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    whole = F.col("text").cast("binary")
    cut = F.concat(whole, F.unhex(F.lit("C3")))
    bad = (F.col("lang") == "fr") & (F.length("text") % 2 == 1)
    read = D.decode_utf8(docs.select("doc_id", F.when(bad, cut).otherwise(whole).alias("content")))
    return read.select("doc_id", F.sha2("text", 256).alias("digest"), "refusal")


@query(
    "inline_labels",
    r"""SELECT doc_id, CASE lang WHEN 'en' THEN 'data:,' || '…' WHEN 'de' THEN left('DATA:' || regexp_extract(text, '^[^,]*'), 60) || CASE WHEN contains(text, ',') THEN ',…' ELSE '' END
  ELSE ' ' || text END AS label FROM (SELECT doc_id, lang, replace(regexp_extract(text, '^[^\n]*'), ' ', '_') AS text FROM documents)""",
)
def inline_labels(spark, folder):
    """Names of references: first lines as inline data with and without a media type, and as plain locators."""
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    first = F.replace(F.regexp_extract("text", r"^[^\n]*", 0), F.lit(" "), F.lit("_"))
    src = (
        F.when(F.col("lang") == "en", F.concat(F.lit(" data:,"), first))
        .when(F.col("lang") == "de", F.concat(F.lit("DATA:"), first))
        .otherwise(F.concat(F.lit(" "), first))
    )
    return docs.select("doc_id", X.inline_label(src).alias("label"))


@query(
    "fitting_images",
    f"""SELECT event_id, coalesce(w <= {PANEL['max_width_px']} AND h <= {PANEL['max_height_px']}, false) AS fits,
  coalesce(w <= {PANEL['max_width_px']} AND h IS NOT NULL, false) AS narrow FROM (SELECT event_id,
  CASE WHEN event_type <> 'error' THEN floor(abs(value) * 10)::BIGINT END AS w, floor(abs(value) * 17)::BIGINT AS h FROM events)""",
)
def fitting_images(spark, folder):
    """Each event stands for a picture; of errors the width is unknown. One panel, and one without a height."""
    size = F.abs("value")
    width = F.when(F.col("event_type") != "error", F.floor(size * 10))
    events = table(spark, folder, "events", "event_id", "event_type", "value")
    fits = I.fits(width, F.floor(size * 17), PANEL["max_width_px"], PANEL["max_height_px"])
    return events.select("event_id", fits.alias("fits"), I.fits(width, F.floor(size * 17), PANEL["max_width_px"], None).alias("narrow"))


@query(
    "inherited_facts",
    """SELECT event_id, 'reported' AS basis, CASE event_type WHEN 'signup' THEN 'at-most' END AS relation, 'links' AS unit, floor(value)::BIGINT AS value FROM events""",
)
def inherited_facts(spark, folder):
    """Quantities of one run as another takes them over: what was reported to that one stays as it is."""
    events = table(spark, folder, "events", "event_id", "event_type", "value")
    basis = F.when(F.col("event_type").isin("click", "purchase"), "measured").when(F.col("event_type") == "view", "projected").otherwise("reported")
    fact = F.struct(
        basis.alias("basis"),
        F.when(basis != "reported", F.lit("at-least")).when(F.col("event_type") == "signup", F.lit("at-most")).alias("relation"),
        F.lit("links").alias("unit"),
        F.floor("value").cast("bigint").alias("value"),
    ).cast(V.QUANTITY)
    return events.select("event_id", V.inherit(fact).alias("q")).select("event_id", "q.basis", "q.relation", "q.unit", "q.value")


@query(
    "repair_candidates",
    _SQL_TOKENS
    + """ SELECT n.doc_id, CASE WHEN lang IN ('fr', 'de', 'es') OR blank THEN 'skipped' END AS outcome FROM n
JOIN (SELECT doc_id, list_bool_or(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '[<>&]', ' ', 'g')) = '')) AS blank FROM documents) b USING (doc_id)
WHERE notes = 0 AND xref + dead > 0 AND (lang IN ('fr', 'de', 'es') OR blank)""",
)
def repair_candidates(spark, folder):
    """Documents whose links were kept for want of a note, and of whose page no notes could be recovered.

    Only pages of documents whose interlock engaged are read: of no others is the outcome asked.
    """
    docs = table(spark, folder, "documents", "doc_id")
    locked = materialise(W.interlock(docs, W.classify_links(_linked(spark, folder))).filter("engaged"))
    pages = materialise(pages_to_nodes(_noted_pages(spark, folder, locked), "doc_id", "html", only=_NOTED))
    outcomes = W.apparatus(pages).select("doc_id", F.col("outcome").alias("recovery_outcome"))
    found = O.repair_candidates(locked.join(outcomes, "doc_id"))
    return found.select("doc_id", F.col("recovery_outcome").alias("outcome"))


@query(
    "kept_reports",
    """SELECT doc_id, run_date, n, n AS said FROM (SELECT doc_id, '2024-0' || (1 + doc_id % 3) || '-01' AS run_date, length(text)::BIGINT AS n FROM documents)""",
)
def kept_reports(spark, folder):
    """Reports of each document in the sink by run date, and what its JSON lines say."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    date = F.concat(F.lit("2024-0"), 1 + F.col("doc_id") % 3, F.lit("-01"))
    reports = docs.select("doc_id", F.length("text").cast("bigint").alias("n"), date.alias("run_date"))
    home = new_folder(spark)
    stores.write_reports(reports, f"{home}/table", f"{home}/json")
    kept = spark.read.schema("doc_id long, n long, run_date string").parquet(f"{home}/table")
    said = spark.read.schema("doc_id long, n long, run_date string").json(f"{home}/json")
    return kept.join(said.select("doc_id", "run_date", F.col("n").alias("said")), ["doc_id", "run_date"])
