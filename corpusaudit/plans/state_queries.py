"""Corpus state, naming and delivery queries.

The stored side of each comparison is derived from the given tables: a labelled document counts
as published before; a low quality label means its source was edited since; a toxic label means
the stored artifact was replaced; German artifacts were deleted.
"""

from pyspark.sql import functions as F

from corpusaudit.functions import names as N
from corpusaudit.operators import delivery as L
from corpusaudit.operators import naming, state
from corpusaudit.plans.tables import SQL_WS, query, table
from corpusaudit.session import materialise
from corpusaudit.sources import documents as D

PATH = "concat('/inbox/', source, '/', doc_id, '.md')"


def _candidates(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text", "source")
    return docs.select(F.expr(PATH).alias("path"), F.sha2("text", 256).alias("sha256"))


def _published(spark, folder):
    """Documents with a label, and what their label says happened since."""
    docs = table(spark, folder, "documents", "doc_id", "text", "lang", "source")
    rows = docs.join(table(spark, folder, "labels"), "doc_id").select(
        "doc_id",
        "lang",
        "toxic",
        F.expr(PATH).alias("source"),
        F.concat(F.lit("bundle-"), F.col("doc_id")).alias("bundle"),
        F.when(F.col("quality") == 1, F.sha2("text", 256))
        .otherwise(F.sha2(F.concat("text", F.lit("\nedited")), 256))
        .alias("source_sha256"),
        F.concat(F.lit("/ready/"), F.col("doc_id"), F.lit(".epub")).alias("artifact"),
        F.sha2(F.concat(F.lit("book "), F.col("text")), 256).alias("artifact_sha256"),
    )
    # Evidence is a table of its own; it is read several times and holds no text.
    return materialise(rows)


def _evidence(published):
    return published.select("bundle", "source", "source_sha256", "artifact", "artifact_sha256")


def _artifacts(published):
    return published.filter("lang <> 'de'").select(
        F.col("artifact").alias("path"),
        F.when(F.col("toxic") == 1, F.sha2("artifact_sha256", 256))
        .otherwise(F.col("artifact_sha256"))
        .alias("sha256"),
    )


SQL_STATE = """
WITH cand AS (SELECT doc_id, '/inbox/' || source || '/' || doc_id || '.md' AS path,
                     sha256(text) AS sha256, lang, text FROM documents),
ev AS (SELECT path AS source, 'bundle-' || doc_id AS bundle, lang, toxic,
         CASE WHEN quality = 1 THEN sha256 ELSE sha256(text || chr(10) || 'edited') END AS source_sha256,
         '/ready/' || doc_id || '.epub' AS artifact, sha256('book ' || text) AS artifact_sha256
       FROM cand JOIN labels USING (doc_id)),
art AS (SELECT artifact AS path,
          CASE WHEN toxic = 1 THEN sha256(artifact_sha256) ELSE artifact_sha256 END AS sha256
        FROM ev WHERE lang <> 'de'),
dam AS (SELECT ev.*, CASE WHEN art.path IS NULL THEN 'artifact-missing'
                          WHEN art.sha256 <> ev.artifact_sha256 THEN 'artifact-mismatched' END AS damage
        FROM ev LEFT JOIN art ON ev.artifact = art.path)"""

SQL_DERIVED = (
    SQL_STATE
    + """,
derived AS (
SELECT cand.path, cand.sha256,
  CASE WHEN x.source IS NOT NULL AND x.damage IS NULL THEN 'already-ready'
       WHEN EXISTS (SELECT 1 FROM ev WHERE ev.source = cand.path AND ev.source_sha256 <> cand.sha256)
       THEN 'changed' ELSE 'new' END AS state, x.damage
FROM cand LEFT JOIN dam x ON x.source = cand.path AND x.source_sha256 = cand.sha256)"""
)


@query("candidate_states", SQL_DERIVED + " SELECT path, sha256, state, damage FROM derived")
def candidate_states(spark, folder):
    published = _published(spark, folder)
    return state.derive_state(
        _candidates(spark, folder), _evidence(published), _artifacts(published)
    )


@query(
    "candidate_attempts",
    SQL_DERIVED
    + """ SELECT path, state, CASE WHEN quality IS NOT NULL AND quality = 1 THEN CASE WHEN toxic = 1 THEN 'text-preservation' ELSE 'compatibility' END END AS boundary
FROM derived JOIN cand USING (path) LEFT JOIN labels USING (doc_id)""",
)
def candidate_attempts(spark, folder):
    """States with the last of two attempts per published source."""
    published = _published(spark, folder)
    tried = lambda at, boundary: published.select(
        "source", "source_sha256", boundary.alias("boundary"), F.lit(at).alias("finished_at")
    )
    last = F.when(F.col("toxic") == 1, F.lit("text-preservation")).otherwise(F.lit("compatibility"))
    attempts = tried("2020-01-01", F.lit("packaging-failure")).unionByName(tried("2020-01-02", last))
    states = state.derive_state(
        _candidates(spark, folder), _evidence(published), _artifacts(published)
    )
    return state.with_latest_attempt(states, attempts).select("path", "state", "boundary")


@query(
    "evidence_problems",
    SQL_STATE
    + """
SELECT DISTINCT bundle,
  CASE WHEN lang = 'fr' AND toxic = 1 THEN 'unreadable-report'
       WHEN lang = 'es' AND toxic = 1 THEN 'incomplete-report' ELSE damage END AS problem,
  CASE WHEN lang IN ('fr', 'es') AND toxic = 1 THEN NULL ELSE artifact END AS artifact
FROM dam WHERE damage IS NOT NULL OR (lang IN ('fr', 'es') AND toxic = 1)""",
)
def evidence_problems(spark, folder):
    published = _published(spark, folder)
    toxic = F.col("toxic") == 1
    reports = published.select(
        "bundle",
        (~(toxic & (F.col("lang") == "fr"))).alias("readable"),
        "source",
        F.lit(None).cast("string").alias("source_url"),
        F.when(toxic & (F.col("lang") == "es"), F.lit("")).otherwise(F.col("source_sha256")).alias(
            "source_sha256"
        ),
        "artifact",
        "artifact_sha256",
    )
    return state.evidence_problems(reports, _artifacts(published))


@query(
    "artifact_publications",
    SQL_STATE
    + """, shared AS (SELECT '/ready/' || lang || '-' || toxic || '.epub' AS artifact, bundle,
                             artifact_sha256 FROM ev)
SELECT artifact AS path, min(bundle) AS bundle, arg_min(artifact_sha256, bundle) AS recorded_sha256
FROM shared GROUP BY artifact""",
)
def artifact_publications(spark, folder):
    name = F.concat(F.lit("/ready/"), "lang", F.lit("-"), "toxic", F.lit(".epub"))
    shared = _published(spark, folder).withColumn("artifact", name)
    books = shared.select(F.col("artifact").alias("path")).distinct()
    return state.published_artifact(books, _evidence(shared))


@query(
    "hash_guard",
    SQL_STATE
    + """ SELECT cand.path, sha256 AS expected, source_sha256 AS observed,
  CASE WHEN source_sha256 IS NULL THEN 'source-missing'
       WHEN source_sha256 <> sha256 THEN 'source-changed' ELSE 'unchanged' END AS status
FROM cand LEFT JOIN ev ON ev.source = cand.path""",
)
def hash_guard(spark, folder):
    observed = _published(spark, folder).select(
        F.col("source").alias("path"), F.col("source_sha256").alias("sha256")
    )
    return state.hash_guard(_candidates(spark, folder), observed)


SQL_SEEN = """
WITH seen AS (SELECT source || '/' || (n_chars // 50) AS path, lang AS inbox,
                CASE lang WHEN 'en' THEN 3 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 0 END AS inbox_ord,
                doc_id FROM documents)"""


def _seen(spark, folder):
    """Overlapping inboxes: each language is an inbox, and files of like size share a path."""
    order = F.expr("CASE lang WHEN 'en' THEN 3 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 0 END")
    docs = table(spark, folder, "documents", "doc_id", "lang", "source", "n_chars")
    return docs.select(
        F.expr("concat(source, '/', n_chars div 50)").alias("path"),
        F.col("lang").alias("inbox"),
        order.alias("inbox_ord"),
        "doc_id",
    )


@query(
    "inbox_owners",
    SQL_SEEN
    + """ SELECT path, arg_min(inbox, inbox_ord) AS inbox, min(inbox_ord) AS inbox_ord,
       list_sort(list_distinct(list(inbox_ord || ':' || inbox))) AS inboxes FROM seen GROUP BY path""",
)
def inbox_owners(spark, folder):
    # Positions are put in front of the names so that both engines order the list alike.
    seen = _seen(spark, folder).drop("doc_id")
    owners = state.reconcile_inboxes(
        seen.withColumn("inbox", F.concat_ws(":", "inbox_ord", "inbox"))
    )
    return owners.withColumn("inbox", F.split_part("inbox", F.lit(":"), F.lit(2)))


@query(
    "inbox_coverage",
    """SELECT source AS inbox, count(*) FILTER (lang IN ('en', 'fr') AND n_chars < 9000) AS supported_count,
  count(*) FILTER (lang NOT IN ('en', 'fr') AND n_chars < 9000) AS ignored_count,
  arg_min('too large: ' || doc_id, doc_id) FILTER (n_chars >= 9000) AS error,
  CASE WHEN count(*) FILTER (n_chars >= 9000) > 0 THEN 'unavailable' ELSE 'checked' END AS status
FROM documents GROUP BY source""",
)
def inbox_coverage(spark, folder):
    return state.inbox_coverage(_inbox_files(spark, folder))


def _inbox_files(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "lang", "source", "n_chars")
    return docs.select(
        F.col("source").alias("inbox"),
        F.col("doc_id").alias("ord"),
        F.col("lang").isin("en", "fr").alias("supported"),
        F.when(
            F.col("n_chars") >= 9000, F.concat(F.lit("too large: "), F.col("doc_id"))
        ).alias("error"),
    )


@query(
    "routine_selection",
    SQL_DERIVED
    + """, cov AS (SELECT bool_or(n_chars >= 9000) AS partial FROM documents),
named AS (SELECT d.path, d.state, regexp_extract(c.text, '^[A-Za-z]+') AS display_name
          FROM derived d JOIN cand c USING (path)),
one AS (SELECT display_name FROM named GROUP BY display_name HAVING count(*) = 1)
SELECT path, state, display_name, partial FROM named SEMI JOIN one USING (display_name), cov
WHERE state IN ('new', 'changed')""",
)
def routine_selection(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text", "source")
    names = docs.select(
        F.expr(PATH).alias("path"),
        F.sha2("text", 256).alias("sha256"),
        F.regexp_extract("text", r"^[A-Za-z]+", 0).alias("display_name"),
    )
    published = _published(spark, folder)
    derived = state.derive_state(names, _evidence(published), _artifacts(published))
    coverage = state.inbox_coverage(_inbox_files(spark, folder))
    return state.select_routine(derived, coverage).select(
        "path", "state", "display_name", "partial"
    )


@query(
    "latest_per_key",
    """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id,
              arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts
       FROM events GROUP BY user_id""",
)
def latest_per_key(spark, folder):
    events = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type")
    return state.latest_per_key(events, ["user_id"], ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type", "ts"
    )


def _sql_cut(text: str, limit: int) -> str:
    return f"""left({text}, coalesce(list_max(list_filter(
  range(0, least(length({text}), {limit}) + 1), lambda k: strlen(left({text}, k)) <= {limit})), 0))"""


def _sql_whole_names(existing: bool) -> str:
    before = "UNION ALL SELECT name, digest, -1 FROM e" if existing else ""
    return f"""WITH t AS (SELECT doc_id AS ord, regexp_extract(text, '^[^\\n]*') AS title, sha256(text) AS digest FROM documents),
p AS (SELECT *, trim(regexp_replace(nfc_normalize(title),
  '(?:[^\\p{{L}}\\p{{N}}''’(),\\[\\]&\\-_.]+|{SQL_WS}+)+', ' ', 'g')) AS spaced FROM t),
b AS (SELECT ord, title, digest, coalesce(nullif(regexp_replace({_sql_cut("spaced", 80)}, '^[ .]+|[ .]+$', '', 'g'), ''), 'book') AS base FROM p),
n AS (SELECT ord, title, digest, base || '.epub' AS plain,
        regexp_replace({_sql_cut("base", 67)}, '[ .]+$', '') || '-' || left(digest, 12) || '.epub' AS suffixed FROM b),
e AS (SELECT plain AS name, arg_min(sha256(digest), ord) AS digest FROM n JOIN labels ON ord = doc_id GROUP BY plain),
h AS (SELECT name, arg_min(digest, ord) AS holder, min(ord) AS first
      FROM (SELECT plain AS name, digest, ord FROM n {before}) GROUP BY name),
s AS (SELECT n.*, holder = digest AS own, first FROM n JOIN h ON plain = name),
h2 AS (SELECT name, arg_min(digest, ord) AS holder2, min(ord) AS first2
       FROM (SELECT suffixed AS name, digest, ord FROM s WHERE NOT own {before}) GROUP BY name)
SELECT ord, title, digest, CASE WHEN own THEN plain ELSE suffixed END AS name,
  CASE WHEN NOT own AND holder2 <> digest THEN 'refuse'
       WHEN CASE WHEN own THEN first ELSE first2 END = ord THEN 'publish' ELSE 'reuse' END AS action
FROM s LEFT JOIN h2 ON suffixed = h2.name AND NOT own"""


def _whole_titles(spark, folder):
    """Books titled by their whole first line: long titles reach the byte limit and clash after the cut."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    return docs.select(
        F.col("doc_id").alias("ord"),
        F.regexp_extract("text", r"^[^\n]*", 0).alias("title"),
        F.sha2("text", 256).alias("digest"),
    )


@query("artifact_names", _sql_whole_names(False))
@query("artifact_names_whole_titles", _sql_whole_names(False))
def artifact_names(spark, folder):
    return naming.assign_names(_whole_titles(spark, folder))


@query("artifact_names_existing", _sql_whole_names(True))
@query("artifact_names_existing_whole_titles", _sql_whole_names(True))
def artifact_names_existing(spark, folder):
    titled = _whole_titles(spark, folder)
    labels = table(spark, folder, "labels", "doc_id").withColumnRenamed("doc_id", "ord")
    existing = (
        titled.join(labels, "ord")
        .withColumn("name", F.concat(N.portable_base(F.col("title")), F.lit(".epub")))
        .groupBy("name")
        .agg(F.min_by(F.sha2("digest", 256), F.col("ord")).alias("digest"))
    )
    return naming.assign_names(titled, existing)


@query(
    "portable_bases",
    f"""WITH t AS (SELECT doc_id, regexp_extract(text, '^[^\\n]*') AS title FROM documents),
b AS (SELECT doc_id, title, trim(regexp_replace(nfc_normalize(title),
  '(?:[^\\p{{L}}\\p{{N}}''’(),\\[\\]&\\-_.]+|{SQL_WS}+)+', ' ', 'g')) AS plain FROM t)
SELECT doc_id, coalesce(nullif(regexp_replace(left(plain, coalesce(list_max(list_filter(
  range(0, least(length(plain), 80) + 1), lambda k: strlen(left(plain, k)) <= 80)), 0)),
  '^[ .]+|[ .]+$', '', 'g'), ''), 'book') AS base FROM b""",
)
def portable_bases(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    title = F.regexp_extract("text", r"^[^\n]*", 0)
    return docs.select("doc_id", N.portable_base(title).alias("base"))


@query(
    "provenance_keys",
    """SELECT doc_id, left(sha256('/inbox/' || source || '/' || doc_id || '.md' || chr(10) || sha256(text)), 24)
         AS key, 'urn:sha256:' || sha256(text) AS identity FROM documents""",
)
def provenance_keys(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text", "source")
    digest = F.sha2("text", 256)
    return docs.select(
        "doc_id",
        N.provenance_key(F.expr(PATH), digest).alias("key"),
        N.artifact_identity(digest).alias("identity"),
    )


@query(
    "bounded_ids",
    """WITH t AS (SELECT doc_id, lower(regexp_replace(regexp_extract(text, '^[^\\n]*'), '[ .]+', '-', 'g')) AS ident
           FROM documents)
SELECT doc_id, ident, CASE WHEN strlen(ident) <= 77 THEN ident ELSE
  left(ident, list_max(list_filter(range(0, 69), lambda k: strlen(left(ident, k)) <= 68)))
  || '-' || left(sha256(ident), 8) END AS bounded FROM t""",
)
def bounded_ids(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    ident = F.lower(F.regexp_replace(F.regexp_extract("text", r"^[^\n]*", 0), "[ .]+", "-"))
    return docs.select("doc_id", ident.alias("ident")).withColumn(
        "bounded", N.bounded_identifier(F.col("ident"), 96)
    )


SQL_BOOKS = """
WITH book AS (SELECT doc_id, lang || '-' || doc_id || '.epub' AS name, strlen(text)::BIGINT AS byte_size,
                     toxic FROM documents LEFT JOIN labels USING (doc_id)),
listing AS (SELECT lang || '-' || doc_id || '.epub' AS name, quality = 0 AND toxic = 1 AS is_directory,
              CASE WHEN quality = 1 THEN strlen(text) ELSE strlen(text) + 1 END::BIGINT AS remote_size
            FROM documents JOIN labels USING (doc_id)),
files AS (SELECT name, remote_size FROM listing WHERE NOT is_directory)"""


def _books(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text", "lang").select(
        "doc_id",
        F.concat("lang", F.lit("-"), "doc_id", F.lit(".epub")).alias("name"),
        F.octet_length("text").cast("bigint").alias("byte_size"),
    )
    return docs.join(table(spark, folder, "labels"), "doc_id", "left")


def _listing(books):
    return books.filter("quality is not null").select(
        "name",
        F.expr("byte_size + if(quality = 1, 0, 1)").alias("byte_size"),
        F.expr("quality = 0 and toxic = 1").alias("is_directory"),
    )


@query(
    "delivery_plan",
    SQL_BOOKS
    + """ SELECT name, byte_size, remote_size, CASE WHEN remote_size IS NULL THEN 'upload-new'
  WHEN remote_size = byte_size THEN 'already-delivered' WHEN byte_size > 2000 THEN 'overwrite'
  ELSE 'collision' END AS action FROM book LEFT JOIN files USING (name)""",
)
def delivery_plan(spark, folder):
    books = _books(spark, folder)
    wanted = books.select("name", "byte_size", (F.col("byte_size") > 2000).alias("overwrite"))
    return L.plan_delivery(wanted, _listing(books)).select(
        "name", "byte_size", "remote_size", "action"
    )


@query(
    "delivery_confirm",
    SQL_BOOKS
    + """ SELECT name, byte_size,
  CASE WHEN remote_size = byte_size THEN 'delivered' ELSE 'unconfirmed' END AS outcome,
  CASE WHEN remote_size IS NULL THEN 'not-listed' WHEN remote_size <> byte_size THEN 'other-size' END AS reason
FROM book LEFT JOIN files USING (name)""",
)
def delivery_confirm(spark, folder):
    books = _books(spark, folder)
    return L.confirm_delivery(books.select("name", "byte_size"), _listing(books)).select(
        "name", "byte_size", "outcome", "reason"
    )


@query(
    "deliverable",
    SQL_STATE
    + """, chosen AS (
SELECT cand.doc_id, CASE WHEN lang = 'es' THEN '/other/' ELSE '/ready/' END || cand.doc_id
         || CASE WHEN length(text) < 300 THEN '.txt' ELSE '.epub' END AS path,
       length(text) < 9000 AS is_file, sha256('book ' || text) AS sha256, lang, text FROM cand)
SELECT c.path, CASE WHEN NOT is_file THEN 'unusable-ready-artifact'
  WHEN c.path NOT LIKE '%.epub' THEN 'unusable-ready-artifact'
  WHEN c.path NOT LIKE '/ready/%' THEN 'artifact-outside-ready'
  WHEN ev.bundle IS NULL THEN 'missing-preparation-evidence'
  WHEN CASE WHEN toxic = 1 THEN sha256(artifact_sha256) ELSE artifact_sha256 END <> c.sha256
  THEN 'artifact-mismatched' END AS boundary
FROM chosen c LEFT JOIN ev ON ev.artifact = c.path""",
)
def deliverable(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    chosen = docs.select(
        F.concat(
            F.when(F.col("lang") == "es", F.lit("/other/")).otherwise(F.lit("/ready/")),
            "doc_id",
            F.when(F.length("text") < 300, F.lit(".txt")).otherwise(F.lit(".epub")),
        ).alias("path"),
        (F.length("text") < 9000).alias("is_file"),
        F.sha2(F.concat(F.lit("book "), "text"), 256).alias("sha256"),
    )
    evidence = _published(spark, folder).withColumn(
        "artifact_sha256",
        F.when(F.col("toxic") == 1, F.sha2("artifact_sha256", 256)).otherwise(
            F.col("artifact_sha256")
        ),
    )
    return L.deliverable(chosen, _evidence(evidence), "/ready").select("path", "boundary")


@query(
    "source_kinds",
    """SELECT page_id, CASE WHEN url LIKE 'http%' THEN 'article-url' ELSE 'unknown-local-kind' END AS whole,
  CASE WHEN regexp_matches(name, '[^.]\\.(md|markdown)$') THEN 'markdown'
       WHEN regexp_matches(name, '[^.]\\.(html|htm|xhtml)$') THEN 'local-html'
       WHEN regexp_matches(name, '[^.]\\.pdf$') THEN 'pdf' ELSE 'unknown-local-kind' END AS saved
FROM (SELECT page_id, url, lower(regexp_extract(regexp_replace(url, '[?#].*', ''), '[^/]*$')) ||
        CASE WHEN length(html) < 2500 THEN '.MD' WHEN length(html) < 3500 THEN '.html' ELSE '' END AS raw,
        lower(raw) AS name FROM pages)""",
)
def source_kinds(spark, folder):
    name = F.regexp_extract(F.regexp_replace("url", r"[?#].*", ""), r"[^/]*\z", 0)
    size = F.length("html")
    saved = F.concat(
        name, F.when(size < 2500, F.lit(".MD")).when(size < 3500, F.lit(".html")).otherwise("")
    )
    pages = table(spark, folder, "pages")
    return pages.select("page_id", F.col("url"), saved.alias("saved")).select(
        "page_id", D.source_kind(F.col("url")).alias("whole"), D.file_kind(F.col("saved")).alias("saved")
    )


@query(
    "page_titles",
    """SELECT page_id, coalesce(nullif(said, ''), stem) AS title,
         CASE WHEN said <> '' THEN 'metadata' ELSE 'filename' END AS title_source
FROM (SELECT page_id, trim(regexp_extract(html, '(?s)<h1>([^<]*)</h1>', 1)) AS said,
             regexp_extract(regexp_replace(url, '[?#].*', ''), '[^/]*$') AS stem FROM pages)""",
)
def page_titles(spark, folder):
    pages = table(spark, folder, "pages").select(
        "page_id",
        F.regexp_extract("html", r"(?s)<h1>([^<]*)</h1>", 1).alias("said"),
        F.regexp_extract(F.regexp_replace("url", r"[?#].*", ""), r"[^/]*\z", 0).alias("stem"),
    )
    return D.with_title(pages, "said", "stem").select("page_id", "title", "title_source")


