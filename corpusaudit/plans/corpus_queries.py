"""Corpus summaries, retrieval, recovered notes, lineage, conformance and streamed arrivals."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit.operators import package as K
from corpusaudit.operators import preservation as P
from corpusaudit.operators import rewrite as W
from corpusaudit.operators import structure as S
from corpusaudit.operators import verdicts as V
from corpusaudit.plans.tables import query, sql_words, table
from corpusaudit.plans.text_queries import _SQL_LOSS, _declared, _pairs
from corpusaudit.session import materialise, new_folder
from corpusaudit.sources import images as I
from corpusaudit.sources.html import pages_to_nodes
from corpusaudit.streaming import arrivals as A


@query(
    "corpus_rollup",
    _SQL_LOSS
    + f""", lost AS (SELECT doc_id, sum(missing) AS missing FROM net GROUP BY doc_id)
SELECT lang, quality, count(*) AS docs, sum(len({sql_words('nfc_normalize(text)')}))::BIGINT AS words,
       coalesce(sum(missing), 0)::BIGINT AS missing
FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN lost USING (doc_id) GROUP BY ROLLUP (lang, quality)""",
)
def corpus_rollup(spark, folder):
    totals = P.loss_totals(_pairs(spark, folder), "doc_id", "baseline", "derived")
    docs = table(spark, folder, "documents", "doc_id", "lang")
    labels = table(spark, folder, "labels", "doc_id", "quality")
    rows = docs.join(labels, "doc_id", "left").join(totals, "doc_id")
    return rows.rollup("lang", "quality").agg(
        F.count("*").alias("docs"), F.sum("baseline").alias("words"), F.sum("missing").alias("missing")
    )


@query(
    "worst_documents",
    _SQL_LOSS
    + """ SELECT doc_id, sum(missing)::BIGINT AS missing FROM net GROUP BY doc_id ORDER BY missing DESC, doc_id LIMIT 25""",
)
def worst_documents(spark, folder):
    losses = P.token_losses(_pairs(spark, folder), "doc_id", "baseline", "derived", _declared(spark))
    totals = losses.groupBy("doc_id").agg(F.sum("missing").alias("missing"))
    return S.worst(totals, "missing", 25)


@query(
    "claimed_totals",
    """SELECT doc_id, count(*) FILTER (role = 'assistant' AND turn > 0) AS discarded,
              count(*) FILTER (role = 'assistant' AND turn > 0) = 0 AS claimed FROM documents
       LEFT JOIN conversations ON doc_id = conv_id GROUP BY doc_id""",
)
def claimed_totals(spark, folder):
    """Later assistant turns stand in for messages of a reader that dropped a note."""
    said = table(spark, folder, "conversations", "conv_id", "turn", "role").select(
        F.col("conv_id").alias("doc_id"),
        F.when(
            (F.col("role") == "assistant") & (F.col("turn") > 0),
            F.concat(F.lit("Note with key 'n"), "turn", F.lit("' defined at line 3 but not used.")),
        )
        .otherwise(F.lit("Note without key defined at line 1"))
        .alias("message"),
    )
    docs = table(spark, folder, "documents", "doc_id")
    return P.with_claim(docs, "doc_id", said).select("doc_id", "discarded", "claimed")


_SQL_NOTED = """
WITH n AS (SELECT doc_id, lang, text, len(string_split(text, chr(10))) AS k,
  list_max(list_transform(string_split(text, chr(10)), lambda l: (trim(l) = '')::INT)) AS blank FROM documents)"""


#: What ``rewrite.apparatus`` looks at.
_NOTED = ("doc_id", "node", "end_node", "root", "tag", "ident", "classes", "href", "text", "closed")


def _noted_pages(spark, folder, wanted=None):
    """Documents as extracted pages: line i has a reference to note i, which says the line again.

    French pages lost their notes, German ones their references, Spanish ones the last note. Where ``wanted`` is
    given, only documents whose id it holds.
    """
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    if wanted is not None:
        docs = docs.join(wanted.select("doc_id"), "doc_id", "left_semi")
    text = F.regexp_replace("text", r"[<>&]", " ")
    lines = F.split(text, "\n")
    ref = F.when(F.col("lang") == "de", F.lit("")).otherwise(
        F.lit('<sup id="fnref:#"><a href="#fn:#">#</a></sup>')
    )
    number = lambda t, i: F.regexp_replace(t, r"(?<=[:>])#", (i + 1).cast("string"))
    paras = F.array_join(
        F.transform(lines, lambda l, i: F.concat(F.lit("<p>"), l, number(ref, i), F.lit("</p>"))), ""
    )
    note = lambda l, i: F.concat(
        F.lit('<li id="fn:'), i + 1, F.lit('">'), l,
        F.lit(' <a class="footnote-backref" href="#fnref:'), i + 1, F.lit('">&#8617;</a></li>'),
    )
    notes = F.transform(lines, note)
    notes = F.when(F.col("lang") == "es", F.slice(notes, F.lit(1), F.size(notes) - 1)).otherwise(notes)
    box = F.concat(F.lit('<div id="footnotes"><ol>'), F.array_join(notes, ""), F.lit("</ol></div>"))
    box = F.when(F.col("lang") == "fr", F.lit("")).otherwise(box)
    html = F.concat(F.lit("<html><body>"), paras, box, F.lit("</body></html>"))
    return docs.select("doc_id", html.alias("html"))


@query(
    "recovered_notes",
    """WITH l AS (SELECT doc_id, lang, regexp_replace(unnest(string_split(text, chr(10))), '[<>&]', ' ', 'g') AS line FROM documents),
n AS (SELECT doc_id, lang, count(*) AS k, count(*) FILTER (trim(line) = '') AS blank FROM l GROUP BY ALL)
SELECT doc_id, CASE WHEN lang IN ('fr', 'de', 'es') OR blank > 0 THEN 'skipped' ELSE 'recovered' END AS outcome,
  CASE lang WHEN 'fr' THEN 'no-definitions' WHEN 'de' THEN 'no-references' WHEN 'es' THEN 'reference-definition-mismatch'
    ELSE CASE WHEN blank > 0 THEN 'empty-note' END END AS reason,
  CASE WHEN lang = 'de' THEN 0 ELSE k END AS references,
  CASE lang WHEN 'fr' THEN 0 WHEN 'es' THEN k - 1 ELSE k END AS definitions,
  CASE lang WHEN 'fr' THEN k WHEN 'de' THEN k WHEN 'es' THEN 1 ELSE 0 END AS unpaired,
  CASE WHEN lang = 'en' AND blank = 0 THEN k ELSE 0 END AS recovered FROM n""",
)
def recovered_notes(spark, folder):
    nodes = pages_to_nodes(_noted_pages(spark, folder), "doc_id", "html", only=_NOTED)
    return W.apparatus(materialise(nodes)).select(
        "doc_id", "outcome", "reason", "references", "definitions", "unpaired", "recovered"
    )


@query(
    "repair_lineage",
    """SELECT doc_id, CASE length(text) % 11 WHEN 0 THEN 'not-an-inspection' WHEN 1 THEN 'no-canonical-document' WHEN 2 THEN 'profile-mismatch'
  WHEN 3 THEN 'source-kind-mismatch' WHEN 4 THEN 'source-mismatch' WHEN 5 THEN 'source-unreadable' WHEN 6 THEN 'source-changed'
  WHEN 7 THEN 'baseline-mismatch' WHEN 8 THEN 'pandoc-api-version-mismatch' END AS reason,
  length(text) % 11 = 1 OR length(text) % 3 = 0 AS changed FROM documents""",
)
def repair_lineage(spark, folder):
    """Stated and observed lineage of each document; the length of its text says where they part."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    sha, other = F.sha2("text", 256), F.sha2(F.concat("text", F.lit("x")), 256)
    at = F.pmod(F.char_length("text"), F.lit(11))

    def unless(place, value, instead):
        return F.when(at == place, instead).otherwise(value)

    none, path, kind = F.lit(None).cast("string"), F.concat(F.lit("/in/"), "doc_id"), F.lit("markdown")
    version = F.lit("1.23")
    repairs = docs.select(
        "doc_id",
        unless(0, F.lit("inspect"), none).alias("command"),
        unless(1, sha, none).alias("canonical_sha256"),
        unless(2, F.lit("panel"), F.lit("other")).alias("profile_id"),
        F.lit(True).alias("profile_resolved"),
        kind.alias("kind"),
        unless(3, kind, F.lit("epub")).alias("stated_kind"),
        path.alias("located"),
        unless(4, path, F.lit("/elsewhere")).alias("requested"),
        unless(5, unless(6, sha, other), none).alias("observed_sha256"),
        sha.alias("source_sha256"),
        unless(7, sha, other).alias("baseline_sha256"),
        sha.alias("stated_baseline_sha256"),
        unless(8, version, F.lit("1.22")).alias("api_version"),
        version.alias("stated_api_version"),
        F.when(F.pmod(F.char_length("text"), F.lit(3)) == 0, other).otherwise(sha).alias("repaired_sha256"),
    )
    return W.lineage_check(repairs, "panel").select("doc_id", "reason", "changed")


def _checker_output(spark, folder):
    """A checker's JSON of each document: every ``!`` an error, every ``?`` a warning, every ``%`` fatal, ``;`` usage.

    Spanish documents were checked by nobody, and of French ones whose length is odd the output broke off.
    """
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    marks = F.regexp_extract_all("text", F.lit("[!?%;]"), F.lit(0))
    said = {"!": "ERROR", "?": "WARNING", "%": "FATAL", ";": "USAGE"}
    severity = F.create_map(*[F.lit(x) for pair in said.items() for x in pair])
    message = lambda m, i: F.struct(
        F.concat(F.lit("M-"), m).alias("ID"),
        severity[m].alias("severity"),
        m.alias("message"),
        F.array(F.struct(F.lit("ch.xhtml").alias("path"), i.alias("line"), i.alias("column"))).alias("locations"),
    )
    n = lambda sign: F.regexp_count("text", F.lit(f"[{sign}]")).cast("bigint")
    checker = F.struct(
        F.lit("5.3.0").alias("checkerVersion"), n("%").alias("nFatal"), n("!").alias("nError"), n("?").alias("nWarning"), n(";").alias("nUsage")
    )
    whole = F.to_json(F.struct(checker.alias("checker"), F.transform(marks, message).alias("messages")))
    broken = (F.col("lang") == "fr") & (F.char_length("text") % 2 == 1)
    output = F.when(F.col("lang") == "es", F.lit(None)).when(broken, F.left(whole, F.lit(20))).otherwise(whole)
    return docs.select("doc_id", output.alias("out"))


_SQL_MARKS = """
WITH d AS (SELECT doc_id, text, lang = 'es' OR (lang = 'fr' AND length(text) % 2 = 1) AS lost FROM documents),
m AS (SELECT doc_id, lost, length(text) - length(replace(text, '%', '')) AS fatal, length(text) - length(replace(text, '!', '')) AS error,
  length(text) - length(replace(text, '?', '')) AS warning, length(text) - length(replace(text, ';', '')) AS usage FROM d)"""


@query(
    "conformance_results",
    _SQL_MARKS
    + """ SELECT doc_id, CASE WHEN NOT lost THEN '5.3.0' END AS version, CASE WHEN lost THEN 0 ELSE fatal END AS fatal,
  CASE WHEN lost THEN 0 ELSE error END AS error, CASE WHEN lost THEN 0 ELSE warning END AS warning, CASE WHEN lost THEN 0 ELSE usage END AS usage,
  CASE WHEN NOT lost THEN fatal = 0 AND error = 0 END AS valid FROM m""",
)
def conformance_results(spark, folder):
    """Counts and validity by a checker's output; null where there is no result."""
    return K.conformance(_checker_output(spark, folder), "doc_id", "out")


@query(
    "conformance_severities",
    _SQL_MARKS
    + """ SELECT doc_id, severity, n FROM (SELECT doc_id, unnest(['FATAL', 'ERROR', 'WARNING', 'USAGE']) AS severity,
  unnest([fatal, error, warning, usage]) AS n FROM m WHERE NOT lost) WHERE n > 0""",
)
def conformance_severities(spark, folder):
    """Messages of a checker by severity."""
    return K.severity_counts(K.conformance_messages(_checker_output(spark, folder), "doc_id", "out"), "doc_id")


@query(
    "image_scales",
    """WITH f AS (SELECT user_id, (1 + floor(abs(value) * 30))::BIGINT AS w, (1 + floor(abs(value) * 11) + strlen(event_type) * 100)::BIGINT AS h FROM events),
s AS (SELECT user_id, w, h, least(1.0::DOUBLE, 480.0::DOUBLE / w, 800.0::DOUBLE / h) AS sc FROM f),
p AS (SELECT user_id, ((CASE WHEN sc >= 1 THEN w ELSE greatest(1, floor(w * sc)) END)::BIGINT * 100 // w)::INTEGER AS p FROM s)
SELECT user_id, count(*) AS images, count(*) FILTER (p < 100) AS reduced, min(p) AS minimum,
       list_sort(list(p))[count(*) // 2 + 1] AS median, max(p) AS maximum FROM p GROUP BY user_id""",
)
def image_scales(spark, folder):
    """Each event stands for a picture of some size; how far a panel reduces each user's."""
    size = F.abs("value")
    events = table(spark, folder, "events", "user_id", "value", "event_type").select(
        "user_id",
        (F.floor(size * 30) + 1).alias("w"),
        (F.floor(size * 11) + F.octet_length("event_type") * 100 + 1).alias("h"),
        F.lit(False).alias("cover"),
    )
    scaled = events.withColumn(
        "scale_percent", I.fit_target(F.col("w"), F.col("h"), 480, 800)["scale_percent"]
    )
    return K.image_reduction(scaled, "user_id")


@query(
    "note_mismatches",
    """SELECT user_id, list_filter([CASE WHEN s <> c THEN 'source-count-disagreement' END, CASE WHEN r < c THEN 'missing-references' END,
  CASE WHEN u <> 0 THEN 'unresolved-references' END, CASE WHEN d < c THEN 'shared-note-documents' END], lambda x: x IS NOT NULL) AS disagreements
FROM (SELECT user_id, count(*) AS c, count(DISTINCT event_type) AS d, count(*) FILTER (value > 10) AS r,
             count(*) FILTER (value > 90) AS u, count(props) AS s FROM events GROUP BY user_id)""",
)
def note_mismatches(spark, folder):
    counts = (
        table(spark, folder, "events", "user_id", "event_type", "value", "props")
        .groupBy("user_id", "event_type")
        .agg(
            F.count("*").alias("c"),
            F.count_if(F.col("value") > 10).alias("r"),
            F.count_if(F.col("value") > 90).alias("u"),
            F.count("props").alias("s"),
        )
        .groupBy("user_id")
        .agg(
            F.sum("s").alias("source_notes"),
            F.sum("c").alias("converted_notes"),
            F.sum("r").alias("references"),
            F.sum("u").alias("unresolved_references"),
            F.count("*").alias("note_documents"),
        )
    )
    return V.note_mismatch(counts).select("user_id", "disagreements")


def _event_stream(spark, folder):
    """The events table as a stream of arrivals; a path's digest follows its event type."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    )
    return stream.select(
        F.concat(F.lit("/inbox/"), "user_id").alias("path"),
        F.col("ts").cast("timestamp").alias("modified_at"),
        F.sha2("event_type", 256).alias("sha256"),
        "event_type",
    )


@query(
    "streamed_states",
    """WITH a AS (SELECT '/inbox/' || user_id AS path, ts, sha256(event_type) AS sha256 FROM events),
o AS (SELECT path, row_number() OVER (PARTITION BY path, sha256 ORDER BY ts) AS again,
             row_number() OVER (PARTITION BY path ORDER BY ts, sha256) AS turn FROM a)
SELECT path, CASE WHEN again > 1 THEN 'already-ready' WHEN turn = 1 THEN 'new' ELSE 'changed' END AS state, count(*) AS n
FROM o GROUP BY ALL""",
)
def streamed_states(spark, folder):
    """Path states from the stateful stream, the events arriving as one drained stream."""
    own = spark.newSession()  # the state store is a setting of the stream alone
    own.conf.set("spark.sql.streaming.stateStore.providerClass", A.ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    home = new_folder(spark)
    A.drained(_event_stream(own, folder).withColumnRenamed("modified_at", "arrived_at"), A.path_states, home, A.STATES)
    done = spark.read.schema(A.STATES).parquet(f"{home}/table")
    return done.groupBy("path", "state").agg(F.sum("n").alias("n"))


@query(
    "arrival_states",
    """WITH a AS (SELECT '/inbox/' || user_id AS path, ts, sha256(event_type) AS sha256 FROM events),
o AS (SELECT path, row_number() OVER (PARTITION BY path, sha256 ORDER BY ts) AS again,
             row_number() OVER (PARTITION BY path ORDER BY ts, sha256) AS turn FROM a)
SELECT path, CASE WHEN again > 1 THEN 'already-ready' WHEN turn = 1 THEN 'new' ELSE 'changed' END AS state, count(*) AS n
FROM o GROUP BY ALL""",
)
def arrival_states(spark, folder):
    events = table(spark, folder, "events", "user_id", "ts", "event_type").select(
        F.concat(F.lit("/inbox/"), "user_id").alias("path"),
        F.col("ts").alias("arrived_at"),
        F.sha2("event_type", 256).alias("sha256"),
    )
    return A.path_states_batch(events).groupBy("path", "state").agg(F.sum("n").alias("n"))


COUNTS = T.StructType(
    [
        T.StructField("begin", T.TimestampType()),
        T.StructField("end", T.TimestampType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)


@query(
    "streamed_counts",
    """SELECT 'tumbling' AS kind, time_bucket(INTERVAL 1 HOUR, ts) AS begin, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end",
  event_type, count(*) AS n FROM events GROUP BY ALL
UNION ALL SELECT 'sliding', b, b + INTERVAL 1 HOUR, event_type, count(*) FROM (
  SELECT event_type, time_bucket(INTERVAL 20 MINUTE, ts) - k * INTERVAL 20 MINUTE AS b FROM events, range(3) r(k)) GROUP BY ALL""",
)
def streamed_counts(spark, folder):
    """Arrivals by type per hour, and per hour every twenty minutes, from streams whose every window is closed."""
    kinds = {"tumbling": None, "sliding": "20 minutes"}
    parts = [
        A.drained(
            _event_stream(spark, folder),
            lambda s, slide=slide: A.arrival_counts(s, "event_type", "1 hour", slide),
            new_folder(spark),
            COUNTS,
            past="1 day",
        ).withColumn("kind", F.lit(kind))
        for kind, slide in kinds.items()
    ]
    return parts[0].unionByName(parts[1])


@query(
    "arrival_counts",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begin, event_type, count(*) AS n FROM events GROUP BY ALL""",
)
def arrival_counts(spark, folder):
    events = table(spark, folder, "events", "ts", "event_type")
    counts = A.arrival_counts(events, "event_type", "1 hour", time="ts")
    return counts.select("begin", "event_type", "n")


@query("streamed_first_arrivals", "SELECT DISTINCT '/inbox/' || user_id AS path, sha256(event_type) AS sha256 FROM events")
def streamed_first_arrivals(spark, folder):
    """Which (path, digest) the stream lets through, each once within an hour of event time."""
    schema = T.StructType(
        [
            T.StructField("path", T.StringType()),
            T.StructField("modified_at", T.TimestampType()),
            T.StructField("sha256", T.StringType()),
            T.StructField("event_type", T.StringType()),
        ]
    )
    firsts = A.drained(_event_stream(spark, folder), lambda s: A.first_arrivals(s, "1 hour"), new_folder(spark), schema)
    return firsts.select("path", "sha256").distinct()
