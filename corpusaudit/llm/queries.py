"""The registered query of each operator, and its SQL where SQL can express it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit.llm import (
    bpe,
    centroids,
    decontamination,
    jaccard,
    language,
    lexical,
    line_rules,
    maxent,
    packing,
    sharding,
    suffixes,
    tokens,
    toxicity,
)
from corpusaudit.llm.common import crc_rest, documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 16
SEED = 17
TOKEN_LIMIT = 2048
END_ID = 2
CAPACITY = 1024


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_ranks() -> dict[str, str]:
    """Merges and pattern of the byte-level tokenizer, for the faster engine."""
    import public_tokenizers

    return {"ranks": vocabulary("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def _shard_sql() -> str:
    steps = []
    for i, (x, y) in enumerate(sharding.constants(SEED)):
        mix = (
            f"(((({{v}} + {x}) % {sharding.PRIME}) * (({{v}} + {x}) % {sharding.PRIME}) % {sharding.PRIME})"
            f" * ((({{v}} + {x}) % {sharding.PRIME} + {y}) % {sharding.PRIME}) % {sharding.PRIME})"
        )
        if i % 2 == 0:
            steps.append(f"(l + {mix.format(v='r')}) % a AS l, r")
        else:
            steps.append(f"l, (r + {mix.format(v='l')}) % b AS r")
    once = "SELECT number, n, a, b, step + 1 AS step, place % a AS l, place // a AS r FROM walk WHERE place >= n OR step = 0"
    for s in steps:
        once = f"SELECT number, n, a, b, step, {s} FROM ({once})"
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT i, list_reduce(range(0, 9), lambda c, k: CASE WHEN k = 0 THEN c ELSE xor(c >> 1, (c & 1) * 3988292384) END, i) AS t
  FROM range(256) r(i)),
tab AS (SELECT list(t ORDER BY i) AS t FROM crc_table),
rows0 AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size,
         xor(list_reduce(list_transform(range(1, strlen(coalesce(text, '')) + 1),
               lambda i: ('0x' || substr(hx, 2 * i - 1, 2))::BIGINT),
             lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS hx FROM documents), tab),
nums AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS number, count(*) OVER () AS n FROM rows0),
total AS (SELECT greatest(max(n), 1) AS n FROM nums),
root AS (SELECT n, greatest(1, floor(sqrt(greatest(n - 1, 0)))::BIGINT + 1) AS root FROM total),
side AS (
  SELECT n, a, CEIL(n / a)::BIGINT AS b FROM (
    SELECT n, root, unnest(range(greatest(1, root // 2), 2 * root + 1)) AS a FROM root)
  ORDER BY (a - n % a) % a, abs(a - root), a LIMIT 1),
walk AS (
  SELECT number, side.n AS n, a, b, 0 AS step, number AS place FROM nums, side
  UNION ALL
  SELECT number, n, a, b, step, r * a + l AS place FROM ({once}))
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % {SHARDS})::INT AS shard, place // {SHARDS} AS slot,
       NULL::INT AS grown_shard
FROM nums JOIN (SELECT number, place FROM walk WHERE place < n AND step > 0) w USING (number)
"""


@query(
    "op4_feistel_shards",
    _shard_sql(),
)
def op4(spark, folder):
    """Shard and slot of every document."""
    return sharding.shard_rows(documents(spark, folder, "doc_id", "text"), SHARDS, SEED)


@query("op9_token_counts")
def op9(spark, folder):
    """Bytes and tokens of every document, and whether it is over the limit."""
    docs = documents(spark, folder, "doc_id", "text")
    return tokens.over_limit(tokens.token_counts(docs, vocabulary("word_bpe_49k.json")), TOKEN_LIMIT)


@query(
    "op10_line_frequency_rules",
    r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
base AS (
  SELECT doc_id, source, text, ls, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
         len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         w FROM docs),
windows AS (
  SELECT doc_id, i, w[i:i + 4] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)),
twice AS (SELECT doc_id, win FROM windows GROUP BY ALL HAVING count(*) > 1),
places AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN twice USING (doc_id, win), range(5) t(k)),
repeats AS (SELECT doc_id, count(*) AS n FROM places GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, text, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
         trim(regexp_replace(regexp_replace(lower(l), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, source, text, unnest(ls) AS l FROM base)),
hosts AS (SELECT source, count(DISTINCT text) AS texts FROM base WHERE len(ls) > 0 GROUP BY source),
often AS (
  SELECT l.source, line FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, line, texts HAVING count(DISTINCT text) > 20 AND count(DISTINCT text) > 0.02 * texts),
gone AS (
  SELECT doc_id, sum(n) AS n FROM lines l JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.line = o.line
  GROUP BY doc_id)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 10 AND n_removed_words <= 0.5 * n_words AS kept FROM (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         coalesce(g.n, 0)::BIGINT AS n_removed_words, n_words < 10 OR 100 * coalesce(r.n, 0) > 20 * n_words AS base_failed
  FROM base LEFT JOIN repeats r USING (doc_id) LEFT JOIN gone g USING (doc_id))
""",
)
def op10(spark, folder):
    """Base measures and the verdict of the line rules for every document."""
    return line_rules.line_rules(documents(spark, folder, "doc_id", "text", "source"))


@query("op3_benchmark_leaks")
def op3(spark, folder):
    """Benchmark items that documents hold, up to a tenth of their characters edited."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontamination.leaks(documents(spark, folder, "doc_id", "text"), items)


@query("op5_best_fit_packing")
def op5(spark, folder):
    """Sequence and place of every piece of every document."""
    docs = documents(spark, folder, "doc_id", "text")
    return packing.packed_documents(docs, vocabulary("byte_bpe_50k.json"), END_ID, CAPACITY, **byte_ranks())


@query("op7_language")
def op7(spark, folder):
    """Language of every document, learned from three quarters of them."""
    docs = documents(spark, folder, "doc_id", "text", "lang")
    held_out = crc_rest(F.col("doc_id"), 4) == 2
    model = language.fit(docs.filter(~held_out))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return language.identify(rows, model, "text", "doc_id", "held_out")


@query("op8_toxicity")
def op8(spark, folder):
    """Toxicity of every document, learned from four fifths of the labels."""
    docs = documents(spark, folder, "doc_id", "text")
    held_out = crc_rest(F.col("doc_id"), 5) == 0
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(~held_out)
    model = toxicity.fit(docs.filter(~held_out), labels)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return toxicity.toxicity(rows, model, "text", "doc_id", "held_out")


@query(
    "op6_repeated_passages",
    """
WITH raw AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
docs AS (SELECT doc_id, strlen(text) AS n, hex(encode(text)) AS hx FROM raw),
strings AS (SELECT doc_id, i, substr(hx, 2 * i + 1, 100) AS s FROM (SELECT doc_id, hx, unnest(range(n - 49)) AS i FROM docs)),
firsts AS (SELECT s, min(doc_id) AS first FROM strings GROUP BY s),
gone AS (SELECT doc_id, i FROM strings JOIN firsts USING (s) WHERE first < doc_id),
marked AS (
  SELECT doc_id, i, CASE WHEN i <= 50 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM gone),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
kept AS (
  SELECT doc_id, string_agg(substr(hx, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS hx FROM (
    SELECT doc_id, hx, coalesce(lag(s.b) OVER w, 0) AS a, s.a AS b FROM spans s JOIN docs USING (doc_id)
    WINDOW w AS (PARTITION BY doc_id ORDER BY s.a)
    UNION ALL
    SELECT doc_id, any_value(hx), max(s.b), any_value(n) FROM spans s JOIN docs USING (doc_id) GROUP BY doc_id)
  GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k.hx, d.hx))) AS kept_sha256
FROM docs d LEFT JOIN sums USING (doc_id) LEFT JOIN kept k USING (doc_id)
""",
)
def op6(spark, folder):
    """What every document loses to earlier ones, and a digest of what is left."""
    found = suffixes.repeats(documents(spark, folder, "doc_id", "text"), 50)
    removed = F.reduce("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op2_near_duplicate_join")
def op2(spark, folder):
    """Class, copies and links of every document at Jaccard 0.8 of five-word shingles."""
    return jaccard.near_duplicates(documents(spark, folder, "doc_id", "text"), 0.8)


@query("op1_maxent_scores")
def op1(spark, folder):
    """Log probability of every document, learned from six sevenths of them."""
    held_out = crc_rest(F.col("doc_id"), 7) == 2
    return maxent.scored(documents(spark, folder, "doc_id", "text"), held_out, whole_words=True)


@query("op11_segment_tree_bpe")
def op11(spark, folder):
    """Tokens of every document, and digests of its ids and of the text that they decode to."""
    path = vocabulary("byte_bpe_50k.json")
    ids = bpe.encoded(documents(spark, folder, "doc_id", "text"), path)
    return bpe.decoded(ids, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.ids_digest("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op12_ranked_search",
    r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS size FROM words GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(size)::BIGINT AS tokens FROM sizes),
hits AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM hits, corpus GROUP BY term),
scores AS (
  SELECT item_id, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * size * docs) // tokens))))::BIGINT AS score
  FROM asked JOIN hits USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), corpus GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
""",
)
def op12(spark, folder):
    """The ten documents that answer each benchmark item best."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return lexical.ranked(lexical.index(documents(spark, folder, "doc_id", "text")), items, 10)


def _clusters_sql() -> str:
    assigned = """
  SELECT row, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM (
    SELECT v.row, k.c, sum((v.x - k.x) * (v.x - k.x))::BIGINT AS d FROM flat v JOIN c{r} k USING (i) GROUP BY v.row, k.c) GROUP BY row"""
    steps = []
    for r in range(10):
        steps.append(f"a{r} AS MATERIALIZED ({assigned.format(r=r)})")
        steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT k.c, k.i, coalesce(m.x, k.x) AS x FROM c{r} k LEFT JOIN (
    SELECT a.c, v.i, ((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
    FROM a{r} a JOIN flat v USING (row) GROUP BY a.c, v.i) m USING (c, i))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
flat AS MATERIALIZED (SELECT row, unnest(range(1, 65)) AS i, unnest(v) AS x FROM kept),
first AS (SELECT row, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), v) - 1 AS c FROM kept),
c0 AS MATERIALIZED (SELECT c, i, x FROM first JOIN flat USING (row) WHERE c < 8),
{", ".join(steps)},
final AS MATERIALIZED ({assigned.format(r=10)}),
digests AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c10 GROUP BY c)
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM final JOIN kept USING (row) JOIN digests USING (c)
"""


@query("op13_pivot_clusters", _clusters_sql())
def op13(spark, folder):
    """Cluster of every vector after ten rounds, with its distance and the figures of its cluster."""
    return centroids.with_figures(*centroids.clustered(spark.read.parquet(f"{folder}/embeddings.parquet")))
