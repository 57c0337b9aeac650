"""Quality rules: what repeats inside a text, and lines that a whole host repeats."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import WORD_GAP

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` has it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def repeated_words(found: Column) -> Column:
    """How many words stand in a five-word window that the text holds twice or more.

    Windows are told apart by 64-bit hashes within one text.
    """

    def windows(w: Column) -> Column:
        each = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), each)

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            same = lambda a, b: F.get(p, a)["h"] == F.get(p, b)["h"]
            twice = F.filter(
                p, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))
            )
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda s, i: F.struct(
            (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")
        )
        return F.reduce(bound(pairs, places), start, step, lambda s: s["n"])

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    inside = bound(found, lambda w: F.when(F.size(w) > WINDOW, bound(windows(w), count)).otherwise(F.lit(0)))
    return inside.cast("long")


def base_measures(text: Column) -> dict[str, Column]:
    """The measures of one text; a null text has none of anything."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words(text)).cast("long"),
        "word_chars": (
            F.char_length(text) - F.char_length(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", ""))
        ).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words(text)),
    }


def normal_line(line: Column) -> Column:
    """A line as it is counted: lower case, digits as 0, one space between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), WORD_GAP, " "))


def frequent_lines(lines: DataFrame, least: int, share: float) -> DataFrame:
    """(host, line) of lines that more than ``share`` of a host's texts hold, and over ``least``.

    ``lines`` has host, line and document. Distinct documents are counted in two steps, each summed
    before it is shuffled, so a line or a host that a third of all rows have is no hot key.
    """
    once = lines.groupBy("host", "line", "document").agg(F.lit(1).alias("one"))
    held = once.groupBy("host", "line").agg(F.count("*").alias("held"))
    hosts = lines.select("host", "document").groupBy("host", "document").agg(F.lit(1).alias("one"))
    totals = hosts.groupBy("host").agg(F.count("*").alias("texts"))
    over = held.filter(F.col("held") > least).join(totals, held["host"].eqNullSafe(totals["host"]))
    return over.filter(F.col("held") > share * F.col("texts")).select(held["host"].alias("host"), "line")


def line_rules(
    docs: DataFrame, key="doc_id", text="text", host="source", least: int = 20, share: float = 0.02, depleted: float = 0.5
) -> DataFrame:
    """(key, measures, n_removed_words, base_failed, kept) of each row.

    Lines are normalised and hashed; a line that more than ``share`` of the host's different texts
    hold, and more than ``least`` of them, is removed from all of them. Copies of one text count
    once, so a group of copies cannot make its own lines frequent. A document is rejected if it
    fails the base rules, if over ``depleted`` of its words went with such lines, or if fewer than
    10 words stay.

    A null text has no words and fails the base rules; a null host is a host of its own; repeated
    rows each give their row; an empty table gives an empty one; other columns are left out.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("id"), F.col(host).cast("string").alias("host"), raw.alias("body"), F.xxhash64(raw).alias("document")
    )
    base = rows.select("id", "host", "document", *[c.alias(n) for n, c in base_measures(F.col("body")).items()])
    lines = (
        rows.select("id", "host", "document", F.posexplode(F.split("body", "\n")).alias("at", "raw_line"))
        .withColumn("n", F.size(words(F.col("raw_line"))))
        .filter("n > 0")
        .select("id", "host", "document", "at", "n", F.xxhash64(normal_line(F.col("raw_line"))).alias("line"))
    )
    often = frequent_lines(lines, least, share).select(F.col("host").alias("often_host"), F.col("line").alias("often_line"))
    gone = (
        lines.join(often, F.col("host").eqNullSafe(F.col("often_host")) & (F.col("line") == F.col("often_line")))
        .groupBy("id", "host", "document", "at")  # repeated rows are one here; the join below gives each its own
        .agg(F.max("n").alias("n"))
        .groupBy(F.col("id").alias("gone_id"), F.col("host").alias("gone_host"), F.col("document").alias("gone_document"))
        .agg(F.sum("n").alias("gone"))
    )
    joined = base.join(
        gone,
        base["id"].eqNullSafe(gone["gone_id"])
        & base["host"].eqNullSafe(gone["gone_host"])
        & (base["document"] == gone["gone_document"]),
        "left",
    )
    removed = F.coalesce(F.col("gone"), F.lit(0)).cast("long")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stays = F.col("n_words") - F.col("n_removed_words")
    kept = ~failed & (stays >= 10) & (F.col("n_removed_words") <= depleted * F.col("n_words"))
    return (
        joined.withColumn("n_removed_words", removed)
        .select(
            F.col("id").alias(key),
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "n_removed_words",
            failed.alias("base_failed"),
            kept.alias("kept"),
        )
    )
