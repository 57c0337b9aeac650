import random

from pyspark.sql import functions as F

from corpusaudit.llm import language

LETTERS = {"en": "thenigosw", "de": "schueinrtz", "fr": "aeouxqlépt", "es": "oascñrdiuj"}


def rows_of(rng, n):
    out = []
    for k in range(n):
        lang = rng.choice(list(LETTERS))
        text = " ".join("".join(rng.choices(LETTERS[lang], k=rng.randint(2, 9))) for _ in range(rng.randint(15, 80)))
        out.append((k, text, lang, "x"))
    return out


def test_held_out_accuracy_and_odd_texts(spark):
    rows = rows_of(random.Random(1), 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.fit(docs.filter("doc_id % 4 != 2"))
    assert set(model.members) == {"germanic", "romance"}
    got = language.identify(docs, model, "text", "doc_id").collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.doc_id % 4 == 2]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    odd = [(1, None), (2, ""), (3, "12 -- 34"), (None, rows[0][1]), (5, rows[0][1]), (5, rows[0][1]), (6, rows[1][1] * 300)]
    docs = spark.createDataFrame([(*r, 0.5) for r in odd], "doc_id long, text string, score double")
    got = {(r.doc_id, r.lang_pred) for r in language.identify(docs, model, "text", "doc_id").collect()}
    a, b = truth[0], truth[1]
    assert got == {(1, "und"), (2, "und"), (3, "und"), (None, a), (5, a), (6, b)}
    kept = language.identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4


def test_the_label_is_no_input(spark):
    rows = rows_of(random.Random(2), 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.fit(docs)
    other = docs.withColumn("lang", F.lit("xx"))
    assert language.identify(docs, model, "text", "doc_id").collect() == language.identify(other, model, "text", "doc_id").collect()


def test_nothing_to_learn_and_one_language(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.fit(docs) is None
    assert [r.lang_pred for r in language.identify(docs, None, "text", "doc_id").collect()] == ["und"]
    model = language.fit(docs.withColumn("lang", F.lit("en")))
    assert [(r.lang_pred, r.score) for r in language.identify(docs, model, "text", "doc_id").collect()] == [("en", 1.0)]
    empty = docs.filter("doc_id < 0")
    assert language.fit(empty) is None and language.identify(empty, model, "text", "doc_id").count() == 0


def test_a_text_with_many_copies_is_one_of_the_sample(spark):
    hot = "one text that fills a third of the table"
    rows = spark.range(60_000).select(
        F.when(F.col("id") < 20_000, F.lit(hot)).otherwise(F.concat(F.lit("text "), "id")).alias("text"),
        F.when(F.col("id") % 50 == 0, F.lit("fr")).otherwise(F.lit("en")).alias("lang"),
    )
    got = {r["lang"]: (r["n"], r["d"]) for r in language.sampled(rows, "text", "lang", 800, 9).groupBy("lang").agg(
        F.count("*").alias("n"), F.count_distinct("text").alias("d")).collect()}
    assert got == {"en": (800, 800), "fr": (800, 800)}


def test_the_number_of_languages_is_bounded(spark):
    rows = spark.range(3000).select(F.concat(F.lit("text "), "id").alias("text"), F.concat(F.lit("l"), F.floor(F.sqrt("id"))).alias("lang"))
    got = language.sampled(rows, "text", "lang", 5, 4).groupBy("lang").count().collect()
    assert len(got) == 4 and all(r["count"] == 5 for r in got)
