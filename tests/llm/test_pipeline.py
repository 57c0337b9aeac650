import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpusaudit.llm import decontamination, jaccard, suffixes
from test_jaccard import brute, shingles

LETTERS = {"en": "thenigos", "de": "schueinr", "fr": "aeouxqlé", "es": "oascñrdi"}


def words(rng, lang, n):
    return " ".join("".join(rng.choices(LETTERS[lang], k=rng.randint(2, 9))) for _ in range(n))


def tables(rng):
    rows, items = [], [(i, words(rng, "en", 30)) for i in range(3)]
    passage = words(rng, "en", 20)
    for k in range(120):
        lang = rng.choice(list(LETTERS))
        text = words(rng, lang, rng.randint(60, 200))
        if k % 9 == 0:
            text += " " + passage
        if k % 17 == 0:
            text += " " + items[k % 3][1].upper() + " " + words(rng, lang, 10)
        rows.append((k, text, lang))
    for k in range(120, 150):
        old = rows[rng.randrange(100)]
        text = old[1].split(" ")
        text[0] = "q" * rng.randint(1, 6)
        rows.append((k, " ".join(text), old[2]))
    rows += [(200, "123 456 -- !!", "en"), (201, None, "en"), (202, "", None)]
    return rows, items


def stage_by_stage(rows, items):
    docs = {k: t for k, t, _ in rows if t and any(map(str.isalpha, t))}
    keep = {c for _, c, *_ in brute(list(docs.items()), 0.8)}
    docs = {k: t.encode() for k, t in docs.items() if k in keep}
    first = {}
    for k, b in docs.items():
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], k), k)
    left = {}
    for k, b in docs.items():
        gone = [i for i in range(len(b) - 49) if first[b[i : i + 50]] < k]
        kept = suffixes.kept_bytes(b, suffixes._union(gone, [i + 50 for i in gone]))
        if kept or not b:
            left[k] = kept.decode("utf-8", "ignore")
    return {k: t for k, t in left.items() if not decontamination.matches(t, tuple(items))}


def write(spark, tmp_path, rows, items):
    docs = spark.createDataFrame(
        [(k, t, x, "s", len(t) if t is not None else None) for k, t, x in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_run_equals_the_stages_by_hand(spark, tmp_path):
    rows, items = tables(random.Random(11))
    folder = write(spark, tmp_path, rows, items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = stage(spark, docs, folder)
        assert docs.columns == before
    want = stage_by_stage(rows, items)
    got = {r.doc_id: r for r in docs.collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        ids[r.doc_id] = ids.get(r.doc_id, 0) + r.length
    assert ids == {k: len(whole.encode(t, add_special_tokens=False).ids) + 1 for k, t in want.items()}
    assert len(shingles(rows[0][1])) > 5


def test_odd_rows_and_empty_tables(spark, tmp_path):
    rows = [(None, None, None), (1, "abc def ghi jkl mno pqr", "en"), (1, "abc def ghi jkl mno pqr", "en"), (2, "x" * 50_000, None)]
    folder = write(spark, tmp_path / "odd", rows, [(1, None)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    assert sorted(r.doc_id for r in docs.collect()) == [1, 2]
    folder = write(spark, tmp_path / "none", [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_columns_that_clash_with_names_inside(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, _row int, _null boolean, _n int, node string, key string, rest int"
    rows = [(i, f"word{i} " * 30, "en", "s", 180, i, True, 3, "n", "k", 7) for i in range(4)]
    rows.append((9, rows[0][1], "en", "s", 180, 5, None, 4, "m", "l", 8))
    docs = spark.createDataFrame(rows, names)
    one = jaccard.one_of_each(docs, 0.8)
    assert one.columns == docs.columns and sorted(map(tuple, one.collect())) == rows[:4]
    kept = suffixes.without_repeats(docs, 50, length="n_chars")
    assert kept.columns == docs.columns
    got = {r.doc_id: (r._row, r._null, r.rest, r.node) for r in kept.collect()}
    assert got == {r[0]: (r[5], r[6], r[10], r[8]) for r in rows[:4]}


def test_keys_of_other_types_are_refused_at_once(spark):
    with pytest.raises(TypeError, match="whole numbers"):
        suffixes.repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
