import random

from corpusaudit.llm import decontamination as d


def distance_within(pattern, text):
    """Plain dynamic programming: the least distance of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j - 1] + (p != t), last[j] + 1, row[j - 1] + 1))
    return min(row)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        what = rng.choice("sid")
        if what == "s":
            out[i] = rng.choice("abcdefgh ")
        elif what == "i":
            out.insert(i, rng.choice("abcdefgh "))
        else:
            del out[i]
    return "".join(out)


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def test_matches_equal_brute_force():
    rng = random.Random(2)
    items = tuple((i, sentence(rng, rng.randint(6, 30))) for i in range(12))
    for trial in range(150):
        k = rng.randrange(len(items))
        budget = len(items[k][1]) // d.EDIT_EVERY
        inside = edited(rng, items[k][1], rng.randint(0, budget + 2))
        text = sentence(rng, rng.randint(0, 30)) + " " + inside.upper() + " " + sentence(rng, rng.randint(0, 30))
        got = {m[0]: m for m in d.matches(text, items)}
        for name, item in items:
            least = distance_within(item, text.lower())
            if least <= len(item) // d.EDIT_EVERY:
                assert got[name][1] == least, (trial, name)
                _, _, start, end = got[name]
                assert distance_within(text.lower()[start:end], item) <= least
                assert distance_within(item, text.lower()[start:end]) == least
            else:
                assert name not in got


def test_rows_and_edges(spark):
    item = "The quick brown fox jumps over the lazy dog and runs away from it."
    rows = [
        (1, "Intro. " + item + " End.", "e"),
        (2, "Intro. " + item.upper().replace(" ", "\n") + " " + "long " * 30_000, "e"),
        (3, "nothing here", "e"),
        (4, None, "e"),
        (5, "", None),
        (1, "Intro. " + item + " End.", "e"),
        (None, item.replace("quick", "quiet"), "e"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    items = spark.createDataFrame(
        [(7, item), (7, item), (8, None), (9, ""), (10, "short")], "item_id long, text string"
    )
    got = sorted([(r.doc_id, r.item_id, r.distance) for r in d.leaks(docs.drop("item_id"), items).collect()], key=str)
    assert got == sorted([(1, 7, 0), (1, 7, 0), (2, 7, 0), (None, 7, 2)], key=str)
    left = d.without_leaks(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5]


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK", 60)
    rng = random.Random(4)
    items = [(i, sentence(rng, 10)) for i in range(5)]
    docs = spark.createDataFrame([(i, "pad " + t + " pad") for i, t in items] + [(9, "pad pad")], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in d.leaks(docs, table).collect()) == [(i, i) for i in range(5)]
    assert [r.doc_id for r in d.without_leaks(docs, table).collect()] == [9]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a text of some length, longer than least")], "doc_id long, text string")
    assert d.leaks(docs, items).count() == 0 and d.leaks(some, items).count() == 0
    assert d.without_leaks(some, items).count() == 1
