from corpusaudit.llm import line_rules

GAP = " \t\n\x0b\f\r"


def words_of(text):
    for c in GAP:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(text):
    text = text or ""
    w = words_of(text)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return (
        len(w),
        sum(map(len, w)),
        sum(c in line_rules.SYMBOLS for c in text),
        len(lines) - len(set(lines)),
        len(hit),
    )


def test_measures_equal_brute_force(spark):
    texts = [
        None,
        "",
        " \t\n",
        "one two three four five",
        "a b c d e f a b c d e f",
        "x x x x x x x x",
        "l1 has words\nl1 has words\n\n \nl1 has words ",
        "é|ü #tag $5 & <b> 100%",
        "  no break space\x1c",
        "p q r s t " * 300 + "end",
    ]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in line_rules.line_rules(docs).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == brute(texts[r.doc_id]), texts[r.doc_id]


def test_frequent_lines_deplete(spark):
    own = "own words number {0} a{0} b{0} c{0} d{0} e{0} f{0} g{0} h{0} i{0} j{0}"
    boiler = "Subscribe NOW to our  news letter 2024 and read all of it for free"
    rows = [(i, boiler.replace("2024", str(2000 + i)) + "\n" + own.format(i), "big", 1) for i in range(40)]
    rows += [(100 + i, boiler + "\nshort " + str(i), "big", 1) for i in range(5)]
    rows += [(200 + i, boiler + "\n" + own.format("z" + str(i)), "small", 1) for i in range(3)]
    copy = " ".join(f"w{k}" for k in range(30))
    rows += [(300 + i, copy, "big", 1) for i in range(200)]
    rows += [(None, own.format("n"), None, 1), (5, rows[5][1], "big", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int")
    got = line_rules.line_rules(docs, least=20, share=0.02).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    removed = {r.doc_id: r.n_removed_words for r in got}
    assert all(not kept[100 + i] for i in range(5))
    assert removed[5] == 14 and removed[201] == 0 and kept[201] and kept[300] and kept[None]
    assert not any(kept[i] is None for i in kept)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_rules.line_rules(docs).count() == 0
