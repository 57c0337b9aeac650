import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusaudit.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None,
    "",
    " ",
    "it's we'll  double\n\n gaps\t \x1c\x85",
    "<|endoftext|> x<|endoftext|><|endoftext|>",
    "é é 漢字 ٣² Ⅷ \U0001f600 ՘",
    "ꟋǄ \U00016ff6 \U0003fc3f",
    "a" * 3000 + " b",
    "".join(random.Random(1).choices("abcdefgh", k=20_000)),
    "word " * 9000,
]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def test_ids_and_texts_equal_the_library(spark, whole):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(0, ODD[3], "y"), (None, "null key", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decoded(bpe.encoded(docs, PATH), PATH).collect()
    want = []
    for key, text, _ in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids
        want.append((key, ids, whole.decode(ids, skip_special_tokens=False)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert all(said == (text or "") for (_, text, _), (_, _, said) in zip(rows, want, strict=True))


def test_random_texts(whole):
    rng = random.Random(7)
    signs = [*"ab 'AB \n\t　éß漢字٣²Ⅷ", "\U0001f600", "\U0001e900", "<|endoftext|>", "'ll", "'re", "ing", " the"]
    encode = bpe.Encoder(PATH)
    texts = []
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randrange(40)))
        texts.append(text)
    for start in range(0, len(texts), 100):
        part = texts[start : start + 100]
        for text, ids in zip(part, encode(part), strict=True):
            assert memoryview(ids).cast("i").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_tree_gives_the_merges_of_a_plain_search():
    merges = bpe.Merges(PATH)
    rng = random.Random(3)
    for _ in range(300):
        word = bytes(rng.choices(b"aeinrst h\xc3\xa9", k=rng.randrange(1, 40)))
        ids = [merges.alphabet[b] for b in word]
        while True:
            ranks = [merges.rank.get(p, 1 << 40) for p in zip(ids, ids[1:])]
            if not ranks or min(ranks) == 1 << 40:
                break
            i = ranks.index(min(ranks))
            ids[i : i + 2] = [merges.made[ranks[i]]]
        assert merges.encode(word).tolist() == ids
        assert memoryview(merges.encode_many([word, b"the", word * 9])[0]).cast("i").tolist() == ids


def test_words_leave_the_memory_and_come_back(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 8)
    encode = bpe.Encoder(PATH)
    texts = [f"one two{i} three four{i % 3} five" for i in range(40)]
    fresh = bpe.Encoder(PATH)(texts)
    assert [encode([t])[0] for t in texts] == fresh
    assert len(encode.known) + len(encode.older) <= 16


def test_decoding_odd_ids(spark):
    rows = spark.createDataFrame(
        [(1, None, 0.5), (2, [], 0.5), (3, [-1, 10**6, None, 39], 0.5), (4, [162, 162], 0.5)],
        "doc_id long, ids array<int>, decoded double",
    )
    got = {r.doc_id: r.decoded for r in bpe.decoded(rows, PATH).collect()}
    assert got == {1: None, 2: "", 3: "H", 4: "��"}


def test_empty_table_and_digest(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decoded(bpe.encoded(empty, PATH), PATH).collect() == []
    rows = spark.createDataFrame([([1, 22, 333],), ([],)], "ids array<int>")
    got = [r[0] for r in rows.select(bpe.ids_digest("ids")).collect()]
    assert got == [hashlib.sha256(x).hexdigest() for x in (b"1,22,333", b"")]


def test_the_query_over_its_table(spark, whole):
    from corpusaudit.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op11_segment_tree_bpe"](spark, folder).collect()}
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        ids = whole.encode(text, add_special_tokens=False).ids
        said = whole.decode(ids, skip_special_tokens=False)
        assert got[key].n_tokens == len(ids)
        assert got[key].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[key].decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Merges(public_tokenizers.path("word_bpe_49k.json"))


def test_no_column_is_lost_or_mixed_up(spark):
    docs = spark.createDataFrame([("k", "some words", 1)], "name string, body string, doc_id int")
    got = bpe.encoded(docs, PATH, "name", "body").withColumn("text", F.lit(3))
    assert bpe.decoded(got, PATH, text="again").collect()[0].asDict() == {"name": "k", "ids": [11246, 2456], "text": 3, "again": "some words"}
