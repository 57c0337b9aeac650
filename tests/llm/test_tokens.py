import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusaudit.llm import tokens

TEXTS = [
    "Plain words, a few of them.",
    "",
    None,
    "double  spaces\n\n and\ttabs \x1c odd gaps",
    "it's we'll <|endoftext|> <|startoftext|>x",
    "é é ́x 五 12345",
    "word " * 40_000 + "z" * 3000,
    "y" * 50_000,
]


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_counts_equal_whole_encoding(spark, monkeypatch, name, drops):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    rows = [(i, t, "n") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "n"), (None, "null key", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(tokens.token_counts(docs, path, drops_space=drops).collect(), key=str)
    want = [
        (i, len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows
    ]
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: f"Row(doc_id={r[0]}, n_bytes={r[1]}, n_tokens={r[2]})")


def test_empty_table_and_limit(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.token_counts(docs, path).count() == 0
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    marked = tokens.over_limit(tokens.token_counts(docs, path), 2)
    assert marked.first()["over_limit"] is True
