import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corpusaudit.llm import packing
from corpusaudit.llm.encoding import ByteEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_plan_uses_every_piece_once_and_is_tight():
    rng = random.Random(5)
    for spread in ((1, 1024), (300, 700), (900, 1024), (1, 5), (500, 520)):
        counts = np.zeros(1025, np.int64)
        for _ in range(5000):
            counts[rng.randint(*spread)] += 1
        used = np.zeros(1025, np.int64)
        n = 0
        for pattern, k in packing.planned(counts, 1024):
            assert sum(pattern) <= 1024 and k > 0
            n += k
            for x in pattern:
                used[x] += k
        assert (used == counts).all()
        total = int((counts * np.arange(1025)).sum())
        lowest = max(-(-total // 1024), int(counts[513:].sum()))
        assert n <= lowest * 1.02 + 1


def check(spark, docs, rows):
    ranks = {"ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    got = packing.packed_documents(docs, PATH, 2, 1024, **ranks).collect()
    whole = Tokenizer.from_file(PATH)
    by, pieces = {}, {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    for doc, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted(pieces[doc], key=lambda r: r.start)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert all(r.length == 1024 for r in mine[1:]) and sum(r.length for r in mine) == len(ids)
        assert len(mine) == -(-len(ids) // 1024)
        for r in mine:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert zlib.crc32(part) == r.ids_crc32
    return got


def test_documents_pack_exactly(spark):
    rng = random.Random(1)
    words = ["alpha", "be", "gamma's", "12", "é", "Delta,", "x\n", " ", "<|endoftext|>"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 300, 900, 4000])))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "no key")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, length int")
    check(spark, docs, rows)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "same row")] * 3, "doc_id long, text string")
    got = packing.packed_documents(docs, PATH, 2, 1024).collect()
    assert len(got) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed_documents(empty, PATH, 2, 1024).count() == 0


def test_both_engines_give_the_same_ids():
    fast = ByteEncoder(PATH, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    slow = ByteEncoder(PATH)
    rng = random.Random(7)
    alphabet = [chr(i) for i in range(0x250)] + list("  \n\n''stremdv0123456789 abcdefghij")
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 200))) for _ in range(3000)]
    texts += ["a <|endoftext|> b", "x" * 30_000, " " * 5000, "五 \u2003 ́é", "\u1680", "it's they'LL I've"]
    assert fast.engine is not None
    for t in texts:
        assert fast(t) == slow(t), repr(t)
