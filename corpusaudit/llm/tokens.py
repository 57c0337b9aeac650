"""Token counts of whole texts."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import rebatched, texts_of
from corpusaudit.llm.encoding import Words, known_words, spaced

#: A text of more bytes than a block is cut, at white space, into pieces of about a block.
BLOCK = 1 << 20


def token_counts(docs: DataFrame, tokenizer: str, key="doc_id", text="text", drops_space=True) -> DataFrame:
    """(key, n_bytes, n_tokens) of each row: the length of each text as the tokenizer gives it.

    Arrow batches are cut into blocks of equal bytes, texts longer than a block at white space, and
    the words of a block are encoded in one batch of which only lengths are kept. ``drops_space``
    says that the tokenizer takes white space only as a gap; otherwise a word carries the one space
    before it, and texts with runs of white space are encoded whole.

    A null text counts as empty and has no tokens. Each row gives one row: repeated rows and null
    keys are kept, an empty table gives an empty one, and other columns are left out.
    """
    kind = dict(docs.dtypes)[key]

    def count(batches):
        lengths = known_words(tokenizer, len)
        for batch in rebatched(batches, text, BLOCK):
            body, at = texts_of(batch.column(text))
            data = body.tobytes()
            sizes = np.diff(at)
            split = [
                [_words(part, drops_space) for part in _parts(data[at[i] : at[i + 1]])]
                for i in range(batch.num_rows)
            ]
            lengths.learn(w for parts in split for words in parts if type(words) is list for w in words)
            totals = [sum(_length(words, lengths) for words in parts) for parts in split]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())],
                names=[key, "n_bytes", "n_tokens"],
            )

    return docs.select(key, text).mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long")


def _parts(text: bytes):
    """Pieces of about a block, cut before an ASCII space that stands alone."""
    start = 0
    while len(text) - start > BLOCK:
        cut = text.find(b" ", start + BLOCK)
        while cut > 0 and (text[cut - 1] <= 0x20 or text[cut + 1 : cut + 2] <= b" "):
            cut = text.find(b" ", cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


def _words(text: bytes, drops_space: bool) -> list[bytes] | bytes:
    """The words of a piece, or the piece itself where it must be encoded whole."""
    if drops_space:
        return text.split()
    words = spaced(text)
    return text if words is None else words


def _length(words: list[bytes] | bytes, lengths: Words) -> int:
    if type(words) is bytes:
        return len(lengths.tokenizer.encode(words.decode("utf-8"), add_special_tokens=False).ids)
    return sum(map(lengths.__getitem__, words))


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    """Mark the rows with more than ``limit`` tokens."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
