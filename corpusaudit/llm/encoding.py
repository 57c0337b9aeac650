"""Encoding of many texts: by their distinct words, or by a byte-pair engine of the same ranks."""

import base64
import functools
import os
import re
from collections.abc import Callable, Iterable

import numpy as np
from tokenizers import Tokenizer


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer of each file in each worker process; Spark's tasks are the parallel part."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


class Words(dict):
    """Encoded words, filled by batches. Of the words not met lately half go when it is full."""

    def __init__(self, path: str, keep: Callable, most: int):
        self.tokenizer, self.keep, self.most, self.older = tokenizer(path), keep, most, {}

    def learn(self, words: Iterable[bytes]) -> None:
        """Make sure that all these words are here."""
        words = set(words)
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most // 2:
            self.older = dict(self)
            self.clear()
            new = list(words)
        older = self.older
        self.update((w, older[w]) for w in new if w in older)
        new = [w for w in new if w not in self]
        for start in range(0, len(new), 10_000):
            part = new[start : start + 10_000]
            texts = [w.decode("utf-8") for w in part]
            done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            self.update((w, self.keep(e.ids)) for w, e in zip(part, done, strict=True))


@functools.cache
def known_words(path: str, keep: Callable, most: int = 300_000) -> Words:
    """The words of a worker process, which its next tasks find there."""
    return Words(path, keep, most)


#: White space that may stand inside a run, where a cut before a space would not be safe.
UNSAFE = (
    *(b" " + bytes([c]) for c in (9, 10, 11, 12, 13, 32)),
    *(bytes([c]) for c in range(0x1C, 0x20)),
    *(b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"),
)


def spaced(text: bytes) -> list[bytes] | None:
    """Pieces of a text for tokenizers that put one space at the front of a word.

    The cut before a single space is where such a tokenizer cuts anyway. None: the text holds runs
    of white space, and is to be encoded whole.
    """
    if any(x in text for x in UNSAFE):
        return None
    first, *rest = text.split(b" ")
    return [first, *[b" " + w for w in rest]]


#: Characters of Latin scripts, signs and controls, on which both engines cut words alike.
LATIN = re.compile(r"[\x00-\u024f]*\Z")


class ByteEncoder:
    """Ids of whole texts as the tokenizer gives them, little-endian unsigned 32-bit.

    With ``ranks``, a file of the tokenizer's own merges, texts of Latin characters without special
    strings go to an engine that is several times faster; all others go to the tokenizer.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        self.tokenizer = tokenizer(path)
        self.special = list(map(str, (t.content for t in self.tokenizer.get_added_tokens_decoder().values())))
        self.engine = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.engine = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.engine is not None and LATIN.match(text) and not any(s in text for s in self.special):
            return self.engine.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@functools.cache
def byte_encoder(path: str, ranks: str | None, pattern: str | None) -> ByteEncoder:
    """One encoder in each worker process."""
    return ByteEncoder(path, ranks, pattern)
