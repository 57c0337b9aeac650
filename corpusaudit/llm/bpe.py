"""Byte-pair encoding and decoding of whole texts by a segment tree over the ranks of adjacent pairs."""

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import rebatched, release
from corpusaudit.llm.encoding import tokenizer

#: Texts are taken in blocks of about so many bytes.
BLOCK = 1 << 22
#: Words of so many bytes at most have their trees side by side and are remembered, so many words in a worker process.
SHORT_BYTES, KNOWN_WORDS = 64, 400_000
#: Trees that stand side by side.
TREES = 4_000


class Merges:
    """Vocabulary, merges and special strings of a byte-level tokenizer's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        model = stated["model"]
        cut = stated["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(
            model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        )
        bytewise = cut["type"] == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]
        special = stated["added_tokens"]
        if not (plain and bytewise and stated["normalizer"] is None) or any(
            t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in special
        ):
            raise ValueError(f"{path}: not a plain byte-level byte-pair tokenizer")
        vocabulary = model["vocab"]
        signs = byte_signs()
        self.alphabet = [vocabulary[signs[b]] for b in range(256)]
        #: Rank of each pair of ids, and the id that the merge of each rank makes.
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocabulary[left], vocabulary[right]] = len(self.made)
            self.made.append(vocabulary[left + right])
        self.special = {t["content"]: t["id"] for t in special}
        codes = np.array([self._code(*pair) for pair in self.rank], np.int64)
        self._order = np.argsort(codes)
        self._codes = codes[self._order]
        self._alphabet, self._made = np.array(self.alphabet, np.int32), np.array(self.made, np.int32)
        byte_of = {sign: b for b, sign in signs.items()}
        self.bytes_of = {i: bytes(map(byte_of.__getitem__, word)) for word, i in vocabulary.items()}
        # A special string decodes like any other token: by the bytes of its signs, if it has only such.
        for word, i in self.special.items():
            known = all(c in byte_of for c in word)
            self.bytes_of[i] = bytes(map(byte_of.__getitem__, word)) if known else word.encode("utf-8")

    @staticmethod
    def _code(left, right):
        return (left << 32) | right

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; one more than the last where there is no merge."""
        code = self._code(left.astype(np.int64), right)
        place = np.minimum(np.searchsorted(self._codes, code), len(self._codes) - 1)
        return np.where(self._codes[place] == code, self._order[place], len(self.made))

    def encode_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as 32-bit numbers, of short words many trees at a time."""
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        size = 2
        for i in np.flatnonzero(sizes > SHORT_BYTES):
            out[i] = self.encode(words[i]).tobytes()
        while size <= SHORT_BYTES:
            mine = np.flatnonzero((sizes > size // 2) & (sizes <= size) if size > 2 else sizes <= 2)
            for start in range(0, len(mine), TREES):
                part = mine[start : start + TREES]
                for i, ids in zip(part, self._side_by_side([words[i] for i in part], size), strict=True):
                    out[i] = ids
            size *= 2
        return out

    def _side_by_side(self, words: list[bytes], size: int) -> list[bytes]:
        """``encode`` of words of at most ``size`` bytes: a row for each word in every array."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        place = np.arange(size)
        inside = place < n[:, None]
        ids = np.full((len(words), size), -1, np.int32)
        ids[inside] = self._alphabet[np.frombuffer(b"".join(words), np.uint8)]
        following = np.where(place + 1 < n[:, None], place + 1, size)
        before = np.broadcast_to(place - 1, ids.shape).copy()
        none = len(self.made) * size
        tree = [np.full(ids.shape, none, np.int64)]
        pairs = place[:-1] + 1 < n[:, None]
        at, first = np.nonzero(pairs)
        tree[0][at, first] = np.minimum(self._ranks(ids[at, first], ids[at, first + 1]) * size + first, none)
        while tree[-1].shape[1] > 1:
            tree.append(np.minimum(tree[-1][:, ::2], tree[-1][:, 1::2]))
        row = np.arange(len(words))
        while True:
            top = tree[-1][row, 0]
            row, top = row[top < none], top[top < none]
            if not len(row):
                break
            i = top % size
            gone = following[row, i]
            after = following[row, gone]
            new = self._made[top // size]
            ids[row, i], ids[row, gone] = new, -1
            following[row, i] = after
            tree[0][row, gone] = tree[0][row, i] = none
            on = np.flatnonzero(after < size)
            r, a = row[on], after[on]
            before[r, a] = i[on]
            tree[0][r, i[on]] = np.minimum(self._ranks(new[on], ids[r, a]) * size + i[on], none)
            left = before[row, i]
            on = np.flatnonzero(left >= 0)
            r, a = row[on], left[on]
            tree[0][r, a] = np.minimum(self._ranks(ids[r, a], new[on]) * size + a, none)
            # Up from the three leaves to the root.
            for lower, upper in zip(tree, tree[1:]):
                i, gone, left = i >> 1, gone >> 1, np.maximum(left, 0) >> 1
                for node in (gone, i, left):
                    upper[row, node] = np.minimum(lower[row, 2 * node], lower[row, 2 * node + 1])
        kept = ids >= 0
        body = ids[kept].tobytes()
        ends = (4 * np.cumsum(kept.sum(1))).tolist()
        return [body[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, word: bytes) -> np.ndarray:
        """Ids of one word: always the leftmost of the pairs of lowest rank is merged.

        Leaf ``i`` of the tree is (rank, place) of the pair that starts at symbol ``i``, an inner
        node the least of its two, so the root is the next merge. A merge changes three leaves.
        """
        ids = [self.alphabet[b] for b in word]
        n = len(ids)
        if n < 2:
            return np.array(ids, np.int32)
        rank, made = self.rank, self.made
        bits = max(n - 2, 1).bit_length()
        size = 1 << bits
        last = size - 1
        none = (len(made) + 1) << bits
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = rank.get((ids[i], ids[i + 1]))
            if r is not None:
                tree[size + i] = r << bits | i
        for at in range(last, 0, -1):
            left, right = tree[2 * at], tree[2 * at + 1]
            tree[at] = left if left < right else right
        following = list(range(1, n + 1))
        before = list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            at = size + i
            tree[at] = value
            while at > 1:
                at >>= 1
                left, right = tree[2 * at], tree[2 * at + 1]
                least = left if left < right else right
                if tree[at] == least:
                    return
                tree[at] = least

        def pair(i: int, j: int) -> int:
            r = rank.get((ids[i], ids[j])) if i >= 0 and j < n else None
            return none if r is None else r << bits | i

        while (top := tree[1]) < none:
            i = top & last
            gone = following[i]
            after = following[gone]
            ids[i] = made[top >> bits]
            following[i] = after
            if gone < n - 1:
                put(gone, none)
            if after < n:
                before[after] = i
            if i < n - 1:
                put(i, pair(i, after))
            if before[i] >= 0:
                put(before[i], pair(before[i], i))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = following[i]
        return np.array(out, np.int32)


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte: itself where it prints, else the next from U+0100 on."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(0x100 + k) for k, b in enumerate(others)}


#: Fixed: the pattern by which byte-level tokenizers cut words.
WORD = regex.compile(r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@functools.cache
def contested() -> frozenset[str]:
    """Characters that the pattern takes for letters or numbers and an older Unicode does not know.

    The tokenizer's own tables may be older or newer than the pattern's, so texts that hold one of
    them are cut by the tokenizer.
    """
    unknown = "".join(c for c in map(chr, range(0x370, sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    return frozenset(regex.findall(r"[\p{L}\p{N}]", unknown))


class Encoder:
    """Ids of whole texts, words met before from memory."""

    def __init__(self, path: str):
        self.path = path
        self.merges = Merges(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        names = sorted(self.merges.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def words(self, text: str) -> list[str]:
        if text.isascii() or contested().isdisjoint(set(text)):
            return WORD.findall(text)
        cut = tokenizer(self.path).pre_tokenizer.pre_tokenize_str(text)
        return [text[start:stop] for _, (start, stop) in cut]

    def learn(self, words: set[str]) -> None:
        """Put the ids of all these words into memory; of those not met lately half go when it is full."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KNOWN_WORDS // 2:
            self.older, self.known = self.known, {}
            new = list(words)
        known, older = self.known, self.older
        known.update((w, older[w]) for w in new if w in older)
        new = [w for w in new if w not in known]
        known.update(zip(new, self.merges.encode_many([w.encode("utf-8") for w in new]), strict=True))

    def forget_long(self, words: set[str]) -> None:
        """Long words would fill the memory, and seldom come again."""
        for w in words:
            if len(w) > SHORT_BYTES // 4:
                self.known.pop(w, None)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as 32-bit numbers, of all words of the texts at once."""
        cut = [self.special.split(t) if self.special else [t] for t in (t or "" for t in texts)]
        words = [[self.words(part) if k % 2 == 0 else None for k, part in enumerate(parts)] for parts in cut]
        every = set().union(*(w for parts in words for w in parts if w))
        self.learn(every)
        ids = self.known.__getitem__
        marks = {name: np.int32(i).tobytes() for name, i in self.merges.special.items()}
        out = [
            b"".join([marks[part] if w is None else b"".join(map(ids, w)) for part, w in zip(parts, listed, strict=True)])
            for parts, listed in zip(cut, words, strict=True)
        ]
        self.forget_long(every)
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder of each file in each worker process."""
    return Encoder(path)


@functools.cache
def _token_bytes(path: str) -> list[bytes]:
    """Bytes of each id; one more, of nothing, for ids that the file does not know."""
    known = encoder(path).merges.bytes_of
    return [known.get(i, b"") for i in range(max(known) + 2)]


def encoded(docs: DataFrame, path: str, key="doc_id", text="text") -> DataFrame:
    """(key, ids array<int>) of each row: the text's ids as the tokenizer file at ``path`` gives them.

    Texts are cut into words by the byte-level pattern, special strings first; the merges of a word
    are found by a segment tree, so that a word of n bytes takes n log n steps, and words met lately
    are remembered. The file must be readable at ``path`` on every executor.

    A null or empty text has no ids. Each row gives one row: repeated rows and null keys are kept, an
    empty table gives an empty one, other columns are left out. No text is cut, whatever its length.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]):
        encode = encoder(path)
        for batch in rebatched(batches, text, BLOCK):
            found = encode(batch.column(text).to_pylist())
            at = np.zeros(len(found) + 1, np.int64)
            np.cumsum([len(x) // 4 for x in found], out=at[1:])
            values = pa.Array.from_buffers(pa.int32(), int(at[-1]), [None, pa.py_buffer(b"".join(found))])
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str, ids="ids", text="decoded") -> DataFrame:
    """``rows`` with a column ``text``: what their ids say, special strings included.

    Bytes of tokens are joined first and read as UTF-8 after that; bytes that are no UTF-8 become
    U+FFFD. Ids that the file does not know say nothing, null ids inside a list likewise; a null list
    gives a null text, an empty one an empty text. All other columns are kept; a column named like
    the new one is replaced.
    """
    kept = [c for c in rows.columns if c != text]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes if c != text), f"`{text}` string"])

    def run(batches: Iterator[pa.RecordBatch]):
        tokens = _token_bytes(path)
        said = tokens.__getitem__
        place = kept.index(ids)
        for batch in batches:
            step = max(1, batch.num_rows * BLOCK // max(4 * len(batch.column(place).flatten()), 1))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                lists = part.column(place)
                numbers = lists.flatten().fill_null(-1).to_numpy()
                numbers = np.where((numbers >= 0) & (numbers < len(tokens)), numbers, len(tokens) - 1)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                ends = np.cumsum(sizes, dtype=np.int64)
                texts = [
                    b"".join(map(said, numbers[end - size : end].tolist())).decode("utf-8", "replace")
                    for size, end in zip(sizes.tolist(), ends.tolist(), strict=True)
                ]
                spoken = pa.array(texts, pa.string())
                spoken = pc.if_else(lists.is_valid(), spoken, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, spoken], names=[*kept, text])
        release()

    return rows.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def ids_digest(column: str):
    """SHA-256, in lower-case hex, of the decimal ids joined by commas."""
    return F.sha2(F.concat_ws(",", F.col(column).cast("array<string>")), 256)
