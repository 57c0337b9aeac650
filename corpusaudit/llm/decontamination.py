"""Benchmark items that stand in documents, up to a number of edits in proportion to their length."""

import functools
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One edit is allowed for so many characters of an item.
EDIT_EVERY = 10
#: Items of fewer characters are no passages and are not searched for.
LEAST = 20
#: Items are searched for in blocks of so many characters, each block in one pass over the documents.
BLOCK = 2_000_000

SPACES = {i: " " for i in (*range(9, 14), 32)}


def folded(text: str) -> str:
    """Lower case and plain spaces, one character for each of the text's, so places stay the same."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return low.translate(SPACES)


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return out


def best_end(pattern: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the nearest part of a text to a pattern of m characters, if within ``most``.

    Myers' bit vectors: all rows of a column of the distance table are one integer.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = None
    get = pattern.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        h_plus = minus | (full & ~(d | plus))
        h_minus = plus & d
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = (h_plus << 1) & full
        h_minus = (h_minus << 1) & full
        plus = h_minus | (full & ~(d | h_plus))
        minus = h_plus & d
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Item:
    """One benchmark item: its blocks, of which one must match with at most one edit."""

    def __init__(self, name, text: str):
        self.name, self.text, self.m = name, text, len(text)
        self.budget = self.m // EDIT_EVERY
        # budget // 2 + 1 blocks of two pieces: budget + 1 pieces or one more. With so few edits one
        # block has at most one, and so one of its two pieces has none.
        n = self.budget // 2 + 1
        cuts = [self.m * i // (2 * n) for i in range(2 * n + 1)]
        self.blocks = [(cuts[2 * i], cuts[2 * i + 1], cuts[2 * i + 2]) for i in range(n)]
        self.masks = self.back = None

    def pieces(self) -> Iterator[tuple[str, int, int]]:
        for i, (a, b, c) in enumerate(self.blocks):
            yield self.text[a:b], i, 0
            yield self.text[b:c], i, 1

    def block_holds(self, text: str, at: int, block: int, half: int) -> bool:
        """Does the other half of a block stand beside an exact half, with at most one edit?"""
        a, b, c = self.blocks[block]
        if half == 0:
            want, near = self.text[b:c], text[at + b - a : at + c - a + 1]
        else:
            want, near = self.text[a:b][::-1], text[max(0, at - (b - a) - 1) : at][::-1]
        return one_edit(want, near)

    def found(self, text: str, low: int, high: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best match between two places of a text."""
        if self.masks is None:
            self.masks, self.back = masks(self.text), masks(self.text[::-1])
        hit = best_end(self.masks, self.m, text[low:high], self.budget)
        if hit is None:
            return None
        distance, end = hit
        end += low
        behind = text[max(0, end - self.m - self.budget) : end][::-1]
        reach = best_start(self.back, self.m, behind, distance)
        return distance, end - reach, end


def best_start(pattern: dict[str, int], m: int, text: str, distance: int) -> int:
    """How many characters from the start of a text are at just this distance from the pattern."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for j, c in enumerate(text):
        x = pattern.get(c, 0) | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        h_plus = minus | (full & ~(d | plus))
        h_minus = plus & d
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = (h_plus << 1) & full | 1  # from the start of the text on, not from any place
        h_minus = (h_minus << 1) & full
        plus = h_minus | (full & ~(d | h_plus))
        minus = h_plus & d
        if score == distance:
            return j + 1
    return 0


def one_edit(want: str, near: str) -> bool:
    """Is ``want`` at most one edit away from a front of ``near``?"""
    if near.startswith(want):
        return True
    n = 0
    for a, b in zip(want, near):  # noqa: B905
        if a != b:
            break
        n += 1
    rest = want[n + 1 :]
    return near.startswith(rest, n + 1) or near.startswith(rest, n) or near.startswith(want[n:], n + 1)


@functools.lru_cache(maxsize=2)
def searcher(items: tuple[tuple[object, str], ...]) -> tuple[ahocorasick.Automaton, list[Item]]:
    known = [Item(name, folded(text)) for name, text in items]
    where = defaultdict(list)
    for k, item in enumerate(known):
        for piece, block, half in item.pieces():
            where[piece].append((k, block, half))
    machine = ahocorasick.Automaton()
    for piece, uses in where.items():
        machine.add_word(piece, (len(piece), uses))
    machine.make_automaton()
    return machine, known


def matches(text: str | None, items: tuple[tuple[object, str], ...]) -> list[tuple]:
    """(item, distance, start, end) of the best match of each item that a text holds."""
    if not text or not items:
        return []
    machine, known = searcher(items)
    low = folded(text)
    spots = defaultdict(set)
    for end, (size, uses) in machine.iter(low):
        at = end - size + 1
        for k, block, half in uses:
            if known[k].block_holds(low, at, block, half):
                spots[k].add(at - known[k].blocks[block][half])
    out = []
    for k, starts in spots.items():
        item, best = known[k], None
        regions = []
        for s in sorted(starts):  # hits of one place are verified once
            low_end, high_end = max(0, s - item.budget), min(len(low), s + item.m + item.budget)
            if regions and low_end <= regions[-1][1] - item.m:
                regions[-1][1] = high_end
            else:
                regions.append([low_end, high_end])
        for a, b in regions:
            hit = item.found(low, a, b)
            if hit and (best is None or hit < best):
                best = hit
        if best:
            out.append((item.name, *best))
    return sorted(out, key=lambda x: str(x[0]))


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[tuple[tuple[object, str], ...]]:
    """The items in blocks of bounded size, equal rows once; one block is on the driver at a time."""
    block, size = [], 0
    usable = items.select(key, text).filter(F.char_length(text) >= LEAST).distinct().orderBy(key, text)
    for name, body in usable.toLocalIterator():
        if block and size + len(body) > BLOCK:
            yield tuple(block)
            block, size = [], 0
        block.append((name, body))
        size += len(body)
    yield tuple(block)


def leaks(docs: DataFrame, items: DataFrame, key="doc_id", text="text", item_key="item_id", item_text="text") -> DataFrame:
    """(key, item key, distance, start, end) of each item that a document holds, best match of each.

    An item of m characters may differ by m // EDIT_EVERY edits, case and kinds of white space
    aside. It is split into one more piece than edits, so one piece must stand in the text exactly;
    an Aho-Corasick machine finds pieces, and Myers' distance verifies the places. Places count
    characters of the whole text. Each document is read once for a block of items, without a shuffle.

    Null texts and items and items under LEAST characters match nothing; repeated documents each
    give their rows; items equal in key and text count once; other columns are left out.
    """
    kinds = dict(docs.dtypes)[key], dict(items.dtypes)[item_key]
    schema = f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, distance int, start int, end int"
    out = None
    for block in item_blocks(items, item_key, item_text):

        def search(batches, block=block):
            for batch in batches:
                rows = [(i, *m) for i, t in enumerate(batch.column(text).to_pylist()) for m in matches(t, block)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key).take(pa.array(columns[0], pa.int64())),
                        pa.array(columns[1], items_type),
                        *[pa.array(c, pa.int32()) for c in columns[2:]],
                    ],
                    names=[key, item_key, "distance", "start", "end"],
                )

        items_type = _arrow_type(items, item_key)
        found = docs.select(key, text).mapInArrow(search, schema)
        out = found if out is None else out.union(found)
    return out


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def without_leaks(docs: DataFrame, items: DataFrame, text="text", item_key="item_id", item_text="text") -> DataFrame:
    """The documents that hold no item, with all their columns, in one pass and without a shuffle."""
    for block in item_blocks(items, item_key, item_text):

        def clean(batches, block=block):
            for batch in batches:
                yield batch.filter(pa.array([not matches(t, block) for t in batch.column(text).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
