"""Ranked lexical search: an index of segments, and top documents by a mix of accumulators and skipping."""

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusaudit.llm.common import blocks, release, texts_of
from corpusaudit.llm.hashing import lowered
from corpusaudit.session import materialise

#: A segment of the index holds about so many bytes of text, and one text at least.
SEGMENT = 8 << 20
#: Documents of a posting list that share one stored bound.
STRIDE = 128
#: Postings of an item's lists that are summed into accumulators first, the shortest lists before the others.
SUMMED = 4096
#: Characters of items that one pass over the index looks for.
ITEM_BLOCK = 1 << 21
#: Everything in ASCII that is no letter and no digit.
GAP = np.ones(256, bool)
GAP[128:] = GAP[48:58] = GAP[65:91] = GAP[97:123] = False
LAYOUT = "segment string, term string, df long, tokens long, at binary, tf binary, most binary, least binary, lengths binary"


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, number of the term) of every term of every text, and the terms in order of number."""
    body, offsets = texts_of(column)
    body = lowered(body)
    inside = ~GAP[body]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    starts = offsets[:-1][offsets[:-1] < len(body)]
    fresh[starts] = inside[starts]
    start = np.flatnonzero(fresh)
    row = np.searchsorted(offsets, start, "right") - 1
    sizes = np.add.reduceat(inside, start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    words = pa.Array.from_buffers(
        pa.large_string(), len(start), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(body[inside].tobytes())]
    ).dictionary_encode()
    return row, words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()


def index(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """An index of every term of every text, in segments that are made without a shuffle and written.

    Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, A to Z in lower
    case. A segment is a run of about ``SEGMENT`` bytes of texts as they are read. There is a row
    for each segment and term: ``at`` has the places of its ``df`` documents in the segment,
    ascending by key, ``tf`` how often each has the term, and for each ``STRIDE`` of them the ``most``
    occurrences and the ``least`` length, from which a search bounds what they can score. The row
    whose term is empty tells of the segment: its documents with a term (``df``), their ``tokens``, the
    ``lengths`` of all and their ``keys``.

    A null text has no term, and neither it nor a text of gaps only counts as a document of the
    collection. Repeated rows and null keys are documents of their own. An empty table gives an empty
    index; other columns are left out.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]):
        for number, piece in enumerate(_pieces(batches)):
            order = pc.sort_indices(pa.table({"key": piece.column(0)}), [("key", "ascending")], null_placement="at_end")
            piece = piece.take(order)
            yield from _segment(piece.column(0), piece.column(1), str(number))
        release()

    rows = docs.select(key, text).mapInArrow(run, f"{LAYOUT}, keys array<{kind}>")
    return materialise(rows.withColumn("segment", F.concat_ws("-", F.spark_partition_id().cast("string"), "segment")))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows gathered until their texts are a segment; a row counts 16 bytes besides its text."""
    held, size = [], 0
    for batch in batches:
        for start, stop in blocks(batch.column(1), SEGMENT):
            piece = batch.slice(start, stop - start)
            more = len(texts_of(piece.column(1))[0]) + 16 * (stop - start)
            if held and size + more > SEGMENT:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            held.append(piece)
            size += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _segment(keys: pa.ChunkedArray, texts: pa.ChunkedArray, name: str) -> Iterator[pa.RecordBatch]:
    row, term, words = _terms(texts)
    count = len(texts)
    lengths = np.bincount(row, minlength=count).astype(np.int64)
    cell, tf = np.unique(term * count + row, return_counts=True)
    of, at = cell // count, cell % count
    cut = np.searchsorted(of, np.arange(len(words) + 1))

    # Bounds of every stride of every list, in one go.
    rank = np.arange(len(cell)) - np.repeat(cut[:-1], np.diff(cut))
    head = np.flatnonzero(rank % STRIDE == 0)
    most = np.maximum.reduceat(tf, head) if len(head) else head
    least = np.minimum.reduceat(lengths[at], head) if len(head) else head
    heads = np.searchsorted(head, cut)

    at, tf, most, least = at.astype("<i4"), tf.astype("<i4"), most.astype("<i4"), least.astype("<i4")
    kind = keys.type
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    if isinstance(keys, pa.ChunkedArray):
        keys = pa.concat_arrays(keys.chunks)
    names = ["segment", "term", "df", "tokens", "at", "tf", "most", "least", "lengths", "keys"]
    whole = [
        [name], [""], pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]),
        *([pa.nulls(1, pa.binary())] * 4), pa.array([lengths.astype("<i4").tobytes()], pa.binary()),
        pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), keys),
    ]
    yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, list) else c for c in whole], names=names)
    for start in range(0, len(words), 20_000):
        stop = min(start + 20_000, len(words))
        n = stop - start
        lists = [_cuts(v, e[start : stop + 1]) for v, e in ((at, cut), (tf, cut), (most, heads), (least, heads))]
        front = [[name] * n, words[start:stop], np.diff(cut[start : stop + 1])]
        rest = [pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(kind))]
        columns = [*map(pa.array, front), pa.nulls(n, pa.int64()), *lists, *rest]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _cuts(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """One binary value for each run between edges."""
    part = values[edges[0] : edges[-1]]
    offsets = ((edges - edges[0]) * values.itemsize).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(part.tobytes())])


class Bounded:
    """Documents in ascending order with what each scores, and what a stride of them can score at most."""

    def __init__(self, at: np.ndarray, score, edges: np.ndarray, bounds: np.ndarray):
        self.at, self.score, self.edges, self.bounds = at, score, edges, bounds
        self.bound = int(bounds.max()) if len(bounds) else 0

    def bounds_of(self, docs: np.ndarray) -> np.ndarray:
        """At most so much a document gets here: the bound of the stride it would stand in."""
        stride = np.searchsorted(self.edges, docs, "right") - 1
        return np.where(stride >= 0, self.bounds[np.maximum(stride, 0)], 0)

    def scores_of(self, docs: np.ndarray) -> np.ndarray:
        """What these documents get here, 0 where they are not listed."""
        place = np.minimum(np.searchsorted(self.at, docs), len(self.at) - 1)
        here = self.at[place] == docs
        out = np.zeros(len(docs), np.int64)
        out[here] = self.score(place[here])
        return out


def top(lists: list[tuple], lengths: np.ndarray, total: int, size: int, k: int) -> list[tuple[int, int]]:
    """(score, place) of the ``k`` best documents of a segment, best first, earlier places before later.

    ``lists`` holds (at, tf, most, least, weight) for each different term of an item. The shortest
    lists are summed into accumulators, term at a time. Those are one iterator with bounds, the long
    lists are the others, and documents pass all of them in ascending order, some strides at a time. A
    document is looked up in a list only while what it has and what the lists still to come can give
    it reach the k-th best score so far.
    """
    factor = 8 * (25 + (75 * lengths * size) // max(total, 1))

    def worth(weight, tf, m):
        return weight * ((1_000_000_000 * tf) // (1000 * tf + m))

    lists = sorted((x for x in lists if x[4] > 0), key=lambda x: len(x[0]))
    if not lists:
        return []
    reach = np.cumsum([len(x[0]) for x in lists])
    short = max(1, int(np.searchsorted(reach, SUMMED, "right")))
    docs = np.concatenate([x[0] for x in lists[:short]])
    gained = np.concatenate([worth(x[4], x[1], factor[x[0]]) for x in lists[:short]])
    at, where = np.unique(docs, return_inverse=True)
    summed = np.zeros(len(at), np.int64)
    np.add.at(summed, where, gained)
    head = np.arange(0, len(at), STRIDE)
    streams = [Bounded(at, lambda i: summed[i], at[head], np.maximum.reduceat(summed, head))]
    for places, tf, most, least, weight in lists[short:]:
        bounds = worth(weight, most, 8 * (25 + (75 * least * size) // max(total, 1)))
        score = lambda i, p=places, t=tf, w=weight: worth(w, t[i], factor[p[i]])
        streams.append(Bounded(places, score, places[::STRIDE], bounds))

    # Partial sums are scores that a document reaches at least: the k-th of them is a first threshold.
    best: list[tuple[int, int]] = []  # (score, -place), a heap of the k best
    floor = int(np.partition(summed, len(summed) - k)[len(summed) - k]) if len(summed) >= k else 0
    streams.sort(key=lambda s: s.bound)
    before = np.concatenate([[0], np.cumsum([s.bound for s in streams])])
    # Documents only in the streams before this one cannot reach the threshold.
    needed = lambda: int(np.searchsorted(before[1:], floor, "left"))
    seen = -1
    while seen < len(lengths):
        first = min(needed(), len(streams) - 1)
        heads = []
        for s in streams[first:]:
            i = int(np.searchsorted(s.at, seen, "right"))
            heads.append(s.at[i : i + 4 * STRIDE])
        ends = [h[-1] for h in heads if len(h) == 4 * STRIDE]
        stop = min(ends) if ends else len(lengths)
        here = np.unique(np.concatenate(heads))
        here = here[here <= stop]
        seen = stop
        if not len(here):
            if stop >= len(lengths):
                break
            continue
        got = np.zeros(len(here), np.int64)
        order = streams[::-1]
        left = np.stack([s.bounds_of(here) for s in order])
        left = np.cumsum(left[::-1], axis=0)[::-1]  # what this stream and those after it can give
        for j, s in enumerate(order):
            alive = got + left[j] >= max(floor, 1)
            if not alive.all():
                here, got, left = here[alive], got[alive], left[:, alive]
            if not len(here):
                break
            got += s.scores_of(here)
        for place, score in zip(here[got > 0].tolist(), got[got > 0].tolist(), strict=True):
            if len(best) < k:
                heapq.heappush(best, (score, -place))
            elif score > best[0][0]:
                heapq.heapreplace(best, (score, -place))
        if len(best) == k:
            floor = max(floor, best[0][0])
    return [(score, -place) for score, place in sorted(best, reverse=True)]


def item_blocks(items: DataFrame, key="item_id", text="text") -> Iterator[list[tuple]]:
    """(key, {term: how often}) of the items, in lists of about ``ITEM_BLOCK`` bytes of text."""
    block, held = [], 0
    for row in items.select(key, text).toLocalIterator():
        _, term, words = _terms(pa.array([row[1] or ""], pa.string()))
        counts = dict(zip(words, np.bincount(term, minlength=len(words)).tolist(), strict=True))
        block.append((row[0], counts))
        held += len(row[1] or "") + 16
        if held >= ITEM_BLOCK:
            yield block
            block, held = [], 0
    if block:
        yield block


def ranked(postings: DataFrame, items: DataFrame, k=10, key="doc_id", item="item_id", text="text") -> DataFrame:
    """(item, rank, key, score) of the ``k`` documents of an index that score highest for each item.

    Each block of items is one pass over the posting lists of its own terms; a task has whole segments
    and gives ``k`` rows for each item at most, so that a term of many documents has as many rows as
    there are segments and no task has more of it than its segments. How many documents have a term
    is a sum over the segments.

    Equal scores rank by ascending key, null keys last; rows equal in key and score are the same row
    twice. Items that are null, empty or without a known term give no row; of repeated items each gives
    rows of its own. A term of weight 0 and a score of 0 give nothing. Empty tables give an empty
    result. The key keeps the name it had in the documents, also if the items have such a column.
    """
    spark = items.sparkSession
    of = items.schema[item].dataType
    kind = postings.schema["keys"].dataType.elementType
    size, total = postings.filter("term = ''").select(F.sum("df"), F.sum("tokens")).first()
    schema = T.StructType(
        [T.StructField("number", T.LongType()), T.StructField("item", of), T.StructField("score", T.LongType()), T.StructField("key", kind)]
    )
    out = spark.createDataFrame([], schema)
    number = 0
    for block in item_blocks(items, item, text):
        # Written first, so that Spark knows how small they are and sends them to the index or not.
        terms = materialise(spark.createDataFrame([(t,) for t in sorted(set().union(*(c for _, c in block)))], "term string").coalesce(1))
        asked = postings.join(terms, "term", "left_semi")
        df = dict(asked.groupBy("term").agg(F.sum("df")).collect())
        weight = {t: math.floor(1000 * math.log((2 * size + 2) / (2 * n + 1))) for t, n in df.items()}
        queries = [
            (number + i, name, {t: n * weight[t] for t, n in counts.items() if t in weight})
            for i, (name, counts) in enumerate(block)
        ]
        number += len(block)
        lists = postings.filter("term = ''").unionByName(asked.select(postings.columns))
        found = lists.groupBy("segment").applyInArrow(_searched(queries, size, total, k, of, kind), schema)
        out = out.unionByName(found)
    best = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return (
        out.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
    )


def _searched(queries: list[tuple], size: int, total: int, k: int, of: T.DataType, kind: T.DataType):
    """What a task does with a segment: the best documents of each query."""
    of, kind = to_arrow_type(of), to_arrow_type(kind)

    def run(segment: pa.Table) -> pa.Table:
        names = segment.column("term").to_pylist()
        whole = names.index("")
        lengths = np.frombuffer(segment.column("lengths")[whole].as_py(), "<i4").astype(np.int64)
        keys = segment.column("keys")[whole].values
        held = {}
        columns = [segment.column(c).to_pylist() for c in ("at", "tf", "most", "least")]
        for i, name in enumerate(names):
            if i != whole:
                held[name] = tuple(np.frombuffer(c[i], "<i4").astype(np.int64) for c in columns)
        numbers, items, scores, places = [], [], [], []
        for number, item, weights in queries:
            lists = [(*held[t], w) for t, w in weights.items() if t in held]
            for score, place in top(lists, lengths, total, size, k):
                numbers.append(number)
                items.append(item)
                scores.append(score)
                places.append(place)
        return pa.table(
            {
                "number": pa.array(numbers, pa.int64()),
                "item": pa.array(items, of),
                "score": pa.array(scores, pa.int64()),
                "key": keys.take(pa.array(places, pa.int64())).cast(kind),
            }
        )

    return run
