"""Packing of encoded documents into sequences of one size."""

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import rebatched
from corpusaudit.llm.encoding import byte_encoder
from corpusaudit.llm.sharding import numbered
from corpusaudit.session import materialise

BLOCK = 1 << 20


def encoded_pieces(
    docs: DataFrame, tokenizer: str, end: int, capacity: int, key="doc_id", text="text", ranks=None, pattern=None
) -> DataFrame:
    """(key, piece, start, length, ids) of each piece of each document.

    A document is the ids of its text and then ``end``. Only those of over ``capacity`` ids are cut,
    from the back into whole pieces, so that the first piece holds what is over. ``ids`` is binary,
    little-endian unsigned 32-bit. ``ranks`` and ``pattern`` are the tokenizer's merges and its
    pattern of words for a faster engine with the same ids.

    A null text is the end id alone; repeated rows and null keys each give their pieces; an empty
    table gives an empty one; other columns are left out.
    """
    kind = dict(docs.dtypes)[key]

    def encode(batches):
        encoder = byte_encoder(tokenizer, ranks, pattern)
        last = np.asarray([end], "<u4").tobytes()
        for batch in rebatched(batches, text, BLOCK):
            row, piece, start, ids = [], [], [], []
            for i, whole in enumerate(batch.column(text).to_pylist()):
                done = encoder(whole or "") + last
                n = len(done) // 4
                first = n if n <= capacity else (n - 1) % capacity + 1
                for k, stop in enumerate(range(first, n + 1, capacity)):
                    begin = max(0, stop - capacity) if k else 0
                    row.append(i)
                    piece.append(k)
                    start.append(begin)
                    ids.append(done[4 * begin : 4 * stop])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=[key, "piece", "start", "length", "ids"],
            )

    return docs.select(key, text).mapInArrow(encode, f"`{key}` {kind}, piece int, start long, length long, ids binary")


def planned(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in one sequence, how many such sequences), from the count of each length.

    From the longest piece down, a gap is filled exactly, first by one piece of its length, then by
    two, then by three that sum to it, each as often as the pieces on hand allow. What no exact sum
    completes is packed by best fit, longest first. Work and result depend on ``capacity``, not on
    how many pieces there are, as equal sequences are one entry.
    """
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> None:
        need = {x: pattern.count(x) for x in pattern}
        n = min(int(left[x]) // k for x, k in need.items())
        if n:
            for x, k in need.items():
                left[x] -= n * k
            out.append((pattern, n))

    use((capacity,))
    for long in range(capacity - 1, 0, -1):
        gap = capacity - long
        if left[long] and left[gap]:
            use((long, gap))
        for a in range(min(gap - 1, long), (gap + 1) // 2 - 1, -1):
            if not left[long]:
                break
            if left[a] and left[gap - a]:
                use((long, a, gap - a))
        for a in range(min(gap - 2, long), (gap + 2) // 3 - 1, -1):
            if not left[long]:
                break
            if left[a]:
                rest = gap - a
                b = np.arange(min(a, rest - 1), (rest + 1) // 2 - 1, -1)
                for x in b[(left[b] > 0) & (left[rest - b] > 0)].tolist():
                    if not left[long] or not left[a]:
                        break
                    use((long, a, x, rest - x))
    return out + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over groups of equal open sequences."""
    open_: dict[int, list[list]] = {}  # free room -> [lengths, how many]
    gaps: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(gaps, room)
        open_[room].append([pattern, n])

    for long in range(capacity, 0, -1):
        n = int(left[long])
        while n:
            i = bisect.bisect_left(gaps, long)
            if i == len(gaps):
                fit = capacity // long
                for k, m in ((fit, n // fit), (n % fit, 1)):
                    if k and m:
                        put(capacity - k * long, (long,) * k, m)
                break
            room = gaps[i]
            pattern, m = open_[room].pop()
            k = min(n, m)
            if m > k:
                open_[room].append([pattern, m - k])
            if not open_[room]:
                del open_[room], gaps[i]
            put(room - long, (*pattern, long), k)
            n -= k
    return [(p, n) for groups in open_.values() for p, n in groups]


def pack(pieces: DataFrame, capacity: int, *order: str) -> DataFrame:
    """Give each piece its sequence and its place there: columns sequence_id and offset.

    The driver sees only how many pieces there are of each length, at most ``capacity`` figures, and
    plans kinds of sequences from them. Pieces are numbered by length and ``order`` over all tasks,
    and a piece's number tells which sequence of which kind is its own, so no task holds more than a
    batch and no length is a hot key. Lengths are 1 to ``capacity``; an empty table stays empty.
    """
    pieces = materialise(pieces)
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"]] = r["n"]
    # Each run of equal lengths in a kind of sequence takes a range of the pieces of that length.
    taken = np.cumsum(counts) - counts
    runs, sequence = [], 0
    for pattern, n in planned(counts, capacity):
        offset = 0
        for long in dict.fromkeys(pattern):
            k = pattern.count(long)
            runs.append((int(taken[long]), sequence, k, offset, long))
            taken[long] += n * k
            offset += k * long
        sequence += n
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    rows, _ = numbered(pieces, F.col("length"), *[F.col(c).asc_nulls_first() for c in order])

    def place(batches):
        for batch in batches:
            number = batch.column("number").to_numpy()
            first, base, each, offset, long = table[np.searchsorted(table[:, 0], number, "right") - 1].T
            inside = number - first
            keep = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array(base + inside // each), pa.array(offset + inside % each * long)],
                names=[*keep, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.drop("number").dtypes)
    return rows.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def packed_documents(
    docs: DataFrame, tokenizer: str, end: int, capacity: int, key="doc_id", text="text", ranks=None, pattern=None
) -> DataFrame:
    """Pieces of all documents with a checksum of their ids, their sequence and their place."""
    pieces = encoded_pieces(docs, tokenizer, end, capacity, key, text, ranks, pattern)
    digest = pieces.select(key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digest, capacity, key, "piece", "ids_crc32")
