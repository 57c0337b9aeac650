"""Removal of passages that an earlier document has, by suffix arrays of the places that may repeat."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusaudit.llm.common import blocks, free_name, groups, texts_of
from corpusaudit.llm.hashing import gram_hashes, mixed, span_hashes

#: Bytes of the substring that picks the anchor of a window: long enough to be rare by chance.
GRAM = 24
BLOCK = 1 << 18
#: An anchor with more different surroundings than this is dealt out window by window.
HOT = 10_000
#: Groups of texts for each task of a shuffle: a worker holds one group, its anchors and their order at a time.
SMALLER = 2
#: A suffix array is made of about so many bytes at a time.
ARRAY = 1 << 21


# ---- suffix arrays -----------------------------------------------------------------------------


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (type S); the last symbol is type S."""
    n = len(t)
    s = np.zeros(n, bool)
    s[-1] = True
    # A run of equal symbols has the type that its end gives it.
    differs = np.flatnonzero(t[:-1] != t[1:])
    smaller = np.zeros(n - 1, bool)
    smaller[differs] = t[differs] < t[differs + 1]
    if n > 1:
        nearest = np.searchsorted(differs, np.arange(n - 1))
        s[:-1] = smaller[differs[nearest]]
    return s


def _induced(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array that an order of the leftmost-smaller suffixes induces.

    First larger types from left to right, then smaller types from right to left, bucket by bucket.
    All suffixes of a bucket that are ready go through numpy together; runs of one symbol take a
    further round for each symbol.
    """
    n = len(t)
    sa = np.full(n, -1, np.int32 if n < 2**31 else np.int64)
    counts = np.bincount(t, minlength=symbols)
    ends = np.cumsum(counts)
    heads = ends - counts
    head = heads.copy()
    first = t[lms]
    by_symbol = np.argsort(first, kind="stable")
    ordered = lms[by_symbol]
    cut = np.searchsorted(first[by_symbol], np.arange(symbols + 1))
    present = np.flatnonzero(counts)

    def spread(preds: np.ndarray, at: np.ndarray, down: bool) -> None:
        if not len(preds):
            return
        c = t[preds].astype(np.uint16)
        order = np.argsort(c, kind="stable")
        c, preds = c[order], preds[order]
        m = np.bincount(c, minlength=symbols)
        inside = np.arange(len(c)) - (np.cumsum(m) - m)[c]
        if down:
            sa[at[c] - 1 - inside] = preds
            at -= m
        else:
            sa[at[c] + inside] = preds
            at += m

    for c in present:
        done = heads[c]
        while done < head[c]:
            ready = sa[done : head[c]]
            done = head[c]
            preds = ready[ready > 0] - 1
            spread(preds[~s_type[preds]], head, False)
        preds = ordered[cut[c] : cut[c + 1]]
        preds = preds[preds > 0] - 1
        spread(preds, head, False)
    larger = head.copy()  # ends of the parts with type L
    tail = ends.copy()
    for c in present[::-1]:
        done = ends[c]
        while tail[c] < done:
            ready = sa[tail[c] : done][::-1]
            done = tail[c]
            preds = ready[ready > 0] - 1
            spread(preds[s_type[preds]], tail, True)
        ready = sa[heads[c] : larger[c]][::-1]
        preds = ready[ready > 0] - 1
        spread(preds[s_type[preds]], tail, True)
    sa[0] = n - 1
    return sa


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names: each round ranks twice as many names at once.

    This is the recursion on the shorter string, whose alphabet is too large to go by buckets.
    """
    rank, width, n = names.astype(np.int64), 1, len(names)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, bool)
        fresh[0] = True
        fresh[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all() or width >= n:
            return order
        width *= 2


def suffix_array(t: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of a string that ends with its only 0, by induced sorting."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    s_type = _types(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    sa = _induced(t, s_type, lms, symbols)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    found = sa[is_lms[sa]]  # leftmost-smaller substrings in order
    ends = np.append(lms[1:], n - 1)
    place = np.searchsorted(lms, found)
    stop = np.minimum(ends[place] + 1, n)
    same = (stop[1:] - found[1:] == stop[:-1] - found[:-1]) & _equal_spans(t, found[1:], found[:-1], stop[1:] - found[1:])
    name = np.concatenate([[0], np.cumsum(~same)])
    if name[-1] + 1 == len(lms):
        return _induced(t, s_type, found, symbols)
    names = np.empty(len(lms), np.int64)
    names[place] = name
    return _induced(t, s_type, lms[_sorted_names(names)], symbols)


def _equal_spans(t: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Do the spans of t from a and b, of equal sizes, hold the same symbols?"""
    same = np.ones(len(a), bool)
    live = np.arange(len(a))
    k = 0
    while len(live):
        live = live[size[live] > k]
        equal = t[np.minimum(a[live] + k, len(t) - 1)] == t[np.minimum(b[live] + k, len(t) - 1)]
        same[live[~equal]] = False
        live = live[equal]
        k += 1
    return same


def common_prefixes(t: np.ndarray, sa: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cap: int) -> np.ndarray:
    """Permuted common prefixes, up to ``cap``: of each suffix with the one before it in order.

    Computed in the order of the text, where a value is at least the one before it less 1. All
    strings of the text (from ``starts``, of ``lengths``) go in step with each other.
    """
    n = len(t)
    before = np.full(n, -1, sa.dtype)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int16)
    have = np.zeros(len(starts), np.int64)
    for k in range(int(lengths.max(initial=0))):
        lane = np.flatnonzero(lengths > k)
        p = starts[lane] + k
        q = before[p]
        size = np.maximum(have[lane] - 1, 0)
        live = np.flatnonzero((q >= 0) & (size < cap))
        size[q < 0] = 0
        while len(live):
            a, b = p[live] + size[live], q[live] + size[live]
            inside = (a < n) & (b < n)
            equal = inside & (t[np.minimum(a, n - 1)] == t[np.minimum(b, n - 1)])
            live = live[equal]
            size[live] += 1
            live = live[size[live] < cap]
        out[p] = size
        have[lane] = size
    return out


def earliest(strings: list[bytes], owners: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The least owner of each part of ``size`` bytes of each string: (offsets of strings, owners).

    Parts are compared through one suffix array of all strings: equal parts stand side by side in
    it, with common prefixes of ``size`` or more between them.
    """
    lengths = np.array([len(s) for s in strings], np.int64)
    t = np.frombuffer(b"\x00".join(strings) + b"\x00\x00", np.uint8).astype(np.int16) + np.int16(2)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    t[starts + lengths] = 1  # between strings
    t[-1] = 0
    sa = suffix_array(t, 258)
    parts = np.maximum(lengths - size + 1, 0)
    string = np.repeat(np.arange(len(strings)), lengths + 1)
    inside = np.arange(len(string)) - starts[string]
    whole = np.zeros(len(t), bool)
    whole[: len(string)] = inside < parts[string]
    plcp = common_prefixes(t, sa, starts, parts, size)
    ranked = sa[whole[sa]]
    # Suffixes with the same first ``size`` bytes are neighbours, and all of them are whole parts.
    fresh = plcp[ranked] < size
    if len(fresh):
        fresh[0] = True
    begin = np.flatnonzero(fresh)
    offsets = np.concatenate([[0], np.cumsum(parts)])
    out = np.zeros(offsets[-1], owners.dtype)
    if len(begin):
        least = np.minimum.reduceat(owners[string[ranked]], begin)
        out[offsets[string[ranked]] + inside[ranked]] = np.repeat(least, np.diff(np.append(begin, len(ranked))))
    return offsets, out


# ---- windows and anchors -----------------------------------------------------------------------


def anchored(body: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, id of the anchor, first start, last start) of all windows of ``size`` bytes.

    The anchor of a window is its substring of GRAM bytes with the least hash, so equal windows have
    equal anchors wherever they stand. Neighbouring windows with one anchor are one entry. Starts
    count from the front of the text.
    """
    none = np.zeros(0, np.int64)
    n = len(body) - GRAM + 1
    span = size - GRAM + 1
    if n < span:
        return none, none.astype(np.uint64), none, none
    grams = gram_hashes(body, GRAM)
    value = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(0xFFFFFFFF, 0xFFFFFFFF - n, -1).astype(np.uint64)
    width, low = 1, value
    while 2 * width <= span:  # least of 1, 2, 4, ... neighbours
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: n - span + 1], low[span - width : span - width + n - span + 1])
    rows = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    start = np.flatnonzero(rows[: len(low)] == rows[size - 1 : size - 1 + len(low)])
    if not len(start):
        return none, none.astype(np.uint64), none, none
    anchor = (np.uint64(0xFFFFFFFF) - (low[start] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    row = rows[start]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(fresh)
    last = np.append(begin[1:], len(start)) - 1
    first_row = row[begin].astype(np.int64)
    return first_row, mixed(grams[anchor[begin]]), start[begin] - at[first_row], start[last] - at[first_row]


class Texts:
    """The documents of one group: keys, texts, and an identity of (key, text) for each row."""

    def __init__(self, table: pa.Table, skip: np.ndarray):
        table = table.combine_chunks()
        self.table = table
        self.body, self.at = texts_of(table.column("body"))
        self.keys = table.column("key").to_numpy(zero_copy_only=False).astype(np.int64) if table.num_rows else np.zeros(0, np.int64)
        self.identity = table.column("identity").to_numpy(zero_copy_only=False).astype(np.int64) if table.num_rows else np.zeros(0, np.int64)
        self.copy = np.isin(self.identity, skip)

    def windows(self, size: int):
        """(row, anchor, first start, last start, print) of all rows that are no copies.

        The print is a hash of the bytes under all windows of an entry. Texts go a block at a time.
        """
        out = [[], [], [], [], []]
        if self.table.num_rows:
            for a, b in blocks(self.table.column("body"), BLOCK):
                body, at = self.body[self.at[a] : self.at[b]], self.at[a : b + 1] - self.at[a]
                row, anchor, low, high = anchored(body, at, size)
                if len(row):
                    length = high - low + size
                    begin = at[row] + low
                    prints = mixed(span_hashes(body, begin, begin + length) + length.astype(np.uint64))
                    use = ~self.copy[a + row]
                    for k, x in enumerate((row + a, anchor, low, high, prints)):
                        out[k].append(x[use])
        kinds = (np.int64, np.uint64, np.int64, np.int64, np.uint64)
        return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds, strict=True)]


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in an ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[place] == values


def _least(group: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct groups, least owner of each)."""
    order = np.argsort(group, kind="stable")
    fresh = np.append([True], group[order][1:] != group[order][:-1]) if len(group) else np.zeros(0, bool)
    begin = np.flatnonzero(fresh)
    return group[order][begin], np.minimum.reduceat(owner[order], begin) if len(begin) else owner[:0]


def _by(number: np.ndarray, most: int) -> tuple[list[int], list[np.ndarray]]:
    """The numbers under ``most`` that occur, and the places of each."""
    order = np.argsort(number, kind="stable")
    cut = np.searchsorted(number[order], np.arange(most + 1))
    use = [k for k in range(most) if cut[k] < cut[k + 1]]
    return use, [order[cut[k] : cut[k + 1]] for k in use]


def _window_prints(body: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place, the same wherever they stand."""
    power = mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros(len(begin), np.uint64)
    for a in range(0, len(begin), 1 << 15):
        rows = body[begin[a : a + (1 << 15), None] + np.arange(size)].astype(np.uint64)
        out[a : a + (1 << 15)] = mixed(((rows + np.uint64(1)) * power).sum(1, dtype=np.uint64))
    return out


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, start) of every window of each entry."""
    n = high - low + 1
    entry = np.repeat(np.arange(len(n)), n)
    return entry, low[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)


def _cuts(bucket: np.ndarray, sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of ordered items of about ``most`` bytes; a bucket is never cut."""
    if not len(bucket):
        return []
    begin = np.flatnonzero(np.append([True], bucket[1:] != bucket[:-1]))
    whole = np.cumsum(np.add.reduceat(sizes, begin))
    out, a = [], 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(whole, (whole[a - 1] if a else 0) + most, "right")))
        out.append((int(begin[a]), int(begin[b]) if b < len(begin) else len(bucket)))
        a = b
    return out


def _gone(strings: list[bytes], owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of the windows that a smaller owner has among the strings."""
    place: dict[bytes, int] = {}
    which = np.array([place.setdefault(s, len(place)) for s in strings], np.int64)
    _, least = _least(which, owner)
    offsets, first = earliest(list(place), least, size)
    parts = np.diff(offsets)[which]
    item = np.repeat(np.arange(len(which)), parts)
    inside = np.arange(len(item)) - np.repeat(np.cumsum(parts) - parts, parts)
    gone = first[offsets[which[item]] + inside] < owner[item]
    return item[gone], inside[gone]


def _numbers(table: pa.Table, column: str, kind) -> np.ndarray:
    values = [v for v in table.column(column).to_pylist() if v]
    return np.frombuffer(b"".join(values), kind) if values else np.zeros(0, kind)


def repeats(docs: DataFrame, size: int = 50, key="doc_id", text="text", *keep: str, hot: int = HOT) -> DataFrame:
    """(key, n_bytes, spans, kept): the spans of each text that an earlier text has, and what is left.

    With ``keep``, those columns come too, in a struct ``rest``.

    A byte goes if a string of ``size`` bytes over it also starts in a document with a smaller key.
    Strings are judged on the input, over the UTF-8 bytes of whole texts. Spans are arrays of
    (start, stop) in bytes, in order and apart.

    Texts equal to one with a smaller key are set aside first: all their bytes go. Windows of the
    others that may repeat are found by their anchors, of which only hashes are shuffled. Where two
    texts have an anchor, prints of the bytes around it are compared: of equal ones only the text
    with the least key goes on, the others lose all of them. The different ones are brought
    together by anchor, and suffix arrays of each shard find what repeats between them.
    An anchor with more than ``hot`` kinds of surroundings is no key for that: its prints are dealt
    by print and its windows of ``size`` bytes by their own hash, each once from a group of texts
    with its least key, so that no shard holds more of it than another.
    Texts are shuffled once, by a hash of the key; every step reads that same shuffle.

    Keys are whole numbers of 64 bits at most; a key of another type is refused at once.
    Null texts count as empty. Null keys have no order: such rows lose nothing and make nothing go.
    Rows with equal keys do not make each other's bytes go, and each has its own row; an empty table
    gives an empty one; other columns are left out.
    """
    return _steps(docs, size, key, text, keep, hot)[0]


def _steps(docs: DataFrame, size: int, key: str, text: str, keep: tuple[str, ...], hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``repeats`` gives, and what its shards of prints and of surroundings are sent."""
    spark = docs.sparkSession
    if (kind := dict(docs.dtypes)[key]) not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"keys are whole numbers here, and {key} is {kind}")
    dealt = groups(spark)
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rest = [F.struct(*keep).alias("rest")] if keep else []
    rows = docs.select(F.col(key).alias("key"), body.alias("body"), *rest).withColumn("identity", F.xxhash64("key", "body"))
    rows = rows.withColumn("part", F.pmod(F.col("identity"), F.lit(SMALLER * dealt)).cast("int"))
    ordered = rows.filter(F.col("key").isNotNull())

    # Texts equal to one with a smaller key.
    ids = ordered.select("key", "identity", "part", F.md5("body").alias("digest"), F.length("body").alias("n"))
    first = ids.groupBy("digest", "n").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last")
    copies = ids.join(first, ["digest", "n"]).filter("key > first").select("part", "identity").distinct()
    copied = copies.groupBy(F.col("part").alias("to_part")).agg(F.sort_array(F.collect_list("identity")).alias("copies"))

    def shard_of(anchor: np.ndarray) -> np.ndarray:
        return ((anchor >> np.uint64(32)) % np.uint64(dealt)).astype(np.int64)

    def part_of(table: pa.Table) -> int:
        return table.column("part")[0].as_py() if table.num_rows else 0

    def skipped(table: pa.Table) -> np.ndarray:
        lists = [v for v in table.column("copies").to_pylist() if v]
        return np.array([x for v in lists for x in v], np.int64)

    def sent(left: pa.Table, right: pa.Table) -> pa.Table:
        """The anchors of a group, by shard: 32 bits each, whether two of its texts have it, and its kinds of surroundings."""
        texts = Texts(left, skipped(right))
        row, anchor, _, _, prints = texts.windows(size)
        order = np.lexsort((prints, anchor)) if len(row) else np.zeros(0, np.int64)
        anchor, owner, prints = anchor[order], texts.keys[row][order], prints[order]
        begin = np.flatnonzero(np.append([True], anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, np.int64)
        twice, kinds = np.zeros(0, bool), np.zeros(0, np.uint32)
        if len(begin):
            twice = np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin)
            other = np.append([True], (prints[1:] != prints[:-1]) | (anchor[1:] != anchor[:-1]))
            kinds = np.add.reduceat(other.astype(np.uint32), begin)
        anchor = anchor[begin]
        use, pick = _by(shard_of(anchor), dealt)
        low = anchor.astype(np.uint32)
        return pa.table(
            {
                "shard": pa.array(use, pa.int32()),
                "part": pa.array([part_of(left)] * len(use), pa.int32()),
                "anchors": pa.array([low[p].tobytes() for p in pick], pa.binary()),
                "twice": pa.array([np.packbits(twice[p]).tobytes() for p in pick], pa.binary()),
                "kinds": pa.array([kinds[p].astype(np.uint32).tobytes() for p in pick], pa.binary()),
            }
        )

    def shared(table: pa.Table) -> pa.Table:
        """Of the anchors of one shard, give each group those that another text has, and which of them are hot."""
        values = [np.frombuffer(v, np.uint32) for v in table.column("anchors").to_pylist()]
        flags = [
            np.unpackbits(np.frombuffer(f, np.uint8), count=len(v)).astype(bool)
            for f, v in zip(table.column("twice").to_pylist(), values, strict=True)
        ]
        every = np.concatenate(values)
        order = np.argsort(every, kind="stable")
        every, kinds = every[order], _numbers(table, "kinds", np.uint32).astype(np.int64)[order]
        begin = np.flatnonzero(np.append([True], every[1:] != every[:-1]))
        many = every[begin][np.add.reduceat(kinds, begin) > hot]
        often = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *[v[f] for v, f in zip(values, flags, strict=True)]]))
        kept = [v[_in(v, often)] for v in values]
        shard = table.column("shard")[0].as_py()
        full = [np.uint64(shard) << np.uint64(32) | k.astype(np.uint64) for k in kept]
        some = [i for i, k in enumerate(kept) if len(k)]
        return pa.table(
            {
                "to_part": pa.array([table.column("part")[i].as_py() for i in some], pa.int32()),
                "anchors": pa.array([full[i].tobytes() for i in some], pa.binary()),
                "many": pa.array([full[i][_in(kept[i], many)].tobytes() for i in some], pa.binary()),
            }
        )

    by_part = ordered.groupBy("part")
    anchors = by_part.cogroup(copied.groupBy("to_part")).applyInArrow(sent, "shard int, part int, anchors binary, twice binary, kinds binary")
    candidates = anchors.groupBy("shard").applyInArrow(shared, "to_part int, anchors binary, many binary")
    wanted = candidates.withColumn("copies", F.lit(None).cast("array<long>")).unionByName(
        copied.withColumn("anchors", F.lit(None).cast("binary")).withColumn("many", F.lit(None).cast("binary"))
    )

    def asked(left: pa.Table, right: pa.Table) -> pa.Table:
        """The prints at the wanted anchors of a group, by shard, each once with its least key."""
        texts = Texts(left, skipped(right))
        row, anchor, _, _, prints = texts.windows(size)
        want = np.sort(_numbers(right, "anchors", np.uint64))
        short = shard_of(anchor).astype(np.uint64) << np.uint64(32) | (anchor & np.uint64(0xFFFFFFFF))
        use = np.flatnonzero(_in(short, want))
        use = use[np.lexsort((texts.keys[row[use]], prints[use]))]
        use = use[np.append([True], prints[use][1:] != prints[use][:-1])] if len(use) else use
        many = _in(short[use], np.sort(_numbers(right, "many", np.uint64)))
        spread = (mixed(prints[use]) % np.uint64(dealt)).astype(np.int64)
        shards, pick = _by(np.where(many, spread, shard_of(anchor[use])), dealt)
        flags = [np.packbits(many[p]).tobytes() for p in pick]
        pick = [use[p] for p in pick]
        return pa.table(
            {
                "shard": pa.array(shards, pa.int32()),
                "part": pa.array([part_of(left)] * len(shards), pa.int32()),
                "anchors": pa.array([anchor[p].astype(np.uint32).tobytes() for p in pick], pa.binary()),
                "prints": pa.array([prints[p].tobytes() for p in pick], pa.binary()),
                "owner": pa.array([texts.keys[row[p]].tobytes() for p in pick], pa.binary()),
                "many": pa.array(flags, pa.binary()),
            }
        )

    def compared(table: pa.Table) -> pa.Table:
        """For each group: the prints that a smaller key has elsewhere, and those to be looked into.

        The latter are the first of their kind, at anchors with several kinds or (``many``) at hot ones.
        """
        counts = [len(v) // 8 for v in table.column("owner").to_pylist()]
        part = np.repeat(table.column("part").to_numpy(), counts)
        anchor, prints, owner = (_numbers(table, c, k) for c, k in (("anchors", np.uint32), ("prints", np.uint64), ("owner", np.int64)))
        kinds, least = _least(prints, owner)
        later = least[np.searchsorted(kinds, prints)] < owner
        flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=n).astype(bool) for f, n in zip(table.column("many").to_pylist(), counts, strict=True)]
        many = np.concatenate(flags)
        first = np.flatnonzero(~later & ~many)
        some, n = np.unique(anchor[first], return_counts=True)
        open_ = first[_in(anchor[first], some[n > 1])]
        out = {"to_part": [], "gone": [], "open": [], "many": []}
        for p in np.unique(part):
            mine = part == p
            gone = prints[mine & later]
            look = prints[open_[part[open_] == p]]
            single = prints[mine & many & ~later]
            if len(gone) or len(look) or len(single):
                out["to_part"].append(int(p))
                out["gone"].append(gone.tobytes())
                out["open"].append(look.tobytes())
                out["many"].append(single.tobytes())
        return pa.table({k: pa.array(v, pa.int32() if k == "to_part" else pa.binary()) for k, v in out.items()})

    def apart(texts: Texts, row, low, high, prints, many) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, print) of each window at the first of their kind of hot anchors."""
        use = np.flatnonzero(_in(prints, np.sort(many)))
        kinds, least = _least(prints[use], texts.keys[row[use]])
        use = use[texts.keys[row[use]] == least[np.searchsorted(kinds, prints[use])]]
        entry, start = _spread(low[use], high[use])
        r = row[use][entry]
        return r, start, _window_prints(texts.body, texts.at[r] + start, size)

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        """The bytes at the open prints of a group, by shard of their anchors; at hot anchors each window by its own."""
        texts = Texts(left, skipped(right))
        row, anchor, low, high, prints = texts.windows(size)
        use = np.flatnonzero(_in(prints, np.sort(_numbers(right, "open", np.uint64))))
        kinds, least = _least(prints[use], texts.keys[row[use]])
        use = use[texts.keys[row[use]] == least[np.searchsorted(kinds, prints[use])]]
        shards, pick = _by(shard_of(anchor[use]), dealt)
        data = texts.body.tobytes()
        out = {k: [] for k in ("shard", "part", "context", "size", "owner", "bucket", "identity", "low")}
        for k, p in zip(shards, pick, strict=True):
            mine = use[p]
            r = row[mine]
            begin, stop = texts.at[r] + low[mine], texts.at[r] + high[mine] + size
            out["shard"].append(k)
            out["part"].append(part_of(left))
            out["context"].append(b"".join([data[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]))
            out["size"].append((stop - begin).astype(np.uint32).tobytes())
            out["owner"].append(texts.keys[r].tobytes())
            out["bucket"].append(anchor[mine].tobytes())
            out["identity"].append(texts.identity[r].tobytes())
            out["low"].append(low[mine].astype(np.uint32).tobytes())
        r, start, window = apart(texts, row, low, high, prints, _numbers(right, "many", np.uint64))
        use = np.lexsort((texts.keys[r], window))
        use = use[np.append([True], window[use][1:] != window[use][:-1])] if len(use) else use
        shards, pick = _by((mixed(window[use]) % np.uint64(dealt)).astype(np.int64), dealt)
        for k, p in zip(shards, pick, strict=True):
            mine = use[p]
            begin = texts.at[r[mine]] + start[mine]
            out["shard"].append(k)
            out["part"].append(part_of(left))
            out["context"].append(b"".join([data[a : a + size] for a in begin.tolist()]))
            out["size"].append(np.full(len(mine), size, np.uint32).tobytes())
            out["owner"].append(texts.keys[r[mine]].tobytes())
            out["bucket"].append(window[mine].tobytes())
            out["identity"].append(None)
            out["low"].append(None)
        kinds = {"shard": pa.int32(), "part": pa.int32()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})

    def found(table: pa.Table) -> pa.Table:
        """What repeats in one shard, for each group: (identity, start, stop), and prints of windows of hot anchors."""
        lists = table.column("owner").to_pylist()
        counts = [len(v) // 8 for v in lists]
        part = np.repeat(table.column("part").to_numpy(), counts)
        window = np.repeat([v is None for v in table.column("identity").to_pylist()], counts)
        sizes = _numbers(table, "size", np.uint32).astype(np.int64)
        owner, bucket = _numbers(table, "owner", np.int64), _numbers(table, "bucket", np.uint64)
        identity, low = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        identity[~window], low[~window] = _numbers(table, "identity", np.int64), _numbers(table, "low", np.uint32)
        data = b"".join(table.column("context").to_pylist())
        stop = np.cumsum(sizes)
        order = np.lexsort((bucket, window))
        items, insides = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # Equal windows have equal anchors, and so one bucket: a suffix array takes some whole buckets.
        for a, b in _cuts(bucket[order], sizes[order], ARRAY):
            of = order[a:b]
            strings = [data[x:y] for x, y in zip((stop - sizes)[of].tolist(), stop[of].tolist(), strict=True)]
            item, inside = _gone(strings, owner[of], size)
            items.append(of[item])
            insides.append(inside)
        item, inside = np.concatenate(items), np.concatenate(insides)
        lost = item[window[item]]
        item, inside = item[~window[item]], inside[~window[item]]
        fresh = np.ones(len(item), bool)
        fresh[1:] = (item[1:] != item[:-1]) | (inside[1:] != inside[:-1] + 1)
        begin = np.flatnonzero(fresh)
        last = np.append(begin[1:], len(item)) - 1 if len(begin) else begin
        of = item[begin]
        start, end = low[of] + inside[begin], low[of] + inside[last] + size
        names = np.unique(np.concatenate([part[of], part[lost]]))
        pick = [np.flatnonzero(part[of] == k) for k in names]
        return pa.table(
            {
                "to_part": pa.array(names, pa.int32()),
                "identity": pa.array([identity[of[p]].tobytes() for p in pick], pa.binary()),
                "start": pa.array([start[p].astype(np.uint32).tobytes() for p in pick], pa.binary()),
                "stop": pa.array([end[p].astype(np.uint32).tobytes() for p in pick], pa.binary()),
                "windows": pa.array([bucket[lost[part[lost] == k]].tobytes() for k in names], pa.binary()),
            }
        )

    prints = by_part.cogroup(wanted.groupBy("to_part")).applyInArrow(
        asked, "shard int, part int, anchors binary, prints binary, owner binary, many binary"
    )
    verdicts = prints.groupBy("shard").applyInArrow(compared, "to_part int, gone binary, open binary, many binary")

    def beside(df: DataFrame, **kinds: str) -> DataFrame:
        return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])

    told = beside(verdicts, copies="array<long>").unionByName(beside(copied, gone="binary", open="binary", many="binary"))
    places = by_part.cogroup(told.groupBy("to_part")).applyInArrow(
        contexts, "shard int, part int, context binary, size binary, owner binary, bucket binary, identity binary, low binary"
    )
    spans = places.groupBy("shard").applyInArrow(found, "to_part int, identity binary, start binary, stop binary, windows binary")
    every = beside(told, identity="binary", start="binary", stop="binary", windows="binary").unionByName(
        beside(spans, copies="array<long>", gone="binary", open="binary", many="binary")
    )

    def applied(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = Texts(left, skipped(right))
        who, start, stop = (_numbers(right, c, k) for c, k in (("identity", np.int64), ("start", np.uint32), ("stop", np.uint32)))
        row, _, first, last, prints = texts.windows(size)
        kinds, least = _least(prints, texts.keys[row])
        lost = _in(prints, np.sort(_numbers(right, "gone", np.uint64)))
        if len(row):
            lost |= least[np.searchsorted(kinds, prints)] < texts.keys[row]
        # Of hot anchors, windows that a smaller key has elsewhere or in this group.
        r, begin, window = apart(texts, row, first, last, prints, _numbers(right, "many", np.uint64))
        kinds, least = _least(window, texts.keys[r])
        taken = _in(window, np.sort(_numbers(right, "windows", np.uint64)))
        if len(r):
            taken |= least[np.searchsorted(kinds, window)] < texts.keys[r]
        who = np.concatenate([who, texts.identity[row[lost]], texts.identity[r[taken]]])
        start = np.concatenate([start.astype(np.int64), first[lost], begin[taken]])
        stop = np.concatenate([stop.astype(np.int64), last[lost] + size, begin[taken] + size])
        order = np.lexsort((start, who))
        who, start, stop = who[order], start[order], stop[order]
        lists, left_over = [], []
        data = texts.body.tobytes()
        low, high = np.searchsorted(who, texts.identity, "left"), np.searchsorted(who, texts.identity, "right")
        for i in range(len(texts.keys)):
            n = int(texts.at[i + 1] - texts.at[i])
            if texts.copy[i]:
                lists.append([{"start": 0, "stop": n}] if n >= size else [])
            else:
                lists.append(_union(start[low[i] : high[i]].tolist(), stop[low[i] : high[i]].tolist()))
            left_over.append(kept_bytes(data[texts.at[i] : texts.at[i + 1]], lists[-1]))
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        out = {
            "key": texts.table.column("key"),
            "n_bytes": pa.array(np.diff(texts.at)),
            "spans": pa.array(lists, spans_type),
            "kept": pa.array(left_over, pa.binary()),
        }
        return pa.table(out | ({"rest": texts.table.column("rest")} if keep else {}))

    span_type = "array<struct<start: long, stop: long>>"
    loose = rows.filter(F.col("key").isNull()).select(
        "key", F.length("body").cast("long").alias("n_bytes"), F.array().cast(span_type).alias("spans"), F.col("body").alias("kept"),
        *(["rest"] if keep else []),
    )
    done = by_part.cogroup(every.groupBy("to_part")).applyInArrow(applied, loose.schema)
    return done.unionByName(loose).withColumnRenamed("key", key), prints, places


def without_repeats(docs: DataFrame, size: int = 50, key="doc_id", text="text", length: str | None = None) -> DataFrame:
    """The documents, with all their columns, without what earlier ones have.

    Characters that lose a byte go as a whole; texts of which nothing is left go with their rows.
    Null and empty texts stay as they are. ``length`` names a column of the number of characters,
    which is set anew.
    """
    other = [c for c in docs.columns if c not in (key, text)]
    null = free_name("_null", docs.columns)
    marked = docs.withColumn(null, F.col(text).isNull())
    found = repeats(marked, size, key, text, *other, null).filter("n_bytes = 0 or length(kept) > 0")
    kind = found.schema["kept"]

    def decode(batches):
        at = None
        for batch in batches:
            at = batch.schema.names.index("kept") if at is None else at
            texts = [None if v is None else v.decode("utf-8", "ignore") for v in batch.column(at).to_pylist()]
            yield batch.set_column(at, "kept", pa.array(texts, pa.string()))

    fields = [f if f.name != "kept" else StructField("kept", StringType(), kind.nullable) for f in found.schema.fields]
    read = found.mapInArrow(decode, StructType(fields))
    whole = F.when(~F.col("rest").getField(null), F.col("kept")).cast(docs.schema[text].dataType)
    columns = {key: F.col(key), text: whole} | {c: F.col("rest").getField(c) for c in other}
    out = read.select(*[columns[c].alias(c) for c in docs.columns])
    if length in out.columns:
        fresh = F.char_length(text).cast(docs.schema[length].dataType)
        out = out.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(fresh))
    return out


def _union(starts: list[int], stops: list[int]) -> list[dict]:
    out = []
    for a, b in zip(starts, stops, strict=True):
        if out and a <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], b)
        else:
            out.append({"start": a, "stop": b})
    return out


def kept_bytes(body: bytes, spans) -> bytes:
    """What is left of a text without its spans."""
    at, parts = 0, []
    for s in spans:
        parts.append(body[at : s["start"]])
        at = s["stop"]
    return b"".join([*parts, body[at:]])


def brute(rows: list[tuple[int, bytes]], size: int) -> list[tuple]:
    """The same for a few rows, by a table of all strings: for tests."""
    first: dict[bytes, int] = {}
    for k, b in rows:
        for i in range(len(b) - size + 1):
            s = b[i : i + size]
            first[s] = min(first.get(s, k), k)
    out = []
    for k, b in rows:
        gone = [i for i in range(len(b) - size + 1) if first[b[i : i + size]] < k]
        spans = _union(gone, [i + size for i in gone])
        out.append((k, len(b), sum(s["stop"] - s["start"] for s in spans), len(spans), hashlib.sha256(kept_bytes(b, spans)).hexdigest()))
    return out
