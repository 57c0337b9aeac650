"""Near-duplicate join on word shingles by chosen paths."""

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import blocks, free_name, rebatched, release, texts_of
from corpusaudit.llm.components import components
from corpusaudit.llm.hashing import lowered, mixed, span_hashes, window_hashes, word_spans
from corpusaudit.session import materialise

WORDS = 5
#: Coordinates of a set: least values under so many hash functions. Equal shares are likely as the
#: sets are similar, so a coordinate stands for a token sampled from both sets alike.
COORDINATES = 64
#: Buckets of at most so many sets are compared by brute force; deeper ones are cut into tiles.
BUCKET = 512
DEPTH = 3
BLOCK = 1 << 18
#: Rows of a tile's batch, beyond the last whole tile.
ROWS = 1000
PAIRS = 60_000

_A = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_B = mixed(np.arange(1001, 1001 + COORDINATES, dtype=np.uint64))


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair just at the threshold has met in a bucket with this probability.

    In each node such a pair shares one chosen coordinate on average, so that it lives on as a
    branching process with one Poisson child; it is met if it lives through ``depth`` splits.
    """
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def shingle_sets(body: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted set of hashed five-word shingles of each text; fewer words are one shingle."""
    body = lowered(body)
    row, start, stop = word_spans(body, at)
    words = span_hashes(body, start, stop)
    shingle_row, shingles = window_hashes(row, words, WORDS)
    n = len(at) - 1
    cut = np.searchsorted(shingle_row, np.arange(n + 1))
    word_cut = np.searchsorted(row, np.arange(n + 1))
    out = []
    for i in range(n):
        if cut[i] < cut[i + 1]:
            out.append(np.unique(shingles[cut[i] : cut[i + 1]]))
        else:
            few = words[word_cut[i] : word_cut[i + 1]]
            out.append(np.bitwise_xor.reduce(mixed(few + np.arange(len(few), dtype=np.uint64)), keepdims=True) if len(few) else few)
    return out


def node_of(shingles: np.ndarray) -> np.int64:
    """64-bit identity of a set."""
    return mixed(np.sum(mixed(shingles), dtype=np.uint64, keepdims=True) + np.uint64(len(shingles))).view(np.int64)[0]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Least values of each set (none may be empty) under each hash function."""
    every = np.concatenate(sets)
    begin = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        value = ((every * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(value, begin)
    return out


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, node, n, sketch) of each document with a word."""
    kind = dict(docs.dtypes)[key]

    def work(batches):
        for batch in rebatched(batches, "text", BLOCK):
            sets = shingle_sets(*texts_of(batch.column("text")))
            use = [i for i, s in enumerate(sets) if len(s)]
            some = [sets[i] for i in use]
            sketch = sketches(some) if some else []
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(use, pa.int64())),
                    batch.column("row").take(pa.array(use, pa.int64())),
                    pa.array([int(node_of(s)) for s in some], pa.int64()),
                    pa.array([len(s) for s in some], pa.int32()),
                    pa.array([x.tobytes() for x in sketch], pa.binary()),
                ],
                names=["key", "row", "node", "n", "sketch"],
            )

    rows = identified(docs, key, text).filter(F.col("key").isNotNull()).select("key", "row", "text")
    return rows.mapInArrow(work, f"key {kind}, row long, node long, n int, sketch binary")


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key and text of each row, and an identity that rows equal in both share."""
    return docs.select(
        F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("row")
    )


def _children(path: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path): each node of the tree samples coordinates, and a set goes on by its values."""
    most = np.uint64(int(2**64 / (threshold * COORDINATES)))
    rows, paths = [], []
    for k in range(COORDINATES):
        chosen = np.flatnonzero(mixed(path + _B[k]) < most)
        rows.append(chosen)
        paths.append(mixed(path[chosen] * _A[k] + sketch[chosen, k]))
    return np.concatenate(rows), np.concatenate(paths)


def _split(nodes: DataFrame, threshold: float, runs: int | None) -> DataFrame:
    """(path, node) one level down, from the roots of all runs or from the paths of ``nodes``."""

    def work(batches):
        for batch in batches:
            node = batch.column("node").to_numpy()
            sketch = np.frombuffer(texts_of(batch.column("sketch"))[0], np.uint32).reshape(-1, COORDINATES)
            if runs is None:
                starts = [batch.column("path").to_numpy().view(np.uint64)]
            else:
                starts = [np.full(len(node), r, np.uint64) for r in mixed(np.arange(7001, 7001 + runs, dtype=np.uint64))]
            for path in starts:
                row, child = _children(path, sketch, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(node[row])], names=["path", "node"])

    return nodes.mapInArrow(work, "path long, node long")


def buckets(nodes: DataFrame, threshold: float, runs: int) -> DataFrame:
    """(path, node, size) of all buckets that need no further split: small ones, or at full depth."""
    done = None
    level = _split(nodes.select("node", "sketch"), threshold, runs)
    for depth in range(1, DEPTH + 1):
        level = materialise(level)
        sizes = level.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
        counted = level.join(sizes, "path")
        ready = counted if depth == DEPTH else counted.filter(F.col("size") <= BUCKET)
        done = ready if done is None else done.unionByName(ready)
        if depth < DEPTH:
            deeper = counted.filter(F.col("size") > BUCKET).join(nodes.select("node", "sketch"), "node")
            level = _split(deeper.select("path", "node", "sketch"), threshold, None)
    return materialise(done)


def whole_groups(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows, cut anew so that no group of equal ``names`` is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        same = np.ones(table.num_rows, bool)
        for n in names:
            x = table.column(n).to_numpy()
            same &= x == x[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield from _cut(table.slice(0, cut), names)
        rest = table.slice(cut).combine_chunks()
        held = rest.to_batches()
    if held:
        yield from _cut(pa.Table.from_batches(held).combine_chunks(), names)
    release()


def _cut(table: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole groups, about ROWS rows at a time."""
    fresh = np.zeros(table.num_rows, bool)
    for n in names:
        x = table.column(n).to_numpy()
        fresh[1:] |= x[1:] != x[:-1]
    begin = np.append(np.flatnonzero(fresh), table.num_rows)
    start = 0
    while start < table.num_rows:
        stop = int(begin[min(np.searchsorted(begin, start + ROWS), len(begin) - 1)])
        yield table.slice(start, stop - start).combine_chunks().to_batches()[0]
        start = stop


def _pairs(begin: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within groups that start at ``begin``, some at a time."""
    ends = np.append(begin[1:], n)
    end = np.repeat(ends, ends - begin)
    more = end - 1 - np.arange(n)
    total = np.cumsum(more)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + PAIRS, "right")))
        c = more[first:last]
        i = np.repeat(np.arange(first, last), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        yield i, j
        first = last


def likely(batch: pa.RecordBatch, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one tile that may be similar enough, and whose first common bucket this is.

    Sketches must agree in a share that a pair at the threshold stays under once in some 10,000
    cases. A pair that meets in several buckets is left to the one with the least path.
    """
    n = batch.num_rows
    if not n:
        return
    path, a, b, part = (batch.column(c).to_numpy() for c in ("path", "a", "b", "part"))
    size = batch.column("n").to_numpy()
    sketch = np.frombuffer(texts_of(batch.column("sketch"))[0], np.uint32).reshape(-1, COORDINATES)
    lists = batch.column("paths").to_pylist()
    width = max(map(len, lists))
    paths = np.array([x + [np.iinfo(np.int64).max] * (width - len(x)) for x in lists], np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = (path[1:] != path[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = COORDINATES * threshold - 3.7 * math.sqrt(COORDINATES * threshold * (1 - threshold))
    for i, j in _pairs(np.flatnonzero(fresh), n):
        low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        use = (low >= threshold * high) & ((a[i] == b[i]) | (part[i] != part[j]))
        i, j = i[use], j[use]
        use = (sketch[i] == sketch[j]).sum(1) >= least
        i, j = i[use], j[use]
        earlier = np.zeros(len(i), bool)
        for k in range(width):
            mine = paths[i, k]
            ask = np.flatnonzero((mine < path[i]) & ~earlier)
            if len(ask):
                earlier[ask] = (paths[j[ask]] == mine[ask, None]).any(1)
        if not earlier.all():
            yield i[~earlier], j[~earlier]


def _met(batches, threshold: float):
    """The rows of each tile that have a likely partner there."""
    for batch in whole_groups(batches, ["path", "a", "b"]):
        use = np.zeros(batch.num_rows, bool)
        for i, j in likely(batch, threshold):
            use[i] = use[j] = True
        yield batch.filter(pa.array(use))


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    rows, inverse = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = inverse[: len(i)], inverse[len(i) :]
    sets = [sets[r] for r in rows]
    if len(i) < 2 * len(sets):
        return np.array([len(sets[x]) + len(sets[y]) - len(np.union1d(sets[x], sets[y])) for x, y in zip(i, j, strict=True)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    often = counts > 1  # tokens of one set alone are in no intersection
    column = np.cumsum(often) - 1
    use = often[token]
    owner, token = owner[use], column[token[use]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    for start in range(0, int(often.sum()), 4096):
        lo, hi = np.searchsorted(token, [start, start + 4096])
        block = np.zeros((len(sets), 4096), np.float32)
        block[owner[lo:hi], token[lo:hi] - start] = 1
        total += block @ block.T
    return total[i, j].astype(np.int64)


def _verified(batches, threshold: float):
    """(node, root, links): exact links of each row of a tile, and a forest that joins linked rows."""
    for batch in whole_groups(batches, ["path", "a", "b"]):
        column = batch.column("text")
        sets = [s for a, b in blocks(column, BLOCK) for s in shingle_sets(*texts_of(column.slice(a, b - a)))]
        node = batch.column("node").to_numpy()
        # A key may stand for several texts: only the text of this very set counts, and once.
        right = np.array([len(s) > 0 and int(node_of(s)) == m for s, m in zip(sets, node, strict=True)], bool)
        tile = np.stack([batch.column(c).to_numpy() for c in ("path", "a", "b")], 1)
        right[1:] &= ~((node[1:] == node[:-1]) & (tile[1:] == tile[:-1]).all(1) & right[:-1])
        batch = batch.filter(pa.array(right))
        sets = [s for s, ok in zip(sets, right, strict=True) if ok]
        node = node[right]
        root, links = node.copy(), np.zeros(len(node), np.int64)
        for i, j in likely(batch, threshold):
            # Pairs come group by group; each group's sets are put side by side.
            group = _tiles(batch)[i]
            cuts = np.append(np.flatnonzero(np.append([True], group[1:] != group[:-1])), len(i))
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                p, q = i[x:y], j[x:y]
                both = _shared(sets, p, q)
                n = np.array([len(sets[r]) for r in p]) + np.array([len(sets[r]) for r in q]) - both
                ok = both >= threshold * n - 1e-9
                p, q = p[ok], q[ok]
                np.add.at(links, p, 1)
                np.add.at(links, q, 1)
                while True:
                    least = np.minimum(root[p], root[q])
                    if (least == root[p]).all() and (least == root[q]).all():
                        break
                    np.minimum.at(root, p, least)
                    np.minimum.at(root, q, least)
        use = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[use]), pa.array(root[use]), pa.array(links[use])], names=["node", "root", "links"]
        )


def _tiles(batch: pa.RecordBatch) -> np.ndarray:
    x = np.stack([batch.column(c).to_numpy() for c in ("path", "a", "b")], 1)
    return np.cumsum(np.append([0], (x[1:] != x[:-1]).any(1)))


def near_classes(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, key="doc_id", text="text") -> DataFrame:
    """(key, row, component, class_id, set_id, n_copies, n_links) of each row with a word and a key.

    Texts are sets of five-word shingles, in lower case. Sets are split on sampled coordinates along
    chosen paths until buckets are small; runs are repeated until a pair at the threshold is met
    with probability ``recall``. Pairs in a bucket are filtered by sketch and then verified exactly
    on their shingles. ``n_links`` counts the other sets at Jaccard ``threshold`` or more,
    ``n_copies`` the rows with the same set, ``set_id`` is their least key and ``class_id`` the
    least key of all that hang together. Rows of equal sets are one row in all of this work.

    No pair leaves a task: tiles give each set its number of links and one edge. A group of near
    copies larger than a bucket is cut into tiles of two parts, each a task's share.
    """
    found = materialise(signatures(docs, key, text))
    nodes = materialise(
        found.groupBy("node").agg(
            F.min("key").alias("first"), F.count("*").alias("copies"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")
        )
    )
    ready = buckets(nodes, threshold, runs_for(recall))
    paths = ready.groupBy("node").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    facts = nodes.select("node", "n", "sketch", "first").join(paths, "node")
    parts = F.ceil(F.col("size") / BUCKET).cast("int")
    tiles = (
        ready.withColumn("part", F.pmod(F.col("node"), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("path", "node", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
        .join(facts, "node")
    )
    schema = ", ".join(f"{c} {t}" for c, t in tiles.dtypes)
    dealt = lambda df: df.repartition("path", "a", "b").sortWithinPartitions("path", "a", "b", "node")
    met = materialise(dealt(tiles).mapInArrow(lambda x: _met(x, threshold), schema))
    bodies = docs.select(F.col(key).alias("first"), F.col(text).cast("string").alias("text"))
    with_text = met.join(bodies, "first")
    linked = materialise(dealt(with_text).mapInArrow(lambda x: _verified(x, threshold), "node long, root long, links long"))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(linked.filter("node != root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    classes = (
        nodes.select("node", "first", "copies")
        .join(joined.select(F.col("u").alias("node"), F.col("root").alias("joined")), "node", "left")
        .join(links, "node", "left")
        .withColumn("component", F.coalesce("joined", "node"))
    )
    least = classes.groupBy("component").agg(F.min("first").alias("class_id"))
    told = classes.join(least, "component").select(
        "node", "component", "class_id", F.col("first").alias("set_id"), F.col("copies").alias("n_copies"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )
    return found.select("key", "row", "node").join(told, "node").select(
        F.col("key").alias(key), "row", "component", "class_id", "set_id", "n_copies", "n_links"
    )


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, key="doc_id", text="text") -> DataFrame:
    """(key, class_id, set_id, n_copies, n_links): one row for each row of the input.

    Null and empty texts and texts of white space have no shingles: each such row is a class of its
    own with no links. Rows with a null key take part in no class: their class is null. Repeated
    rows are copies; an empty table gives an empty one; other columns are left out.
    """
    classes = near_classes(docs, threshold, recall, key, text)
    blank = docs.filter(F.col(key).isNull() | F.coalesce(~F.col(text).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    alone = blank.select(
        key, F.col(key).alias("class_id"), F.col(key).alias("set_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links")
    )
    return classes.drop("row", "component").unionByName(alone)


def one_of_each(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, key="doc_id", text="text") -> DataFrame:
    """The documents, with all their columns, without those that resemble one with a smaller key.

    Of each class the row with the least key stays, of repeated rows one; rows without a key or
    without a word all stay.
    """
    row = F.xxhash64(F.col(key), F.col(text).cast("string"))
    mark = free_name("_row", docs.columns)
    first = near_classes(docs, threshold, recall, key, text).filter(F.col(key) == F.col("class_id")).groupBy("component").agg(
        F.min("row").alias(mark)
    )
    blank = F.col(key).isNull() | F.coalesce(~F.col(text).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    marked = docs.filter(~blank).withColumn(mark, row)
    kept = marked.join(first.select(mark), mark, "left_semi").dropDuplicates([mark]).drop(mark)
    return kept.unionByName(docs.filter(blank))
