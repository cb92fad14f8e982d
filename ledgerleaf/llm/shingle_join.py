"""Jaccard self-join of word shingles with R-trees of count vectors.

1. Each text becomes its set of hashed shingles; texts with equal sets are one class.
2. Two sets with similarity t share one of the n - ceil(t n) + 1 first shingles of either in any common order. The order puts the
   HEAVY most frequent shingles last, which tasks propose from all that they have read, so a passage that many documents share
   brings no two of them together unless it makes up most of both. Classes that share such a shingle meet in the territory of
   the smallest of them.
3. In a territory a class is a point: its shingles hashed into groups, the counts of the groups its coordinates. An R-tree
   holds the points; the sum of coordinate minima of a point and a box (or point) bounds the shingles they can share, which
   drops boxes and pairs. Pairs that are left are verified on the sets, unless both are already in one component.
4. Links become components of classes, and these components of documents.

In a territory of more than a block each class is first compared with one of them, its pivot. Those that link with it are in one
component, so only the others are compared with all: large groups of near copies cost as much as they hold, not its square. What is
left is cut into blocks, each pair of blocks is one task. No step holds a list of all partners of a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import WordHasher, components, mixed, parts, release, saved

WORDS, PERCENT = 5, 80
#: Shingles of the table of frequent ones, as it is broadcast; how many each task proposes, and shingles that it counts at once; points of a box; classes of a block.
HEAVY, PROPOSED, COUNTED, BOX, BLOCK = 1 << 17, 1 << 13, 1 << 20, 16, 1024
#: Numbers of groups, and the most shingles of a set that gets as many.
GROUPS, MOST = (64, 256, 1024, 4096, 16384, 65536), (800, 3200, 12800, 51200, 204800)
#: Classes that a task remembers so as not to name them again; candidate rows up to which they are broadcast.
REMEMBERED, BROADCAST_ROWS = 1_000_000, 1_000_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Texts (UTF-8, or null) to sorted arrays of distinct shingle hashes."""

    def __init__(self) -> None:
        self.words = WordHasher()

    def __call__(self, text: bytes | None) -> np.ndarray:
        h = self.words(text or b"")[0]
        if len(h) <= 1:
            return h
        size = min(WORDS, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - size + 1, size, np.uint64)
            for i in range(size):
                out ^= h[i : len(h) - size + 1 + i]
                out *= _SPREAD
                out ^= out >> np.uint64(29)
        out = mixed(out)
        out.sort()
        fresh = np.empty(len(out), bool)
        fresh[0] = True
        np.not_equal(out[1:], out[:-1], out=fresh[1:])
        return out[fresh]


def point_of(shingles: np.ndarray) -> np.ndarray:
    """Counts of the groups; a larger set has more of them, and those of a smaller number are sums of these.

    A text of less than 2 GB fills no group beyond 16 bits.
    """
    groups = next((g for g, most in zip(GROUPS, MOST, strict=False) if len(shingles) <= most), GROUPS[-1])
    return np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int16)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    return point if len(point) == groups else point.reshape(-1, groups).sum(0)


def class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), seed=len(shingles)) - (1 << 63)


class Frequent:
    """Counts of shingles that keep to the most frequent ones."""

    def __init__(self) -> None:
        self.ids, self.times, self.held, self.size = np.zeros(0, np.uint64), np.zeros(0), [], 0

    def add(self, shingles: np.ndarray) -> None:
        self.held.append(shingles)
        self.size += len(shingles)
        if self.size > COUNTED:
            self._fold()

    def _fold(self) -> None:
        own, seen = np.unique(np.concatenate(self.held), return_counts=True)
        own, seen = own[seen > 1], seen[seen > 1]
        self.ids, at = np.unique(np.concatenate([self.ids, own]), return_inverse=True)
        self.times = np.bincount(at, np.concatenate([self.times, seen]))
        self.held, self.size = [], 0
        if len(self.ids) > 8 * PROPOSED:
            most = np.argpartition(-self.times, 4 * PROPOSED)[: 4 * PROPOSED]
            self.ids, self.times = self.ids[most], self.times[most]

    def most(self) -> tuple[np.ndarray, np.ndarray]:
        if self.held:
            self._fold()
        order = np.argsort(-self.times, kind="stable")[:PROPOSED]
        return self.ids[order], self.times[order].astype(np.int64)


def text_id(text: Column) -> Column:
    return F.xxhash64(text)


def sketched(docs: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, text_id, n, class, point), and of the shingles that tasks propose as frequent (class: the shingle, times)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, frequent = Shingler(), Frequent()
        for b in parts(batches):
            sets = [shingler(t) for t in b["text"]]
            for s in sets:
                frequent.add(s)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_id": b["text_id"], "n": [len(s) for s in sets], "class": [class_of(s) for s in sets], "point": [point_of(s) for s in sets], "times": pd.array([None] * len(sets), "Int64")})
        ids, times = frequent.most()
        if len(ids):
            yield pd.DataFrame({"doc_id": [None] * len(ids), "text_id": 0, "n": 0, "class": ids.view(np.int64), "point": [None] * len(ids), "times": pd.array(times, "Int64")})

    told = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_id(F.col("text")).alias("text_id"), F.col("text").cast("binary").alias("text"))
    told = told.mapInPandas(each, "doc_id string, text_id long, n long, class long, point array<smallint>, times long")
    return told.withColumn("doc_id", F.col("doc_id").cast("long"))


def _ranks(sketch: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles, sorted, and of each the binary logarithm of its occurrences, as far as tasks have proposed it."""
    told = sketch.where("times is not null").groupBy("class").agg(F.sum("times").alias("n")).orderBy(F.desc("n"), "class").limit(HEAVY).toPandas()
    ids = told["class"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(ids)
    return ids[order], np.log2(told["n"].to_numpy(float)[order]).astype(np.int8)


def ranks_of(shingles: np.ndarray, ranks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ranks of shingles, 0 for those that aren't frequent."""
    ids, rank = ranks
    if not len(ids):
        return np.zeros(len(shingles), np.int8)
    at = np.minimum(np.searchsorted(ids, shingles), len(ids) - 1)
    return np.where(ids[at] == shingles, rank[at], 0)


def prefix(shingles: np.ndarray, ranks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of which any set that is similar enough shares one with its own first ones."""
    n = len(shingles)
    first = n - (n * PERCENT + 99) // 100 + 1
    own = ranks_of(shingles, ranks)
    return shingles[np.argsort(own, kind="stable")[:first]] if own.any() else shingles[:first]


def territories(docs: DataFrame, ranks: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(root, class), distinct: the classes that share a first shingle with ``root``, the smallest class that has it, and root itself."""
    send = docs.sparkSession.sparkContext.broadcast(ranks)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, seen = Shingler(), set()
        for b in parts(batches):
            found, owner = [], []
            for text in b["text"]:
                s = shingler(text)
                if len(s) and (c := class_of(s)) not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(c)
                    own = prefix(s, send.value)
                    found.append(own)
                    owner.append(np.full(len(own), c, np.int64))
            if found:
                yield pd.DataFrame({"key": np.concatenate(found).view(np.int64), "class": np.concatenate(owner)})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, root = None, 0
        for b in batches:
            if not len(b):
                continue
            k, c = b["key"].to_numpy(), b["class"].to_numpy()
            start = np.concatenate([[k[0] != key], k[1:] != k[:-1]])
            at = np.maximum.accumulate(np.where(start, np.arange(len(k)), -1))
            least = np.where(at >= 0, c[at], root)
            key, root = k[-1], least[-1]
            pairs = pd.DataFrame({"root": least, "class": c})[c != least].drop_duplicates()
            if len(pairs):
                yield pairs
                yield pd.DataFrame({"root": pairs["root"].unique(), "class": pairs["root"].unique()})

    named = docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(keys, "key long, class long")
    return named.repartition("key").sortWithinPartitions("key", "class").mapInPandas(meet, "root long, class long").distinct()


class Tree:
    """R-tree over points: levels of boxes from the leaves up. A box keeps the largest coordinates and the smallest size below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points.argmax(1), sizes))
        top, least = points[self.order], sizes[self.order]
        self.levels = [(top, least)]
        while len(top) > BOX:
            cuts = np.arange(0, len(top), BOX)
            top, least = np.maximum.reduceat(top, cuts), np.minimum.reduceat(least, cuts)
            self.levels.append((top, least))

    def near(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``points``, row of the tree's points) that may be similar enough, by bounds alone."""
        top, least = self.levels[-1]
        a, b = np.divmod(np.arange(len(points) * len(top)), len(top))
        for level in range(len(self.levels) - 1, -1, -1):
            top, least = self.levels[level]
            keep = [self.may(points[a[i : i + 65536]], sizes[a[i : i + 65536]], top[b[i : i + 65536]], least[b[i : i + 65536]]) for i in range(0, len(a), 65536)]
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            a, b = a[keep], b[keep]
            if level:
                a, b = np.repeat(a, BOX), (b[:, None] * BOX + np.arange(BOX)).ravel()
                inside = b < len(self.levels[level - 1][0])
                a, b = a[inside], b[inside]
        return a, self.order[b]

    @staticmethod
    def may(points: np.ndarray, sizes: np.ndarray, top: np.ndarray, least: np.ndarray) -> np.ndarray:
        shared = np.minimum(points, top).sum(1)
        return shared * (100 + PERCENT) >= PERCENT * (sizes + least)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test on two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < PERCENT * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = int((b[at] == a).sum())
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def _runs(batches: Iterator[pa.RecordBatch], lists: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Rows with equal root, low and high, which stand together: root, class, block and the list column as arrays."""
    held: pa.Table | None = None

    def cut(rows: pa.Table, ends: np.ndarray) -> Iterator[tuple]:
        root, kind, block = (rows[c].to_numpy() for c in ("root", "class", "block"))
        column = rows[lists].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        at, values = column.offsets.to_numpy(), column.values.to_numpy()
        for i, j in zip(ends[:-1], ends[1:], strict=True):
            yield root[i:j], kind[i:j], block[i:j], [values[at[k] : at[k + 1]] for k in range(i, j)]

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        if not len(rows):
            continue
        keys = np.stack([rows[c].to_numpy() for c in ("root", "low", "high")])
        ends = np.concatenate([[0], 1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0))])
        yield from cut(rows, ends)
        held = rows.slice(int(ends[-1]))
    if held is not None and len(held):
        yield from cut(held, np.array([0, len(held)]))
    held = None
    release()


def _candidates(block: np.ndarray, points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, each once, that the bounds don't exclude; of two blocks only between them."""
    sizes = np.array([p.sum() for p in points])
    few = np.stack([folded(p, GROUPS[0]) for p in points])
    one, two = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    a, b = Tree(few[two], sizes[two]).near(few[one], sizes[one])
    a, b = one[a], two[b]
    if block[one[0]] == block[two[0]]:
        a, b = a[a < b], b[a < b]
    wide = np.array([len(p) for p in points])
    for groups in GROUPS[1:]:
        keep = np.minimum(wide[a], wide[b]) < groups
        at = np.flatnonzero(~keep)
        rows = np.unique(np.concatenate([a[at], b[at]]))
        more = np.stack([folded(points[i], groups) for i in rows]) if len(rows) else few
        for i in range(0, len(at), 4096):
            now = at[i : i + 4096]
            p, q = a[now], b[now]
            keep[now] = Tree.may(more[np.searchsorted(rows, p)], sizes[p], more[np.searchsorted(rows, q)], sizes[q])
        a, b = a[keep], b[keep]
    return a, b


def with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, class) of those that may be similar to another one in their territory."""
    for root, kind, block, points in _runs(batches, "point"):
        if len(kind) > 1:
            a, b = _candidates(block, points)
            seen = np.unique(np.concatenate([a, b]))
            if len(seen):
                yield pa.RecordBatch.from_arrays([pa.array(root[seen]), pa.array(kind[seen])], ["root", "class"])


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): a spanning forest of the links among the classes of a territory, or between two of its blocks."""
    for _, kind, block, shingles in _runs(batches, "shingles"):
        if len(kind) < 2:
            continue
        sets = [s.view(np.uint64) for s in shingles]
        parent = list(range(len(sets)))

        def find(x: int, parent: list[int] = parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        a, b = _candidates(block, [point_of(s) for s in sets])
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if (p := find(i)) != (q := find(j)) and similar(sets[i], sets[j]):
                parent[max(p, q)] = min(p, q)
                out.append((i, j))
        if out:
            at = np.array(out)
            yield pa.RecordBatch.from_arrays([pa.array(kind[at[:, 0]]), pa.array(kind[at[:, 1]])], ["a", "b"])


def dealt(rows: DataFrame, kin: DataFrame) -> DataFrame:
    """``rows`` (root, class) with block, low and high: a row for each pair of blocks of its territory that it takes part in.

    In a territory of more than BLOCK classes, ``kin`` (root, class, ...), those that link with its pivot, have blocks of their own, which
    meet those of the others only.
    """
    marked = rows.join(kin.select("root", "class").distinct().withColumn("kin", F.lit(1)), ["root", "class"], "left").withColumn("kin", F.coalesce("kin", F.lit(0)))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    large = marked.groupBy("root").agg(blocks(F.sum("kin")).alias("_kin"), blocks(F.sum(1 - F.col("kin"))).alias("_others"), F.count("*").alias("_n")).where(F.col("_n") > BLOCK)
    large = saved(large.drop("_n"))
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    own = marked.join(large, "root", "left").withColumn("_others", F.coalesce("_others", F.lit(1))).withColumn("first", F.coalesce("_kin", F.lit(0)))
    turn = F.xxhash64("class")
    block = F.when(F.col("_kin").isNull(), 0).when(F.col("kin") == 1, F.pmod(turn, F.col("first"))).otherwise(F.col("first") + F.pmod(turn, F.col("_others"))).cast("int")
    begin = F.when(F.col("kin") * F.col("first") > 0, F.col("first")).otherwise(0)
    last = F.col("first") + F.col("_others") - 1
    paired = own.withColumn("block", block).withColumn("other", F.explode(F.when(begin <= last, F.sequence(begin, last))))
    return paired.select("root", "class", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def kin_of(found: DataFrame, sets: Callable[[DataFrame], DataFrame], ranks: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(root, class, pivot) of ``found`` (root, class) in territories of more than BLOCK classes: the classes that link with their territory's pivot, itself too.

    The pivot is the class whose shingles are the most frequent on average: of copies of one text that differ from each other, it
    is most like the text. Any class would do, as links are tested. ``sets`` gives (class, shingles) of classes.
    """
    large = saved(found.groupBy("root").count().where(F.col("count") > BLOCK).select("root"))
    if large.isEmpty():
        return large.select("root", F.col("root").alias("class"), F.col("root").alias("pivot"))
    members = found.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "root")
    own = saved(sets(saved(members.select("class").distinct())))
    send = found.sparkSession.sparkContext.broadcast(ranks)

    def common(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"class": b["class"], "common": [float(ranks_of(np.asarray(s, np.int64).view(np.uint64), send.value).mean()) for s in b["shingles"]]})
        release()

    told = members.join(own.mapInPandas(common, "class long, common double"), "class")
    pivots = saved(told.groupBy("root").agg(F.max_by("class", F.struct("common", "class")).alias("pivot")))
    middle = pivots.join(own.select(F.col("class").alias("pivot"), F.col("shingles").alias("_pivot")), "pivot")
    size = middle.agg(F.sum(F.size("_pivot"))).first()[0] or 0
    middle = F.broadcast(middle) if size <= BROADCAST_ROWS else middle
    shared, whole = F.size(F.array_intersect("shingles", "_pivot")), F.size("shingles") + F.size("_pivot")
    return saved(members.join(own, "class").join(middle, "root").where(100 * shared >= PERCENT * (whole - shared)).select("root", "class", "pivot"))


def together(rows: DataFrame) -> DataFrame:
    return rows.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "class")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(class, shingles) of ``docs`` (class, text) whose text is of that class."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for b in parts(batches):
            sets = [shingler(t) for t in b["text"]]
            yield pd.DataFrame({"class": b["class"], "shingles": [s.view(np.int64) for s in sets]})[[class_of(s) == c for s, c in zip(sets, b["class"], strict=True)]]

    return docs.select("class", F.col("text").cast("binary").alias("text")).mapInPandas(each, "class long, shingles array<long>")


def compared(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_id, n, class), one for each of ``docs`` (doc_id, text, ...), and classes (class, head, component) with their smallest id."""
    sketch = saved(sketched(docs))
    rows = sketch.where("times is null").select("doc_id", "text_id", "n", "class")
    heads = sketch.where("n > 0 and times is null").groupBy("class").agg(F.min("doc_id").alias("head"), F.min("text_id").alias("head_text"), F.first("point").alias("point"))
    texts = docs.select("doc_id", "text")

    def sets(classes: DataFrame) -> DataFrame:
        """(class, shingles) of ``classes`` (class): each class's text is met by the id of its head, or by its hash where no row of the class has an id."""
        wanted = saved(classes.join(heads.drop("point"), "class"))
        those = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        named = texts.join(those, F.col("doc_id") == F.col("head")).select("class", "text")
        if wanted.where("head is null").isEmpty():
            return shingle_sets(named)
        nameless = texts.where("doc_id is null").join(those.where("head is null"), text_id(F.col("text")) == F.col("head_text")).select("class", "text")
        return shingle_sets(named.unionByName(nameless)).dropDuplicates(["class"])

    ranks = _ranks(sketch)
    found = saved(territories(docs, ranks))
    kin = kin_of(found, sets, ranks)
    met = dealt(found, kin).join(heads.select("class", "point"), "class")
    left = saved(together(met).mapInArrow(with_partner, "root long, class long").distinct())
    links = together(dealt(left, kin).join(sets(left.select("class").distinct()), "class")).mapInArrow(linked, "a long, b long")
    links = links.unionByName(kin.select(F.col("pivot").alias("a"), F.col("class").alias("b")))
    reached = components(links).select(F.col("node").alias("class"), "component")
    kinds = heads.join(reached, "class", "left").select("class", "head", F.coalesce("component", "class").alias("component"))
    return rows.withColumn("class", F.when(F.col("n") > 0, F.col("class"))), kinds


def classes_of(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) → doc_id, text_id, n, class, component: one row for each input row.

    n is the size of the shingle set. class names the set and component the classes that it reaches; both are null where n is 0.
    Ids play no part in it: rows without one and rows that share one link by their texts like all others.
    """
    rows, kinds = compared(docs)
    return rows.join(kinds.select("class", "component"), "class", "left").select("doc_id", "text_id", "n", "class", "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) → doc_id, n_shingles, component_id: one row for each input row.

    Texts of fewer than WORDS words have one shingle, their words; without words, or null, a text has none and links with nothing,
    so its component is its own id. Texts with equal sets link. Rows with a repeated id each have what their own text reaches; null
    ids link others but never become a component's id, which is null where all it holds have none. Texts of any length are read
    whole. Other columns don't matter, whatever their names. An empty table gives no rows.
    """
    rows, kinds = compared(docs)
    least = kinds.groupBy("component").agg(F.min("head").alias("component_id"))
    told = kinds.join(least, "component").select("class", "component_id")
    out = rows.join(told, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
