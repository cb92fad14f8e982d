"""Hard negatives by a multiway hyperplane tree with distance ranges (GNAT).

A node has FANOUT split points; a row belongs to the nearest. For each split point i and each subtree j the node stores the range of
distances from point i to the rows of j, and the range of their norms. A window of inner products with a query is an annulus around it,
by each subtree's norms; a subtree goes if, for any split point, the distances that the stored range allows miss the annulus. Leaves
are compared exactly, in integers.

The tree's top is Spark's: rows travel in chunks; a node of more than BLOCK rows draws split points from a bounded sample of its own, its
chunks are dealt to subtrees, ranges are added up over all rows, until every subtree is a block. A block holds the lower levels of its
tree. Queries descend in chunks as well, level by level, and meet the blocks that are left. Only rows equal in label and vector are
put together before: of those the smallest ids are enough for any answer.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.common import release, saved

#: Split points of a node; rows that these are drawn from, about; rows of a block and of a leaf inside it, at most, about.
FANOUT, SAMPLE, BLOCK, LEAF = 32, 1024, 8192, 128
#: Rows or queries of a chunk, about; levels of Spark's part; rounding of distances, relative to the norms.
CHUNK, DEPTH, SLACK = 256, 9, 1e-6
#: Nodes whose split points are broadcast, at most; a window without an end.
SPLITS, END = 1000, (1 << 63) - 1


@dataclass
class Rows:
    """Classes of equal rows: key (c, h), label, whether an anchor is among them, vector, and their smallest ids, ascending."""

    c: np.ndarray
    h: np.ndarray
    label: np.ndarray
    anchor: np.ndarray
    x: np.ndarray
    ids: list[list[int]]

    def take(self, at: np.ndarray) -> Rows:
        return Rows(self.c[at], self.h[at], self.label[at], self.anchor[at], self.x[at], [self.ids[i] for i in at])


@dataclass
class Queries:
    """Key, label, vector, and up to some windows (name, lowest, highest score) of each."""

    c: np.ndarray
    h: np.ndarray
    label: np.ndarray
    x: np.ndarray
    windows: list[list[tuple[int, int, int]]]

    def take(self, at: np.ndarray) -> Queries:
        return Queries(self.c[at], self.h[at], self.label[at], self.x[at], [self.windows[i] for i in at])

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """The window around each query's windows."""
        return np.array([min(w[1] for w in ws) for ws in self.windows], np.int64), np.array([max(w[2] for w in ws) for ws in self.windows], np.int64)


def joined(some: list) -> Rows | Queries:
    kind = type(some[0])
    return kind(*[np.concatenate(c) if isinstance(c[0], np.ndarray) else [v for one in c for v in one] for c in ([getattr(s, f) for s in some] for f in kind.__dataclass_fields__)])


def integers(vectors: list[list[int]]) -> np.ndarray:
    """The vectors as a matrix of the smallest type that holds them."""
    x = np.array(vectors, np.int64)
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``x`` and ``y``: in doubles where these hold them, else in Python's integers."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * max(1, x.shape[1])
    if most < 1 << 53:
        return (x.astype(float) @ y.astype(float).T).astype(np.int64)
    return (x.astype(object) @ y.astype(object).T).astype(np.int64)


def norms(x: np.ndarray) -> np.ndarray:
    """Squared norms."""
    return np.einsum("ij,ij->i", x.astype(float), x.astype(float))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip(norms(x)[:, None] + norms(y)[None, :] - 2.0 * products(x, y), 0, None))


def spread(x: np.ndarray, fanout: int) -> np.ndarray:
    """Places of up to ``fanout`` rows far from each other, each the farthest from those before; none twice."""
    out, far = [0], distances(x, x[:1])[:, 0]
    while len(out) < fanout and far.max() > 0:
        out.append(int(far.argmax()))
        far = np.minimum(far, distances(x, x[out[-1:]])[:, 0])
    return np.array(out)


@dataclass
class Ranges:
    """Of a node's subtrees j: distances from each split point i to their rows, and their squared norms."""

    near: np.ndarray
    far: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def open(self, far: np.ndarray, norm: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which subtrees (columns) may hold a row whose score is in the window of each query, ``far`` from the split points."""
        slack = SLACK * (1 + np.sqrt(norm)[:, None] + np.sqrt(np.maximum(self.most, 0))[None, :])
        outer = norm[:, None] + self.most[None, :] - 2.0 * low[:, None]
        inner = np.sqrt(np.clip(norm[:, None] + self.least[None, :] - 2.0 * high[:, None], 0, None))
        lower = np.maximum(far[:, :, None] - self.far[None], self.near[None] - far[:, :, None]).max(1)
        upper = (far[:, :, None] + self.far[None]).min(1)
        reach = np.sqrt(np.clip(outer, 0, None)) + slack
        return (outer >= -slack * slack) & (lower <= reach) & (upper >= inner - slack)


def ranges_of(far: np.ndarray, norm: np.ndarray, child: np.ndarray, children: np.ndarray) -> Ranges:
    """``far``: distances of rows (rows) from split points (columns)."""
    near, most = np.stack([far[child == j].min(0) for j in children], 1), np.stack([far[child == j].max(0) for j in children], 1)
    return Ranges(near, most, np.array([norm[child == j].min() for j in children]), np.array([norm[child == j].max() for j in children]))


@dataclass
class Node:
    rows: np.ndarray | None = None
    points: np.ndarray | None = None
    ranges: Ranges | None = None
    below: list[Node] | None = None


def plant(x: np.ndarray, rows: np.ndarray, depth: int = 16) -> Node:
    """The tree over ``rows`` of ``x``; leaves hold LEAF rows, or what can't be split."""
    if len(rows) <= LEAF or not depth:
        return Node(rows)
    drawn = rows[:: max(1, len(rows) // 256)]
    points = x[drawn[spread(x[drawn], FANOUT // 2)]]
    far = distances(x[rows], points)
    child = far.argmin(1)
    children = np.unique(child)
    if len(children) == 1:
        return Node(rows)
    below = [plant(x, rows[child == j], depth - 1) for j in children]
    return Node(None, points, ranges_of(far, norms(x[rows]), child, children), below)


def search(rows: Rows, tree: Node, queries: Queries, same: bool, take: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(c, h, window, id, score, own): of each query's windows the first ``take`` rows by score and id, of the query's label or of others; own: 1 for rows of its class."""
    low, high = queries.bounds()
    norm = norms(queries.x)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in queries.c]
    todo = [(tree, np.arange(len(queries.c)))]
    while todo:
        node, asked = todo.pop()
        if node.rows is None:
            open_ = node.ranges.open(distances(queries.x[asked], node.points), norm[asked], low[asked], high[asked])
            todo.extend((below, asked[open_[:, j]]) for j, below in enumerate(node.below) if open_[:, j].any())
            continue
        scores = products(queries.x[asked], rows.x[node.rows])
        fits = ((rows.label[node.rows][None, :] == queries.label[asked][:, None]) == same) & (scores >= low[asked][:, None]) & (scores <= high[asked][:, None])
        for i in np.flatnonzero(fits.any(1)):
            found[asked[i]].append((node.rows[fits[i]], scores[i, fits[i]]))
    first = np.array([ids[0] for ids in rows.ids], np.int64)
    for q, leaves in enumerate(found):
        if leaves:
            at, score = (np.concatenate(p) for p in zip(*leaves, strict=True))
            order = np.lexsort((first[at], -score))
            at, score = at[order], score[order]
            for name, lowest, highest in queries.windows[q]:
                best = np.flatnonzero((score >= lowest) & (score <= highest))[:take]
                own = (rows.c[at[best]] == queries.c[q]) & (rows.h[at[best]] == queries.h[q])
                told = sorted((-int(score[k]), i, int(o)) for k, o in zip(best, own, strict=True) for i in rows.ids[at[k]])[:take]
                yield from ((int(queries.c[q]), int(queries.h[q]), name, i, -s, o) for s, i, o in told)


def _small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, saved, for a join: broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def _dealt(df: DataFrame, size: int, keys: tuple[str, ...] = ("length", "node")) -> DataFrame:
    """``df`` with salt, which cuts the items (n in a row) of a node into groups of about ``size``."""
    groups = saved(df.groupBy(*keys).agg(F.ceil(F.sum("n") / size).cast("int").alias("groups")))
    return df.join(_small(groups), list(keys)).withColumn("salt", F.pmod(F.xxhash64("mark"), F.col("groups")).cast("int")).drop("groups")


CHUNKS = "length int, node long, mark long, n long, blob binary"


def _chunk(length: int, node: int, mark: int, some: Rows | Queries) -> dict:
    return {"length": length, "node": node, "mark": mark, "n": len(some.c), "blob": pickle.dumps(some)}


def _packed(df: DataFrame, size: int, pack: Callable[[pd.DataFrame], Rows | Queries]) -> DataFrame:
    """Groups of about ``size`` of the rows of ``df`` (length, node, mark, n, ...) as chunks."""

    def each(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_chunk(int(key[0]), int(key[1]), int(key[2]), pack(group))])

    return _dealt(df, size).groupBy("length", "node", "salt").applyInPandas(each, CHUNKS)


def _unpickled(group: pd.DataFrame) -> Rows | Queries:
    return joined([pickle.loads(b) for b in group.sort_values("mark")["blob"]])  # noqa: S301  made by _chunk()


def classes(rows: DataFrame, anchors: Column, keep: int, scale: int) -> tuple[DataFrame, DataFrame]:
    """(c, h, length, label, v, ids, anchor) of the rows that take part, and (vec_id, c, h) of the anchors."""
    whole = F.col("embedding").cast("array<double>")
    scaled = F.transform(whole, lambda x: F.floor(x * scale))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    short = F.aggregate(whole, F.lit(0.0), lambda s, x: s + (F.abs(x) * scale + 1) * (F.abs(x) * scale + 1)) < float(1 << 62)
    given = rows.select("vec_id", F.col("label").cast("long").alias("label"), F.when(fine & short, scaled).alias("v"), anchors.alias("anchor"))
    given = given.where("v is not null").groupBy("vec_id", "label", "v").agg(F.max(F.coalesce("anchor", F.lit(False))).alias("anchor"))
    given = saved(given)
    few = given.withColumn("turn", F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id"))).where(F.col("turn") <= keep)
    few = few.groupBy("label", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    few = few.select(F.col("ids")[0].alias("c"), F.xxhash64("label", "v").alias("h"), F.size("v").alias("length"), "label", "v", "ids")
    asked = given.where("anchor").select("vec_id", "label", "v").join(few.select("c", "h", "label", "v"), ["label", "v"]).select("vec_id", "c", "h")
    asked = saved(asked)
    named = few.join(asked.select("c", "h").distinct().withColumn("anchor", F.lit(True)), ["c", "h"], "left")
    return saved(named.select("c", "h", "length", "label", "v", "ids", F.coalesce("anchor", F.lit(False)).alias("anchor"))), asked


@dataclass
class Tree:
    """``levels``: (length, node, split) tables, the root's first; ``blocks``: (length, node, salt, blob)."""

    levels: list[DataFrame]
    blocks: DataFrame


def grow(named: DataFrame) -> Tree:
    def pack(group: pd.DataFrame) -> Rows:
        group = group.sort_values(["c", "h"])
        return Rows(group["c"].to_numpy(np.int64), group["h"].to_numpy(np.int64), group["label"].to_numpy(np.int64), group["anchor"].to_numpy(bool), integers(group["v"].tolist()), [list(map(int, i)) for i in group["ids"]])

    start = named.select("length", F.lit(1).cast("long").alias("node"), F.col("h").alias("mark"), F.lit(1).cast("long").alias("n"), "c", "h", "label", "anchor", "v", "ids")
    chunks, levels = saved(_packed(start, 8 * CHUNK, pack)), []
    done = None
    for _ in range(DEPTH):
        sizes = saved(chunks.groupBy("length", "node").agg(F.sum("n").alias("total")))
        large = saved(sizes.where(F.col("total") > BLOCK))
        small = chunks.join(_small(large), ["length", "node"], "left_anti")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return Tree(levels, _blocks(done))
        points = saved(_points(chunks.join(_small(large), ["length", "node"])))
        dealt = saved(_subtrees(chunks.join(_small(points, SPLITS), ["length", "node"])))
        levels.append(saved(_splits(dealt, points)))
        chunks = saved(_packed(dealt.select("length", (F.col("node") * 64 + F.col("child")).alias("node"), "mark", "n", "blob"), 8 * CHUNK, _unpickled))
    return Tree(levels, _blocks(done.unionByName(chunks)))


def _points(chunks: DataFrame) -> DataFrame:
    """(length, node, points): split points of each node, from the rows whose hash is the smallest part of all, SAMPLE of them about."""

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for length, node, total, blob in zip(b["length"], b["node"], b["total"], b["blob"], strict=True):
                some = pickle.loads(blob)  # noqa: S301
                at = np.flatnonzero((some.h.view(np.uint64) >> np.uint64(11)).astype(float) < SAMPLE / total * 2.0**53)
                yield pd.DataFrame([_chunk(length, node, int(some.h[0]), some.take(at))] if len(at) else [], columns=["length", "node", "mark", "n", "blob"])
        release()

    def each(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x = _unpickled(group).x
        x = x[np.lexsort(x.T)] if x.shape[1] else x
        return pd.DataFrame({"length": [int(key[0])], "node": [int(key[1])], "points": [pickle.dumps(x[spread(x, FANOUT)])]})

    return chunks.mapInPandas(drawn, CHUNKS).groupBy("length", "node").applyInPandas(each, "length int, node long, points binary")


def _subtrees(chunks: DataFrame) -> DataFrame:
    """Each chunk cut by its rows' nearest split point, with the ranges of the piece. Rows that no point tells apart are dealt by hash."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for length, node, blob, told in zip(b["length"], b["node"], b["blob"], b["points"], strict=True):
                some, points = pickle.loads(blob), pickle.loads(told)  # noqa: S301
                far = distances(some.x, points)
                child = far.argmin(1) if len(points) > 1 else (some.h.view(np.uint64) % np.uint64(FANOUT)).astype(int)
                for j in np.unique(child):
                    at = np.flatnonzero(child == j)
                    norm = norms(some.x[at])
                    out.append({**_chunk(length, node, int(some.h[at[0]]), some.take(at)), "child": int(j), "near": far[at].min(0), "far": far[at].max(0), "least": norm.min(), "most": norm.max()})
            yield pd.DataFrame(out, columns=["length", "node", "mark", "n", "blob", "child", "near", "far", "least", "most"])
        release()

    return chunks.mapInPandas(each, CHUNKS + ", child int, near array<double>, far array<double>, least double, most double")


def _splits(dealt: DataFrame, points: DataFrame) -> DataFrame:
    """(length, node, split): split points, numbers and ranges of the subtrees of each node, over all rows."""
    place = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("near") - 1).alias("i"), "near", "far"))
    each = dealt.select("length", "node", "child", "least", "most", place.alias("p")).groupBy("length", "node", "child", F.col("p.i").alias("i"))
    each = each.agg(F.min("p.near").alias("near"), F.max("p.far").alias("far"), F.min("least").alias("least"), F.max("most").alias("most"))
    lists = each.groupBy("length", "node").agg(F.array_sort(F.collect_list(F.struct("child", "i", "near", "far", "least", "most"))).alias("told"))

    def built(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for length, node, told, blob in zip(b["length"], b["node"], b["told"], b["points"], strict=True):
                children = sorted({r["child"] for r in told})
                table = {(r["child"], r["i"]): r for r in told}
                at = pickle.loads(blob)  # noqa: S301
                grid = lambda name: np.array([[table[j, i][name] for j in children] for i in range(len(at))])  # noqa: B023, E731
                ranges = Ranges(grid("near"), grid("far"), grid("least")[0], grid("most")[0])
                out.append({"length": length, "node": node, "split": pickle.dumps((at, children, ranges))})
            yield pd.DataFrame(out, columns=["length", "node", "split"])

    return lists.join(points, ["length", "node"]).mapInPandas(built, "length int, node long, split binary")


def _blocks(chunks: DataFrame) -> DataFrame:
    def each(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        some = _unpickled(group)
        return pd.DataFrame({"length": [int(key[0])], "node": [int(key[1])], "rows": [pickle.dumps((some, plant(some.x, np.arange(len(some.c)))))]})

    return saved(_dealt(chunks, BLOCK).groupBy("length", "node", "salt").applyInPandas(each, "length int, node long, rows binary"))


def descend(tree: Tree, queries: DataFrame) -> DataFrame:
    """Chunks of queries at the nodes that are blocks: at each level, a query goes to the subtrees that its window leaves open."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for length, node, blob, split in zip(b["length"], b["node"], b["blob"], b["split"], strict=True):
                some = pickle.loads(blob)  # noqa: S301
                points, children, ranges = pickle.loads(split)  # noqa: S301
                open_ = ranges.open(distances(some.x, points), norms(some.x), *some.bounds())
                out += [_chunk(length, int(node) * 64 + j, int(some.h[0]), some.take(np.flatnonzero(open_[:, k]))) for k, j in enumerate(children) if open_[:, k].any()]
            yield pd.DataFrame(out, columns=["length", "node", "mark", "n", "blob"])
        release()

    ends = None
    for level in tree.levels:
        split = _small(level, SPLITS)
        leaves = queries.join(split, ["length", "node"], "left_anti")
        ends = leaves if ends is None else ends.unionByName(leaves)
        queries = saved(_packed(queries.join(split, ["length", "node"]).mapInPandas(each, CHUNKS), CHUNK, _unpickled))
    return queries if ends is None else ends.unionByName(queries)


def answers(tree: Tree, queries: DataFrame, same: bool, take: int) -> DataFrame:
    """(c, h, window, id, score, own): the first ``take`` rows of each window; ``queries`` (c, h, length, label, v, windows)."""

    def pack(group: pd.DataFrame) -> Queries:
        group = group.sort_values(["c", "h"])
        windows = [[(int(w["name"]), int(w["low"]), int(w["high"])) for w in ws] for ws in group["windows"]]
        return Queries(group["c"].to_numpy(np.int64), group["h"].to_numpy(np.int64), group["label"].to_numpy(np.int64), integers(group["v"].tolist()), windows)

    start = queries.select("length", F.lit(1).cast("long").alias("node"), F.col("h").alias("mark"), F.lit(1).cast("long").alias("n"), "c", "h", "label", "v", "windows")
    met = descend(tree, saved(_packed(start, CHUNK, pack))).join(tree.blocks, ["length", "node"]).select("blob", "rows")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for blob, rows in zip(b["blob"], b["rows"], strict=True):
                yield pd.DataFrame(list(search(*pickle.loads(rows), pickle.loads(blob), same, take)), columns=["c", "h", "window", "id", "score", "own"], dtype="int64")  # noqa: S301
        release()

    best = Window.partitionBy("c", "h", "window").orderBy(F.desc("score"), "id")
    found = met.mapInPandas(each, "c long, h long, window long, id long, score long, own long")
    return found.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= take).drop("turn")


def at_home(tree: Tree, take: int) -> DataFrame:
    """(c, h, length, label, v, least): each anchor's class and the score of the last of its first ``take`` rows of its label in its own block, null if it has fewer there."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for length, blob in zip(b["length"], b["rows"], strict=True):
                rows, root = pickle.loads(blob)  # noqa: S301
                every = np.flatnonzero(rows.anchor)
                for part in (every[at : at + CHUNK] for at in range(0, len(every), CHUNK)):
                    some = Queries(rows.c[part], rows.h[part], rows.label[part], rows.x[part], [[(0, -END, END)]] * len(part))
                    scores: dict[tuple[int, int], list[int]] = {}
                    for c, h, _, _, score, _ in search(rows, root, some, True, take):
                        scores.setdefault((c, h), []).append(score)
                    told = [scores[key] for key in zip(some.c.tolist(), some.h.tolist(), strict=True)]
                    least = pd.Series([t[-1] if len(t) == take else None for t in told], dtype="Int64")
                    yield pd.DataFrame({"c": some.c, "h": some.h, "length": length, "label": some.label, "v": pd.Series(some.x.tolist(), dtype=object), "least": least})
        release()

    return tree.blocks.mapInPandas(each, "c long, h long, length int, label long, v array<long>, least long")


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """``rows`` (vec_id, embedding, label, ...) → anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; nor do vectors so long that their
    scores don't fit a long (a squared norm of 2^62). Components become floor(scale * x); a score is the inner product with the anchor, vectors
    of other lengths have none. Higher scores come first, ties by the smaller id. ``anchors`` tells the anchors among the rows. An anchor's
    positives are its first ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels whose
    score is from ``low`` to ``high`` hundredths of the positive's come back, ranked from 1. Rows equal in id, label and vector are one;
    rows that only share an id are rows of their own, and of two anchors with one id each has its results. Other columns don't matter.
    An empty table gives no rows.
    """
    named, asked = classes(rows, anchors, max(negatives, positives + 1), scale)
    tree = grow(named)
    home = saved(at_home(tree, positives + 1))
    window = F.struct(F.lit(0).alias("name"), F.coalesce("least", F.lit(-END)).alias("low"), F.lit(END).alias("high"))
    near = saved(answers(tree, home.withColumn("windows", F.array(window)), True, positives + 1))
    first = Window.partitionBy("vec_id", "c", "h").orderBy(F.desc("score"), "id")
    pairs = asked.join(near, ["c", "h"]).where("own = 0 or id <> vec_id").withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= positives)
    pairs = saved(pairs.select("vec_id", "c", "h", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    whole, rest = F.expr("(positive_score - pmod(positive_score, 100)) div 100"), F.expr("pmod(positive_score, 100)")
    ends = (whole * low + F.ceil(rest * low / 100)).alias("low"), (whole * high + F.floor(rest * high / 100)).alias("high")  # no product passes a long
    wanted = pairs.select("c", "h", "positive_score").distinct().select("c", "h", "positive_score", *ends).where("low <= high")
    wanted = wanted.groupBy("c", "h").agg(F.collect_list(F.struct(F.col("positive_score").alias("name"), "low", "high")).alias("windows"))
    far = answers(tree, home.drop("least").join(wanted, ["c", "h"]), False, negatives)
    lists = far.groupBy("c", "h", F.col("window").alias("positive_score")).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("best"))
    out = pairs.join(lists, ["c", "h", "positive_score"]).select("vec_id", "positive_id", "positive_score", F.posexplode("best").alias("at", "n"))
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.less")).alias("negative_score"))
