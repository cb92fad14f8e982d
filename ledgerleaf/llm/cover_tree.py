"""Links between embeddings of one label by dual traversal of cover trees.

A cover tree nests levels of centres: those of a level are farther apart than its radius, cover everything below within it, and the
radius halves from level to level. Two trees are compared from their roots; a pair of nodes is dropped when its centres are
farther apart than the threshold distance plus both covering radii, so that exactly the linked pairs are left at the leaves.

The top of the trees is Spark's, for each label and at any number of labels: a node of more than BLOCK vectors deals them to the nearest of
its centres, over and over, until nodes are blocks, and pairs of nodes are followed from the roots by the same bound. Vectors travel
in chunks, centres and radii are tables. Each block's tree is built once; each pair of blocks is one task. Equal vectors are compared once. Tasks return counts
and a spanning forest of their links, never the links of a dense group.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import components, mixed, release, saved, unsized

#: Vectors of a block; rounding that the pruning allows for.
BLOCK, SLACK = 2048, 1e-7
#: Children of a node above the blocks, vectors that their centres are drawn from, about, levels above the blocks; nodes whose centres are broadcast, at most.
FAN, SAMPLE, DEPTH, WIDE = 64, 2048, 8, 500


@dataclass
class Node:
    centre: int
    radius: float
    below: list[Node] = field(default_factory=list)
    centres: np.ndarray | None = None
    radii: np.ndarray | None = None
    leaves: np.ndarray | None = None


def distances(x: np.ndarray, rows: np.ndarray, centre: int) -> np.ndarray:
    return np.sqrt(np.clip(2 - 2 * (x[rows] @ x[centre]), 0, None))


def build(x: np.ndarray) -> Node:
    """Cover tree over the rows of ``x``, all of length one; each row is compared with the centres it passes, not with all rows.

    Radii are the largest distances that occur, so they bound as tightly as they can.
    """

    def grow(centre: int, members: np.ndarray, far: np.ndarray) -> Node:
        """``members`` begins with ``centre``; ``far``: how far they are from it."""
        node = Node(centre, float(far.max()))
        if len(members) == 1:
            return node
        if node.radius <= SLACK:
            node.below = [Node(int(m), 0.0) for m in members]  # rounding can't tell them apart
        else:
            limit = node.radius / 2
            while len(members):
                near = far <= limit
                near[0] = True  # rounding may put a centre at a distance from itself
                node.below.append(grow(int(members[0]), members[near], far[near]))
                members = members[~near]
                far = distances(x, members, members[0]) if len(members) else far
        node.centres, node.radii = np.array([b.centre for b in node.below]), np.array([b.radius for b in node.below])
        node.leaves = np.array([not b.below for b in node.below])
        return node

    every = np.arange(len(x))
    return grow(0, every, distances(x, every, 0))


def linked(x: np.ndarray, y: np.ndarray, a: Node, b: Node, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of x, of y) whose dot product reaches ``threshold``, by dual traversal."""
    reach = reach_of(threshold)
    one, other, todo = [], [], [(a, b)]
    while todo:
        p, q = todo.pop()
        at = p.centres if p.below else np.array([p.centre])
        to = q.centres if q.below else np.array([q.centre])
        dot = x[at] @ y[to].T
        far = np.sqrt(np.clip(2 - 2 * dot, 0, None))
        r = p.radii if p.below else np.zeros(1)
        s = q.radii if q.below else np.zeros(1)
        open_ = far <= reach + r[:, None] + s[None, :]
        end = (p.leaves if p.below else np.ones(1, bool))[:, None] & (q.leaves if q.below else np.ones(1, bool))[None, :]
        i, j = np.nonzero(open_ & end & (dot >= threshold))
        one.append(at[i])
        other.append(to[j])
        for i, j in zip(*np.nonzero(open_ & ~end), strict=True):
            todo.append((p.below[i] if p.below else p, q.below[j] if q.below else q))
    return np.concatenate(one), np.concatenate(other)


def forest(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Smallest node that each of ``size`` nodes reaches over the links ``a`` - ``b``."""
    root = np.arange(size)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _unit(vectors: pd.Series | np.ndarray | list) -> np.ndarray:
    x = np.array(vectors.tolist() if isinstance(vectors, pd.Series) else vectors, float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def reach_of(threshold: float) -> float:
    """Distance of two vectors of length one whose cosine is ``threshold``."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK


def block_of(ids: np.ndarray, many: np.ndarray, v: np.ndarray) -> bytes:
    """A block with its tree."""
    order = np.argsort(ids, kind="stable")
    return pickle.dumps((ids[order], many[order], v[order], build(_unit(v[order]))))


def compare(one: bytes, other: bytes | None, threshold: float) -> pd.DataFrame:
    """Rows (a, b, links): the links of a to other vectors, and b, a vector that a reaches (itself if none is smaller).

    Of two blocks only links between them count, of one those inside it.
    """
    ids, many, x, tree = pickle.loads(one)  # noqa: S301  made by block_of()
    x = _unit(x)
    if other is None:
        a, b = linked(x, x, tree, tree, threshold)
        a, b = a[a < b], b[a < b]
    else:
        more, times, y, second = pickle.loads(other)  # noqa: S301
        a, b = linked(x, _unit(y), tree, second, threshold)
        b = b + len(x)
        ids, many = np.concatenate([ids, more]), np.concatenate([many, times])
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    links = np.bincount(a, many[b], len(ids)) + np.bincount(b, many[a], len(ids))
    root = ids[order][forest(place[a], place[b], len(ids))[place]]
    seen = links > 0
    return pd.DataFrame({"a": ids[seen], "b": root[seen], "links": links[seen].astype(np.int64)})


KEY = ["label", "length", "node"]
_MADE = "mark long, n long, blob binary"


def _few(df: DataFrame, most: int) -> DataFrame:
    """``df``, saved, for a join: broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def _short(v: np.ndarray) -> np.ndarray:
    """Vectors of single precision stay so."""
    short = v.astype(np.float32)
    return short if np.array_equal(short, v) else v


def _chunk(mark: int, ids: np.ndarray, many: np.ndarray, v: np.ndarray) -> dict:
    return {"mark": int(mark), "n": len(ids), "blob": pickle.dumps((ids, many, v))}


def _together(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    some = [pickle.loads(b) for b in blobs]  # noqa: S301  made by _chunk()
    return tuple(np.concatenate(x) for x in zip(*some, strict=True))


def _salted(df: DataFrame, size: int) -> DataFrame:
    """``df`` (label, length, node, mark, n, ...) with salt, which cuts a node into groups of about ``size`` vectors."""
    groups = saved(df.groupBy(*KEY).agg(F.ceil(F.sum("n") / size).cast("int").alias("groups")))
    return df.join(_few(groups, 100_000), KEY).withColumn("salt", F.pmod(F.xxhash64("mark"), F.col("groups")).cast("int"))


def _named(key: tuple, row: dict) -> pd.DataFrame:
    return _frame([dict(zip(KEY, key, strict=False)) | row], [*KEY, *row])


def _frame(rows: list, columns: list[str]) -> pd.DataFrame:
    """A frame whose labels are handed on as they are, whatever their type."""
    return pd.DataFrame(rows, columns=columns).astype({"label": object})


def _repacked(df: DataFrame, kind: str) -> DataFrame:
    """Chunks put together to larger ones of their nodes."""

    def each(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _named(key[:3], _chunk(key[3], *_together(group.sort_values("mark")["blob"].tolist())))

    return _salted(df, BLOCK).groupBy(*KEY, "salt").applyInPandas(each, f"label {kind}, length int, node long, {_MADE}")


def covered(whole: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The top of the trees over ``whole`` (label, length, id, many, v): (chunks of the nodes that are blocks, the levels above).

    Chunks have label, length, node, mark, n, blob; levels label, length, node and kids: the numbers, centres and covering radii of a node's children. A
    node of more than BLOCK vectors takes up to FAN centres, each the farthest from those before, from about SAMPLE of its own, and each of its vectors
    goes to the nearest; radii are the largest distances that occur, over all vectors.
    """
    kind = whole.schema["label"].dataType.simpleString()

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        return _named(key[:3], _chunk(key[3], group["id"].to_numpy(np.int64), group["many"].to_numpy(np.int64), _short(np.array(group["v"].tolist(), float))))

    start = whole.select("label", "length", F.lit(1).cast("long").alias("node"), F.col("id").alias("mark"), F.lit(1).cast("long").alias("n"), "id", "many", "v")
    chunks, leaves, levels = saved(_salted(start, BLOCK).groupBy(*KEY, "salt").applyInPandas(pack, f"label {kind}, length int, node long, {_MADE}")), [], []
    for _ in range(DEPTH):
        large = saved(chunks.groupBy(*KEY).agg(F.sum("n").alias("total")).where(F.col("total") > BLOCK))
        leaves.append(chunks.join(_few(large, 100_000), KEY, "left_anti"))
        if large.isEmpty():
            break
        centres = saved(_centres(chunks.join(_few(large, 100_000), KEY), kind))
        dealt = saved(_to_children(chunks.join(_few(centres, WIDE), KEY), kind))
        levels.append(saved(_kids(dealt, centres, kind)))
        chunks = unsized(saved(_repacked(dealt.select("label", "length", (F.col("node") * FAN + F.col("child")).alias("node"), "mark", "n", "blob"), kind)))
    else:
        leaves.append(chunks)
    return reduce(DataFrame.unionByName, leaves), levels


def _mixed_ids(ids: np.ndarray) -> np.ndarray:
    return mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(1))


def _centres(chunks: DataFrame, kind: str) -> DataFrame:
    """(label, length, node, centres) of chunks with total: drawn are the vectors whose id's hash is in the part that gives about SAMPLE."""

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                ids, many, v = pickle.loads(r.blob)  # noqa: S301
                at = (_mixed_ids(ids) >> np.uint64(11)).astype(float) < SAMPLE / r.total * 2.0**53
                if at.any():
                    out.append({"label": r.label, "length": r.length, "node": r.node, "total": r.total} | _chunk(r.mark, ids[at], many[at], v[at]))
            yield _frame(out, [*KEY, "total", "mark", "n", "blob"])
        release()

    def each(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ids, _, v = _together(group["blob"].tolist())
        x = _unit(v[np.argsort(ids, kind="stable")].astype(float))
        picked = [0]
        far = distances(x, np.arange(len(x)), 0)
        fan = min(FAN, max(2, -(-3 * int(group["total"].iloc[0]) // (2 * BLOCK))))  # children of two thirds of a block, so that there are no more pairs of blocks than need be
        while len(picked) < fan and far.max() > SLACK:
            picked.append(int(far.argmax()))
            far = np.minimum(far, distances(x, np.arange(len(x)), picked[-1]))
        return _named(key, {"centres": pickle.dumps(x[picked])})

    return chunks.mapInPandas(drawn, f"label {kind}, length int, node long, total long, {_MADE}").groupBy(*KEY).applyInPandas(each, f"label {kind}, length int, node long, centres binary")


def _to_children(chunks: DataFrame, kind: str) -> DataFrame:
    """Each chunk cut by its vectors' nearest centres, with far, the largest distance in the piece. Vectors that no centre tells apart are dealt by their ids."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                (ids, many, v), centres = pickle.loads(r.blob), pickle.loads(r.centres)  # noqa: S301
                dot = _unit(v.astype(float)) @ centres.T
                child = dot.argmax(1) if len(centres) > 1 else (_mixed_ids(ids) % np.uint64(FAN)).astype(int)
                far = np.sqrt(np.clip(2 - 2 * dot.max(1), 0, None))
                for j in np.unique(child):
                    at = child == j
                    out.append({"label": r.label, "length": r.length, "node": r.node, "child": int(j), "far": float(far[at].max())} | _chunk(ids[at][0], ids[at], many[at], v[at]))
            yield _frame(out, [*KEY, "child", "far", "mark", "n", "blob"])
        release()

    return chunks.mapInPandas(each, f"label {kind}, length int, node long, child int, far double, {_MADE}")


def _kids(dealt: DataFrame, centres: DataFrame, kind: str) -> DataFrame:
    told = dealt.groupBy(*KEY, "child").agg(F.max("far").alias("radius")).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("child", "radius"))).alias("told"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                at, children = pickle.loads(r.centres), [int(t["child"]) for t in r.told]  # noqa: S301
                own = at[[c if len(at) > 1 else 0 for c in children]]
                out.append({"label": r.label, "length": r.length, "node": r.node, "kids": pickle.dumps(([r.node * FAN + c for c in children], own, np.array([t["radius"] for t in r.told])))})
            yield _frame(out, [*KEY, "kids"])

    return told.join(centres, KEY).mapInPandas(each, f"label {kind}, length int, node long, kids binary")


def near_nodes(roots: DataFrame, levels: list[DataFrame], reach: float) -> DataFrame:
    """(label, length, node, other): the pairs node <= other of blocks whose vectors may link, by dual traversal of the tops of the trees.

    ``roots`` has label and length. From each root with itself, level by level, pairs go on to their children; a pair is dropped when its
    centres are farther apart than ``reach`` and both covering radii.
    """
    kind = roots.schema["label"].dataType.simpleString()
    nothing = F.lit(None).cast("binary")
    pairs = roots.select("label", "length", F.lit(1).cast("long").alias("node"), F.lit(1).cast("long").alias("other"), nothing.alias("own"), nothing.alias("others"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.kids is None and r.kids_ is None:
                    out.append((r.label, r.length, r.node, r.other, r.own, r.others))
                    continue
                p, c, s = pickle.loads(r.own if r.kids is None else r.kids)  # noqa: S301
                q, d, t = pickle.loads(r.others if r.kids_ is None else r.kids_)  # noqa: S301
                open_ = np.sqrt(np.clip(2 - 2 * c @ d.T, 0, None)) <= reach + s[:, None] + t[None, :] + SLACK
                if r.node == r.other:
                    open_ = np.triu(open_ | np.eye(len(p), dtype=bool))
                alone = [[pickle.dumps(([n], x[k : k + 1], y[k : k + 1])) for k, n in enumerate(m)] for m, x, y in ((p, c, s), (q, d, t))]
                out += [(r.label, r.length, p[i], q[j], alone[0][i], alone[1][j]) for i, j in np.argwhere(open_)]
            yield _frame(out, ["label", "length", "node", "other", "own", "others"])
        release()

    for level in levels:
        kids = _few(level, WIDE)
        met = pairs.join(kids, KEY, "left").join(kids.select("label", "length", F.col("node").alias("other"), F.col("kids").alias("kids_")), ["label", "length", "other"], "left")
        pairs = saved(met.select("label", "length", "node", "other", "own", "others", "kids", "kids_").mapInPandas(each, f"label {kind}, length int, node long, other long, own binary, others binary"))
    return pairs.select("label", "length", F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other"))


def near_duplicates(rows: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``rows`` (vec_id, embedding, label, ...) → vec_id, n_links, component_id, kept: one row for each input row.

    Vectors link when labels are equal and not null, lengths are equal and the cosine reaches ``threshold``. A vector that is null,
    empty or zero, or holds a null or non-finite component, links with nothing. Equal vectors of one label link with each other.
    A row without an id links with nothing. A row with a repeated id counts as a vector of its own. Other columns don't matter,
    whatever their names. An empty table gives no rows.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    # adding zero makes a negative zero equal to zero
    marked = rows.select("vec_id", "label", F.when(fine, F.transform(v, lambda c: c + F.lit(0.0))).alias("v"))
    whole = marked.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("many"))
    whole = saved(whole.withColumn("length", F.size("v")))
    leaves, levels = covered(whole)
    pairs = near_nodes(leaves.select("label", "length").distinct(), levels, reach_of(threshold))
    subs = saved(leaves.groupBy(*KEY).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("groups")))
    every = pairs.join(subs, KEY).join(subs.select("label", "length", F.col("node").alias("other"), F.col("groups").alias("_groups")), ["label", "length", "other"])
    # a node that couldn't be split is several blocks
    every = every.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("_sub", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
    every = every.where("node <> other or sub <= _sub").drop("groups", "_groups")

    def grown(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _named(key[:3], {"sub": int(key[3]), "tree": block_of(*_together(group["blob"].tolist()))})

    kind = whole.schema["label"].dataType.simpleString()
    blocks = leaves.join(_few(subs, 100_000), KEY).withColumn("sub", F.pmod(F.xxhash64("mark"), F.col("groups")).cast("int"))
    blocks = saved(blocks.groupBy(*KEY, "sub").applyInPandas(grown, f"label {kind}, length int, node long, sub int, tree binary"))
    second = blocks.select("label", "length", F.col("node").alias("other"), F.col("sub").alias("_sub"), F.col("tree").alias("_tree"))
    same = (F.col("node") == F.col("other")) & (F.col("sub") == F.col("_sub"))
    alone = blocks.select("tree", F.lit(None).cast("binary").alias("_tree"))
    met = every.where(~same).join(blocks, [*KEY, "sub"]).join(second, ["label", "length", "other", "_sub"]).select("tree", "_tree").unionByName(alone)

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for one, other in zip(b["tree"], b["_tree"], strict=True):
                yield compare(one, other, threshold)
        release()

    found = saved(met.mapInPandas(compared, "a long, b long, links long"))
    links = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    reached = components(found.select("a", "b")).select(F.col("node").alias("id"), "component")
    told = whole.join(links, "id", "left").join(reached, "id", "left").select("label", "v", "many", "id", "links", "component")
    out = marked.join(told, ["label", "v"], "left")
    n = F.coalesce("links", F.lit(0)) + F.coalesce("many", F.lit(1)) - 1
    component = F.coalesce("component", "id", "vec_id")
    return out.select("vec_id", n.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
