"""What several operators share: checkpoints, word rules, folds and connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.session import saved, shared_folder, ship, unsized

__all__ = ["saved", "shared_folder", "ship", "unsized"]

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch that are turned into Python values at once; texts of a whole batch would be held twice.
ROWS = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches cut into smaller ones, for work that takes more room than its rows."""
    for b in batches:
        for at in range(0, len(b), ROWS):
            yield b.iloc[at : at + ROWS]
    release()


def release() -> None:
    """Hands the memory that a finished partition leaves in its Python worker back to the system, as workers live on into other stages.

    Without it each worker keeps the peak of every stage that it has served, beside the heap of its executor.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_SPACES = bytes(range(9, 14))
_AS_SPACE = bytes.maketrans(_SPACES + UPPER.encode(), b" " * len(_SPACES) + LOWER.encode())
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    """The uint64 array ``x`` with its bits spread, in place."""
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= _MIX[1]
        x ^= x >> np.uint64(27)
        x *= _MIX[2]
        x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """UTF-8 texts to the hashes (uint64) of their words, A-Z lower-cased, and the places where these begin.

    The hash of a word is a polynomial in its bytes, taken from running sums over a stretch of text, and then mixed. Long texts
    are cut between words into stretches, so memory follows the stretch, or a longer word.
    """

    STRETCH = 1 << 21

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _reach(self, size: int) -> None:
        if size > len(self.powers):
            size = max(size, 2 * len(self.powers), 1 << 16)
            base = int(_MIX[0])
            with np.errstate(over="ignore"):
                self.powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)]))
                self.inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, pow(base, -1, 1 << 64), np.uint64)]))

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        text = text.translate(_AS_SPACE)
        at, out = 0, []
        while at < len(text):
            end = len(text)
            if end - at > self.STRETCH:
                cut = text.rfind(b" ", at, at + self.STRETCH)
                cut = cut if cut >= 0 else text.find(b" ", at)
                end = cut + 1 if cut >= 0 else end
            out.append(self._stretch(text[at:end], at))
            at = end
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return out[0] if len(out) == 1 else (np.concatenate([h for h, _ in out]), np.concatenate([s for _, s in out]))

    def _stretch(self, text: bytes, offset: int) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(text, np.uint8)
        self._reach(len(raw))
        space = np.ones(len(raw) + 2, bool)
        np.equal(raw, 32, out=space[1:-1])
        edge = np.flatnonzero(space[1:] != space[:-1])
        start, end = edge[::2], edge[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], out=sums[1:])
            return mixed((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64)), start + offset


def attached(df: DataFrame, keep: tuple[str, ...], use: tuple[str, ...], added: str, each: Callable[..., Iterator[tuple[int, int, list]]]) -> DataFrame:
    """The columns ``keep`` of ``df`` and those of the DDL ``added``.

    ``each`` gets lists of the columns ``use`` for a batch, and yields ranges of its rows, in order, with the lists of new values.
    The kept columns stay in Arrow, so ids next to nulls keep all their digits.
    """
    fields = df.sparkSession.createDataFrame([], added).schema
    types = {f.name: _arrow(f.dataType.simpleString()) for f in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            for start, end, values in each(*[b.column(f"__use_{c}").to_pylist() for c in use]):
                kept = [b.column(c).slice(start, end - start) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(v, t) for v, t in zip(values, types.values(), strict=True)]], [*keep, *types])
        release()

    schema = df.select(*keep).schema
    for f in fields:
        schema = schema.add(f)
    return df.select(*keep, *[F.col(c).alias(f"__use_{c}") for c in use]).mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[kind]


#: Neighbours from which on a node's rows take its label from a broadcast; a part of all edges, so that few nodes have as many.
HUB, HUB_PART = 256, 4096


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b: long) that reach a smaller one: component is the smallest.

    Alternates large-star and small-star rounds until the edge set stays the same; no neighbourhood is collected: a node meets its
    smallest neighbour through an aggregate and a join. Each star and its smallest neighbours are saved, as they are read more than
    once: a round in one plan would work them out again for each use, and the driver would hold all these stages at once. A round doesn't
    hand on Spark's estimate of its size, which would have four times the digits of the one before. A node with a
    4096th part of all edges (HUB at least) is a hub; there are at most 2 * 4096 of them, and their rows, of which a single task would get
    all, meet their label in a broadcast instead. Null ends are ignored; repeated and self edges do no harm.
    """

    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.max("b")).first())

    def labelled(rows: DataFrame, least: DataFrame, size: int) -> DataFrame:
        """``rows`` with m of ``least`` (a, m, n)."""
        if size < HUB:
            return rows.join(least.drop("n"), "a")
        hub = F.col("n") >= max(HUB, size // HUB_PART)
        hubs = F.broadcast(least.where(hub).drop("n"))
        return rows.join(hubs, "a").unionByName(rows.join(hubs.select("a"), "a", "left_anti").join(least.where(~hub).drop("n"), "a"))

    def large(e: DataFrame, size: int) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m")))
        return saved(labelled(both.where("b > a"), least, size).select(F.col("b").alias("a"), F.col("m").alias("b")))

    def small(e: DataFrame, size: int) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = saved(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        return labelled(down, least, size).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))

    current = unsized(saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    seen = signature(current)
    while seen[0]:
        current = unsized(saved(small(large(current, seen[0]), seen[0]).where("a <> b").distinct()))
        now = signature(current)
        if now == seen:
            break
        seen = now
    return current.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component"))
