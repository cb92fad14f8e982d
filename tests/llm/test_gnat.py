"""Hard negatives beside brute force: trees of several levels, common vectors, odd rows, large numbers; pruning counted."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import gnat
from ledgerleaf.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, label int"


def expected(rows, every=20, scale=256, positives=5, negatives=10):
    fine = {(i, tuple(math.floor(scale * x) for x in v), label) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in fine:
        if a[0] % every:
            continue
        score = lambda r: sum(x * y for x, y in zip(a[1], r[1], strict=True))  # noqa: B023, E731
        others = [(-score(r), r[0], r[2] == a[2]) for r in fine if len(r[1]) == len(a[1]) and r != a]
        for p, i, _ in sorted(o for o in others if o[2])[:positives]:
            fits = sorted((s, n) for s, n, same in others if not same and 30 * -p <= 100 * -s <= 90 * -p)[:negatives]
            out += [(a[0], i, k, n, -p, -s) for k, (s, n) in enumerate(fits, 1)]
    return sorted(out)


def found(df, every=20, **how):
    return sorted(tuple(r) for r in gnat.mine(df, F.col("vec_id") % every == 0, **how).collect())


def clustered(count, seed, size=6):
    dice = np.random.default_rng(seed)
    centres = dice.normal(size=(12, size))
    x = centres[dice.integers(0, 12, count)] + 0.1 * dice.normal(size=(count, size))
    return [(i, [float(c) for c in v], int(dice.integers(0, 4))) for i, v in enumerate(x)]


@pytest.fixture
def small(monkeypatch):
    for name, value in {"FANOUT": 6, "SAMPLE": 60, "BLOCK": 90, "LEAF": 8, "CHUNK": 16}.items():
        monkeypatch.setattr(gnat, name, value)


def test_levels(spark, small):
    rows = clustered(700, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    named, _ = gnat.classes(df, F.col("vec_id") % 20 == 0, 10, 256)
    tree = gnat.grow(named)
    assert len(tree.levels) >= 2 and tree.blocks.count() > 6
    told = expected(rows)
    assert found(df) == told and len(told) > 500


def test_windows_prune(spark, small):
    """A tight window around clustered vectors leaves few of the blocks open."""
    named, _ = gnat.classes(spark.createDataFrame(clustered(700, 3), SCHEMA), F.col("vec_id") % 20 == 0, 10, 256)
    tree = gnat.grow(named)
    own = named.where("anchor").select("c", "h", "length", "label", "v", F.array(F.struct(F.lit(0).alias("name"), F.expr("aggregate(v, 0L, (s, x) -> s + x * x) * 95 div 100").alias("low"), F.lit(gnat.END).alias("high"))).alias("windows"))
    one = own.select("length", F.lit(1).cast("long").alias("node"), F.col("h").alias("mark"), F.lit(1).cast("long").alias("n"), "*")
    pack = lambda g: gnat.Queries(g["c"].to_numpy(np.int64), g["h"].to_numpy(np.int64), g["label"].to_numpy(np.int64), gnat.integers(g["v"].tolist()), [[(0, int(w[0]["low"]), gnat.END)] for w in g["windows"]])
    queries = gnat._packed(one.drop("length").withColumn("length", F.lit(6)), 10, pack)
    met = gnat.descend(tree, queries).agg(F.sum("n")).first()[0]
    assert met < 0.5 * own.count() * tree.blocks.select("length", "node").distinct().count()


def test_common_vectors_and_odd_rows(spark, small):
    """A third of all rows are one vector, with all labels; repeated rows and ids, ties, odd vectors, one label, clashing columns."""
    nan, inf = float("nan"), float("inf")
    dice = random.Random(7)
    rows = clustered(200, 5, 3) + [(1000 + i, [0.5, -0.25, 0.125], i % 3) for i in range(150)]
    rows += [(40, [1.0, 1.0, 1.0], 1), (40, [1.0, 1.0, 1.0], 1), (40, [1.0, 1.0, 0.5], 1), (None, [1.0, 1.0, 1.0], 1), (60, None, 1), (80, [nan, 1.0, 1.0], 1), (100, [inf, 0.0, 0.0], 1), (120, [None, 1.0, 1.0], 1), (140, [1.0, 1.0, 1.0], None)]
    rows += [(2000 + i, [dice.choice([0.0, 1.0, -1.0]) for _ in range(2)], i % 2) for i in range(60)] + [(3000 + i, [], i % 2) for i in range(40)] + [(-20, [0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("c", "h", "v", "node", "score", "anchor", "length", "rank")])
    assert found(df) == expected(rows) and found(df.limit(0)) == []
    assert found(df, positives=2, negatives=3) == expected(rows, positives=2, negatives=3)


def test_large_numbers_are_exact(spark):
    dice = random.Random(1)
    rows = [(i, [float(dice.randrange(1 << 21)), float(dice.randrange(1 << 21)) + 0.25, 1e-9 * i], i % 2) for i in range(60)] + [(500, [1e300, 0.0, 0.0], 0)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows[:-1])


def test_given_vectors(spark, data):
    df = table(spark, data, "embeddings")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    assert found(df) == expected(rows)
