"""What Spark estimates of saved steps: a loop's rounds don't hand it on, as its digits would multiply until they fill the driver's memory."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import common, cover_tree


def digits(df: DataFrame) -> int:
    """Digits of the size in bytes that Spark estimates; 0 for sizes that have a unit."""
    large = re.search(r"E\+(\d+) B", df._jdf.queryExecution().optimizedPlan().stats().simpleString())
    return int(large[1]) if large else 0


def test_rounds_of_components(spark, monkeypatch):
    """A path of 600 nodes takes several rounds, and no round's estimate is longer than that of one round."""
    seen: list[int] = []

    def noted(df: DataFrame) -> DataFrame:
        seen.append(digits(df))
        return common.shared_folder(df.sparkSession) and df.checkpoint()

    monkeypatch.setattr(common, "saved", noted)
    order = np.random.default_rng(5).permutation(600).tolist()
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    found = common.components(edges)
    assert {(r.node, r.component) for r in found.collect()} == {(n, 0) for n in range(1, 600)}
    assert len(seen) >= 12  # four in each round
    assert max([*seen, digits(found)]) <= 100


def test_levels_of_trees(spark, monkeypatch):
    """300 vectors of one label in blocks of 10: no level's estimate is longer than that of one level."""
    for name, value in {"BLOCK": 10, "FAN": 6, "SAMPLE": 40, "WIDE": 3}.items():
        monkeypatch.setattr(cover_tree, name, value)
    x = np.random.default_rng(2).normal(size=(300, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    leaves, levels = cover_tree.covered(df.select(F.lit(1).alias("label"), F.size("v").alias("length"), "id", F.lit(1).cast("long").alias("many"), "v"))
    assert len(levels) >= 2 and leaves.agg(F.sum("n")).first()[0] == 300
    assert max(digits(f) for f in [leaves, *levels]) <= 200
