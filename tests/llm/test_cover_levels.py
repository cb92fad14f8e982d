"""The upper levels of the cover trees: many large labels, several levels, what is pruned, labels of any type."""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import cover_tree
from tests.llm.test_methods import grouped


@pytest.fixture
def small(monkeypatch):
    for name, value in {"BLOCK": 10, "FAN": 6, "SAMPLE": 40, "WIDE": 3}.items():
        monkeypatch.setattr(cover_tree, name, value)


def expected(x, labels):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    pairs = [(i, j) for i, j in itertools.combinations(range(len(x)), 2) if labels[i] == labels[j] and near[i, j]]
    reach, n = grouped(pairs, range(len(x))), Counter(itertools.chain(*pairs))
    return {(i, n[i], reach[i], reach[i] == i) for i in range(len(x))}


def found(df):
    return {(r.vec_id, r.n_links, r.component_id, r.kept) for r in cover_tree.near_duplicates(df).collect()}


def clusters(count, groups, size, seed):
    dice = np.random.default_rng(seed)
    return dice.normal(size=(groups, size))[dice.integers(0, groups, count)] + 0.15 * dice.normal(size=(count, size))


def test_many_large_labels(spark, small):
    """Each of 10 labels, named by texts, is larger than a block; the rows of one are scaled copies of a single direction, which no centre tells apart."""
    x = clusters(10 * 14, 12, 5, 1)
    labels = [f"label {i % 10}" for i in range(len(x))]
    ones = [i for i, name in enumerate(labels) if name == "label 0"]
    x[ones] = np.outer(2.0 ** np.arange(len(ones)), x[0])
    df = spark.createDataFrame([(i, v.tolist(), name) for i, (v, name) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<double>, label string")
    assert found(df) == expected(x, labels)


def test_levels_prune(spark, small):
    """300 vectors of one label in 40 clusters: a tree of several levels, in which a small part of the pairs of blocks is left."""
    x = clusters(300, 40, 6, 2)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    whole = df.select("label", F.size("embedding").alias("length"), F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("many"), F.col("embedding").alias("v"))
    leaves, levels = cover_tree.covered(whole)
    blocks = leaves.select("node").distinct().count()
    pairs = cover_tree.near_nodes(leaves.select("label", "length").distinct(), levels, cover_tree.reach_of(0.93))
    assert len(levels) >= 2 and leaves.agg(F.sum("n")).first()[0] == 300
    assert pairs.count() == pairs.distinct().count() < 0.4 * blocks * (blocks + 1) / 2
    assert found(df) == expected(x, [1] * 300)
