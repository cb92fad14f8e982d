"""What the driver plans at once: steps that are read more than once are saved, so no plan holds them again for each use."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import common, mixing


def joins(df: DataFrame) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


@pytest.fixture
def planned(monkeypatch) -> list[int]:
    """Joins of each plan that is saved from now on."""
    seen: list[int] = []

    def noted(df: DataFrame) -> DataFrame:
        seen.append(joins(df))
        return common.shared_folder(df.sparkSession) and df.checkpoint()

    for module in (common, mixing):
        monkeypatch.setattr(module, "saved", noted)
    return seen


def test_rounds_of_components(spark, planned):
    """A hub of 600 nodes, a path of 40, a pair: one star a plan, each node reaches its smallest."""
    edges = [(1000, 1000 + i) for i in range(1, 601)] + [(i, i + 1) for i in range(40)] + [(5001, 5000)]
    found = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{1000 + i: 1000 for i in range(1, 601)}, **dict.fromkeys(range(1, 41), 0), 5001: 5000}
    assert max(planned) <= 5


def test_steps_of_the_mix(spark, data, planned):
    """No step of the mix holds the plans of those before it."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = mixing.mix(docs)
    assert max([*planned, joins(out)]) <= 5
    assert out.agg(F.count("*"), F.sum("taken") > 0).first() == (docs.count(), True)
