"""Quantile sketches beside exact quantiles; results of an application in one row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerleaf.operators import evaluate, merge


def test_sketches_merge_within_their_error(spark):
    """Skewed latencies in 30 days of very different size: the rank of each quantile is off by less than 2.7 %."""
    runs = spark.range(60_000).select((F.pmod(F.xxhash64("id"), F.lit(30)) * F.pmod(F.hash("id"), F.lit(2))).alias("day"), F.exp(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(10_000)) / 2000).alias("seconds"))
    sketches = evaluate.latency_sketches(runs, "day")
    found = evaluate.latency_quantiles(sketches, shares=(0.1, 0.5, 0.99)).first()
    assert found.runs == 60_000 and abs(found.slowest - runs.agg(F.max("seconds")).first()[0]) < 1e-9
    for share, told in ((0.1, found["p10"]), (0.5, found["p50"]), (0.99, found["p99"])):
        rank = runs.where(F.col("seconds") <= told).count() / 60_000
        assert abs(rank - share) < 0.027
    assert found["p50_band"] == evaluate_band(found["p50"]) and found["p99_band"] == "too slow"
    assert sketches.agg(F.max(F.octet_length("sketch"))).first()[0] < 10_000


def evaluate_band(seconds):
    return "fast" if seconds <= 2 else "acceptable" if seconds <= 5 else "slow" if seconds <= 10 else "too slow"


def test_small_and_empty_groups_are_exact(spark):
    runs = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 9.0), ("a", 2, 4.0), ("a", 3, None), ("b", 1, None), ("c", 1, float("nan")), ("d", 1, 3.0)], "service string, day int, seconds double")
    found = {r.service: (r.runs, r.slowest, r.p50, r.p50_band, r.p99_band) for r in evaluate.latency_quantiles(evaluate.latency_sketches(runs, "service", "day"), "service").collect()}
    assert found == {"a": (3, 9.0, 4.0, "acceptable", "slow"), "d": (1, 3.0, 3.0, "acceptable", "acceptable")}
    assert evaluate.latency_quantiles(evaluate.latency_sketches(runs.limit(0), "service", "day"), "service").count() == 0


def test_application_records(spark):
    rows = [(1, 2, "x"), (1, 2, ""), (1, None, "x"), (1, 1, None), (None, 1, "x"), (None, None, ""), (2, None, "y")]
    df = spark.createDataFrame(rows, "app_id int, form_id int, value string")
    found = {r.app_id: (r.forms_processed, r.fields, r.filled, r.completion, [tuple(f) for f in r.forms]) for r in merge.application_records(df).collect()}
    assert found == {
        1: (3, 4, 2, 50.0, [(None, 1, 1, 100.0), (1, 1, 0, 0.0), (2, 2, 1, 50.0)]), None: (2, 2, 1, 50.0, [(None, 1, 0, 0.0), (1, 1, 1, 100.0)]), 2: (1, 1, 1, 100.0, [(None, 1, 1, 100.0)]),
    }
    levels = {(r.app_id, r.form_id, r.level): (r.forms, r.fields) for r in merge.application_summary(df).collect()}
    assert levels[1, None, 0] == (1, 1) and levels[1, None, 1] == (3, 4) and levels[None, None, 3] == (6, 7) and levels[None, None, 1] == (2, 2) and levels[None, None, 0] == (1, 1)
