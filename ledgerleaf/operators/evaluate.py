"""Accuracy of extracted against expected values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC, SIMILAR = 0.01, 0.8


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def compare(expected: DataFrame, actual: DataFrame, tol: float = NUMERIC, alike: float = SIMILAR) -> DataFrame:
    """(app_id, field_name, kind, expected, actual, match): ``expected`` (app_id, field_name, kind, expected) and ``actual`` (app_id, field_name, actual) in a full outer join.

    Numbers and amounts match within ``tol``, texts from ``alike`` on; a value on one side alone doesn't match.
    """
    both = expected.join(actual, ["app_id", "field_name"], "full_outer")
    number = F.abs(F.col("expected").try_cast("double") - F.col("actual").try_cast("double")) <= tol + 1e-9
    text = similarity(F.col("expected"), F.col("actual")) >= alike
    return both.withColumn("match", F.coalesce(F.when(F.col("kind").isin("number", "currency"), number).otherwise(text), F.lit(False)))


def accuracy_band(share: Column) -> Column:
    return F.when(share >= 0.9, "excellent").when(share >= 0.8, "good").when(share >= 0.6, "acceptable").when(share >= 0.4, "poor").otherwise("failing")


def latency_band(seconds: Column) -> Column:
    return F.when(seconds <= 2, "fast").when(seconds <= 5, "acceptable").when(seconds <= 10, "slow").otherwise("too slow")


#: Size of a latency sketch: the rank of a quantile is off by about 1.3 %, by 2.7 % at most in all but one of a hundred sketches.
SKETCH = 200


def latency_sketches(runs: DataFrame, *keys: str) -> DataFrame:
    """(``keys`` ..., runs, slowest, sketch) of ``runs`` (seconds): a quantile sketch for each group, of a few kilobytes whatever its size.

    Sketches are made on each side of the shuffle, so a group's runs never meet; stored for each day, they merge into any period. A run without
    seconds counts in none.
    """
    seconds = F.col("seconds").cast("double")
    timed = runs.where(seconds.isNotNull() & ~F.isnan(seconds))
    return timed.groupBy(*keys).agg(F.count("*").alias("runs"), F.max(seconds).alias("slowest"), F.kll_sketch_agg_double(seconds, F.lit(SKETCH)).alias("sketch"))


def latency_quantiles(sketches: DataFrame, *keys: str, shares: tuple[float, ...] = (0.5, 0.99)) -> DataFrame:
    """(``keys`` ..., runs, slowest, and p50, p50_band and so on for each of ``shares``): the stored ``sketches`` merged into larger groups."""
    parts = sketches.groupBy(*keys).agg(F.sum("runs").alias("runs"), F.max("slowest").alias("slowest"), F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"))
    named = {f"p{share * 100:g}": F.kll_sketch_get_quantile_double("sketch", F.lit(share)) for share in shares}
    out = parts.select(*keys, "runs", "slowest", *[q.alias(n) for n, q in named.items()])
    return out.select("*", *[latency_band(F.col(f"`{n}`")).alias(f"{n}_band") for n in named])


def accuracy(compared: DataFrame) -> DataFrame:
    """(app_id, accuracy, band)."""
    share = F.avg(F.col("match").cast("double"))
    return compared.groupBy("app_id").agg(share.alias("accuracy")).withColumn("band", accuracy_band(F.col("accuracy")))
