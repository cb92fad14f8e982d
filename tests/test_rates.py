"""Tokens a minute: batch and stream agree, late usage is kept aside, restarts change nothing."""

from __future__ import annotations

import shutil
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerleaf.streaming.rates import RateLog, token_rates, window_sums

T0 = datetime(2024, 1, 1, 12)
USAGE = "account string, time timestamp, tokens int"


def rows(*some):
    return [(a, None if s is None else T0 + timedelta(seconds=s), n) for a, s, n in some]


def told(df):
    return sorted((r.account, r.start, r.end, r.tokens, r.requests) for r in df.collect())


def by_hand(usage, length=60, slide=10):
    out = {}
    for account, time, n in usage:
        if time is not None:
            first = int((time - T0).total_seconds() // slide) * slide
            for start in range(first, first - length, -slide):
                key = account, T0 + timedelta(seconds=start), T0 + timedelta(seconds=start + length)
                tokens, requests = out.get(key, (0, 0))
                out[key] = tokens + (n or 0), requests + 1
    return sorted((*k, *v) for k, v in out.items())


def test_windows_and_bands(spark):
    usage = rows(("a", 0, 20_000), ("a", 59.5, 10_001), ("a", 61, 5), ("b", 3, None), ("b", None, 9), (None, 3, 1))
    df = spark.createDataFrame(usage, USAGE)
    named = [r for r in usage if r[0] is not None]
    assert told(token_rates(df).where("account is not null")) == by_hand(named)
    over = {((r.start - T0).total_seconds(), r.risk) for r in token_rates(df).where("over").collect()}
    assert over == {(0.0, "HIGH")} and token_rates(df).where("account is null").count() == 6
    assert token_rates(df.limit(0)).count() == 0


def test_stream_agrees_with_batch(spark, tmp_path):
    parts = [
        rows(("a", 0, 100), ("b", 5, 7), ("a", 200, 50)),  # the watermark becomes 140
        rows(("a", 10, 1), ("a", 135, 2), ("b", 190, 3), ("b", None, 1)),  # 10 is late for all its windows, 135 for two of six
        rows(("a", 500, 4), ("b", 20, 5)), [], rows(("a", 501, 6)),
    ]
    log = RateLog(spark, str(tmp_path / "rates"))
    stream = lambda: spark.readStream.schema(USAGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for n, part in enumerate(parts):
        spark.createDataFrame(part, USAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        log.run_once(stream(), str(tmp_path / "state"))
        if n == 1:
            late = {(r.account, (r.start - T0).total_seconds(), r.tokens) for r in log.late().collect()}
            assert late == {("a", s, 1) for s in range(-40, 11, 10)} | {("a", 80.0, 2)}
    whole = [r for part in parts for r in part]
    assert told(log.whole()) == by_hand(whole) == told(token_rates(spark.createDataFrame(whole, USAGE)))
    assert told(log.windows()) != by_hand(whole)  # without what came late
    closed = told(log.closed())
    assert len(closed) == len({c[:3] for c in closed}) and all(end <= T0 + timedelta(seconds=441) for _, _, end, _, _ in closed)
    # a batch that is sent again, complete or cut off
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "rates").glob("mark=*"))
    before = told(log.whole()), told(log.windows()), told(log.late())
    shutil.rmtree(tmp_path / f"rates/mark={last}")
    log.absorb(spark.createDataFrame(parts[-1], USAGE), last)
    log.absorb(spark.createDataFrame(parts[-1], USAGE), last)
    assert (told(log.whole()), told(log.windows()), told(log.late())) == before


def test_sums_are_partial(spark):
    df = spark.range(100).select(F.lit("a").alias("account"), F.timestamp_seconds(F.col("id")).alias("time"), F.lit(1).alias("tokens"))
    plan = window_sums(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "NestedLoop" not in plan
