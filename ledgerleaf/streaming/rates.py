"""Tokens a minute against the service's limit, over sliding windows of event time, as a batch and as a stream.

The stream keeps partial sums of the windows that are still open, one table after each batch, so its state is as large as the windows
that the watermark leaves open. A window is closed when the watermark passes its end, and is written once. What comes for a window
that is closed goes to a side table, so windows and late sums together are what a batch over all usage gives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.operators.planning import risk_band
from ledgerleaf.session import numbered

#: Fixed value: tokens that the service takes in a minute.
LIMIT = 30_000
KEYS = ["account", "start", "end"]


def window_sums(usage: DataFrame, length: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """(account, start, end, tokens, requests) of ``usage`` (account, time, tokens): each request counts in every window that holds its time.

    A null count of tokens is 0; a request without a time is in no window.
    """
    each = usage.where("time is not null").select("account", F.window("time", length, slide).alias("w"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    return each.groupBy("account", F.col("w.start").alias("start"), F.col("w.end").alias("end")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("requests"))


def judged(windows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``windows`` with risk, the band of their tokens, and over, whether they pass the limit."""
    return windows.withColumn("risk", risk_band(F.col("tokens"), "plan")).withColumn("over", F.col("tokens") > limit)


def token_rates(usage: DataFrame, length: str = "60 seconds", slide: str = "10 seconds", limit: int = LIMIT) -> DataFrame:
    """(account, start, end, tokens, requests, risk, over): all windows with a request, as one batch."""
    return judged(window_sums(usage, length, slide), limit)


def _added(sums: DataFrame) -> DataFrame:
    return sums.groupBy(*KEYS).agg(F.sum("tokens").alias("tokens"), F.sum("requests").alias("requests"))


class RateLog:
    """The windows of a stream of usage, in tables below ``folder``, which all executors share. One stream writes to it."""

    def __init__(self, spark: SparkSession, folder: str, delay: int = 60, length: str = "60 seconds", slide: str = "10 seconds") -> None:
        """``delay``: seconds that the watermark stays behind the latest time seen."""
        self.spark, self.folder, self.delay, self.how = spark, folder, delay, (length, slide)
        account = "account string, start timestamp, end timestamp, tokens long, requests long"
        self.schema = {"open": account, "closed": account, "late": account, "mark": "latest timestamp"}

    def _read(self, name: str, numbers: list[int]) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], self.schema[name])
        return reduce(DataFrame.unionByName, [self.spark.read.schema(self.schema[name]).parquet(f"{self.folder}/{name}={n}") for n in numbers])

    def absorb(self, usage: DataFrame, batch: int) -> None:
        """Adds ``usage`` (account, time, tokens) as batch number ``batch``; one that is complete is left as it is.

        A row is late for a window whose end the watermark of the batches before has reached. mark is written last and completes a batch.
        """
        done = numbered(self.spark, self.folder, "mark")
        if batch in done:
            return
        before = [n for n in done if n < batch][-1:]
        old = self._read("mark", before).first()
        old = old.latest if old else None
        seen = usage.agg(F.max("time")).first()[0]
        latest = max((t for t in (old, seen) if t is not None), default=None)
        passed = lambda t: F.lit(False) if t is None else F.col("end") <= F.lit(t) - F.make_dt_interval(secs=F.lit(self.delay))
        sums = window_sums(usage.withColumn("account", F.col("account").cast("string")), *self.how)
        sums.write.mode("overwrite").parquet(f"{self.folder}/sums={batch}")
        sums = self.spark.read.schema(self.schema["open"]).parquet(f"{self.folder}/sums={batch}")
        sums.where(passed(old)).write.mode("overwrite").parquet(f"{self.folder}/late={batch}")
        now = _added(self._read("open", before).unionByName(sums.where(~passed(old))))
        now.where(passed(latest)).write.mode("overwrite").parquet(f"{self.folder}/closed={batch}")
        now.where(~passed(latest)).write.mode("overwrite").parquet(f"{self.folder}/open={batch}")
        self.spark.createDataFrame([(latest,)], self.schema["mark"]).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/mark={batch}")

    def closed(self) -> DataFrame:
        """The windows that are done, each once."""
        return self._read("closed", numbered(self.spark, self.folder, "mark"))

    def late(self) -> DataFrame:
        """(account, start, end, tokens, requests) that came for windows when they were closed."""
        return _added(self._read("late", numbered(self.spark, self.folder, "mark")))

    def windows(self) -> DataFrame:
        """All windows, closed or open, without what came late."""
        return self.closed().unionByName(self._read("open", numbered(self.spark, self.folder, "mark")[-1:]))

    def whole(self) -> DataFrame:
        """What token_rates() gives for all usage that has come."""
        return judged(_added(self.windows().unionByName(self.late())))

    def run_once(self, usage: DataFrame, checkpoint: str) -> None:
        """Absorbs what has come on the stream ``usage`` since the last run with this checkpoint, batch by batch."""
        usage.writeStream.foreachBatch(self.absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
