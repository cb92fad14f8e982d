"""Content registry: hashing, reuse of earlier uploads, retention. A registry has hash, file_id, name, path, size, mime_type, uploaded_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def with_hash(files: DataFrame) -> DataFrame:
    """``files`` with hash, the SHA-256 of their content (text or bytes)."""
    return files.withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))


def split_new(files: DataFrame, registry: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files whose content is known, with its file_id; one file for each content to be processed)."""
    known = registry.select("hash", "file_id")
    cached = files.join(known, "hash")
    fresh = files if force else files.join(known, "hash", "left_anti")
    order = Window.partitionBy("hash").orderBy("path")
    new = fresh.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return (cached.limit(0) if force else cached), new


def upsert(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with ``new`` entries put in place of those with their hash; of several, the latest, and of equal times the last path."""
    both = registry.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy("hash").orderBy(F.desc("_new"), F.desc_nulls_last("uploaded_at"), F.desc("path"))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def lookup(files: DataFrame, registry: DataFrame) -> DataFrame:
    """``files`` (hash, ...) with the file_id of their content, or null."""
    return files.join(registry.groupBy("hash").agg(F.max("file_id").alias("file_id")), "hash", "left")


def drop_ids(registry: DataFrame, deleted: DataFrame) -> DataFrame:
    """The registry without any entry whose file_id is among ``deleted`` (file_id): those whose remote deletion succeeded."""
    return registry.join(deleted.select("file_id"), "file_id", "left_anti")


def expired(uploaded_at: Column, now: float, days: int = 7) -> Column:
    """Whether an entry is older than ``days`` before ``now`` (epoch seconds); one without a time always is."""
    return F.coalesce(uploaded_at, F.lit(0.0)) < now - days * DAY


def expire(registry: DataFrame, now: float, days: int = 7) -> DataFrame:
    return registry.where(~expired(F.col("uploaded_at"), now, days))


def stats(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count("*").alias("entries"), (F.coalesce(F.sum(F.coalesce("size", F.lit(0))), F.lit(0)) / (1 << 20)).alias("total_mb"))


def drift(templates: DataFrame, stored: DataFrame) -> DataFrame:
    """``templates`` (template_id, content) against ``stored`` (template_id, md5): changed is null for one not stored before."""
    now = templates.select("template_id", F.md5(F.col("content").cast("binary")).alias("md5"))
    return now.join(stored.select("template_id", F.col("md5").alias("stored_md5")), "template_id", "left").withColumn("changed", F.col("md5") != F.col("stored_md5"))


def keep_recent(datasets: DataFrame, now: Column, most: int = 50, days: int = 30) -> DataFrame:
    """The ``most`` latest of ``datasets`` (dataset_id, created) that are at most ``days`` old."""
    recent = datasets.where(F.col("created") >= now - F.make_dt_interval(F.lit(days)))
    return recent.orderBy(F.desc("created"), "dataset_id").limit(most)
