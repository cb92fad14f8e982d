"""Request batches, token and page budgets, size plans of images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENS_A_PAGE, PAGE_BUDGET, IMAGES_A_PAGE = 1500, 50, 1.2
SMALL_SIDE, LARGE_SIDE, FLAG_SIDE, WARN_SIDE = 1024, 1900, 1800, 2000


def assign_batches(files: DataFrame, key: str, order: str, n: int = 1) -> DataFrame:
    """``files`` with batch_ord: consecutive groups of ``n`` in the given order."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return files.withColumn("batch_ord", F.floor(number / n))


def tokens_by_pages(pages: Column) -> Column:
    return pages * TOKENS_A_PAGE


def base64_length(length: Column) -> Column:
    """Characters that base64 takes for so many bytes."""
    return F.floor((length + 2) / 3) * 4


def tokens_by_payload(pages: DataFrame, key: str) -> DataFrame:
    """(``key``, tokens): a third of the base64 characters of its pages (content)."""
    return pages.groupBy(key).agg(F.floor(F.sum(base64_length(F.octet_length("content"))) / 3).alias("tokens"))


def risk_band(tokens: Column, kind: str) -> Column:
    """``estimate`` and ``actual``: warn or ok; ``plan``: HIGH, MEDIUM or LOW."""
    if kind == "plan":
        return F.when(tokens > 25000, "HIGH").when(tokens > 20000, "MEDIUM").otherwise("LOW")
    return F.when(tokens > {"estimate": 30000, "actual": 20000}[kind], "warn").otherwise("ok")


def plan_totals(plan: DataFrame, files: DataFrame, key: str = "app_id") -> DataFrame:
    """Totals of the planned documents (name, est_pages) that exist in ``files`` (name, length): documents, pages, mb, images, tokens, risk; missing ones are counted."""
    joined = plan.join(files.select("name", "length"), "name", "left")
    there = F.col("length").isNotNull()
    out = joined.groupBy(key).agg(
        F.count_if(there).alias("documents"), F.count_if(~there).alias("missing"), F.coalesce(F.sum(F.when(there, F.col("est_pages"))), F.lit(0)).alias("pages"),
        (F.coalesce(F.sum("length"), F.lit(0)) / (1 << 20)).alias("mb"),
    )
    return out.withColumn("images", F.floor(F.col("pages") * IMAGES_A_PAGE)).withColumn("tokens", tokens_by_pages(F.col("pages"))).withColumn("risk", risk_band(F.col("tokens"), "plan"))


def page_budget(documents: DataFrame, key: str = "app_id", order: str = "ord", limit: int = PAGE_BUDGET) -> DataFrame:
    """``documents`` (pages) in order, as long as the running sum of pages stays within ``limit``."""
    running = F.sum("pages").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return documents.withColumn("running_pages", running).where(F.col("running_pages") <= limit)


def sample_kinds(files: DataFrame, key: str = "app_id", pdf: int = 3, total: int = 4) -> DataFrame:
    """At most ``pdf`` pdf files by path, then xlsx files until ``total`` are taken."""
    kinds = files.where("ext in ('.pdf', '.xlsx')").withColumn("_k", F.when(F.col("ext") == ".pdf", 0).otherwise(1))
    few = kinds.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_k").orderBy("path"))).where((F.col("_k") == 1) | (F.col("_n") <= pdf))
    return few.withColumn("pick", F.row_number().over(Window.partitionBy(key).orderBy("_k", "path"))).where(F.col("pick") <= total).drop("_k", "_n")


def image_size_plan(pages: DataFrame) -> DataFrame:
    """``pages`` (width, height) with new_width, new_height, large and too_large: small pages are scaled up, then large ones down, cut to whole pixels."""
    side = F.greatest("width", "height")
    up = F.when(side < SMALL_SIDE, SMALL_SIDE / side).otherwise(1.0)
    grown = pages.withColumn("_w", (F.col("width") * up).cast("int")).withColumn("_h", (F.col("height") * up).cast("int"))
    side = F.greatest("_w", "_h")
    down = F.when(side > LARGE_SIDE, LARGE_SIDE / side).otherwise(1.0)
    sized = grown.withColumn("new_width", (F.col("_w") * down).cast("int")).withColumn("new_height", (F.col("_h") * down).cast("int"))
    side = F.greatest("new_width", "new_height")
    return sized.withColumn("large", side > FLAG_SIDE).withColumn("too_large", side > WARN_SIDE).drop("_w", "_h")


def text_heavy(images: DataFrame, wrap: bool = True) -> DataFrame:
    """``images`` (origin, image of Spark's image source) → origin, variance, text_heavy, media_type.

    The variance of neighbour differences of the grey picture, across and down. With ``wrap`` the differences are taken modulo 256.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for height, width, channels, data in zip(b["height"], b["width"], b["channels"], b["data"], strict=True):
                x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.int64)
                grey = x[:, :, 0] if channels == 1 else (114 * x[:, :, 0] + 587 * x[:, :, 1] + 299 * x[:, :, 2]) // 1000
                across, down = np.diff(grey, axis=1), np.diff(grey, axis=0)
                if wrap:
                    across, down = across % 256, down % 256
                found.append(sum(float(np.var(d)) if d.size else 0.0 for d in (np.abs(across), np.abs(down))))
            yield pd.DataFrame({"origin": b["origin"], "variance": found, "text_heavy": [v > 100 for v in found]})

    flat = images.select(F.col("image.origin").alias("origin"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    out = flat.mapInPandas(each, "origin string, variance double, text_heavy boolean")
    return out.withColumn("media_type", F.when(F.col("text_heavy"), "image/png").otherwise("image/jpeg"))
