"""Scans of document folders, and row limits on what was scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.functions.values import extension

SUPPORTED = ("pdf", "xlsx", "xls", "png", "jpg", "jpeg")
NESTED = ("pdf", "xlsx", "xls")
FILE = "path string, modificationTime timestamp, length long, content binary"


def scan_files(spark: SparkSession, folder: str, recursive: bool = False, content: bool = True) -> DataFrame:
    """Files of a folder with a known extension (case matters): one level, or at any depth for documents and workbooks. A missing folder has none.

    The bytes are read only if a later step selects them.
    """
    kinds = NESTED if recursive else SUPPORTED
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], FILE)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(kinds) + "}").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files if content else files.drop("content")


def match_requested(requested: DataFrame, scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) of ``requested`` (path, ...) in ``scan``."""
    there = scan.select("path")
    return requested.join(there, "path", "left_semi"), requested.join(there, "path", "left_anti")


def file_meta(files: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``files`` (path, length, ...) with ext, mb and, given ``pages`` (path, ...), pages."""
    out = files.withColumn("ext", extension(F.col("path"))).withColumn("mb", F.col("length") / (1 << 20))
    if pages is None:
        return out
    return out.join(pages.groupBy("path").agg(F.count("*").alias("pages")), "path", "left").fillna(0, ["pages"])


def select_sheets(cells: DataFrame, max_sheets: int = 5, min_rows: int = 2) -> DataFrame:
    """``cells`` (doc_id, sheet_idx, sheet_name, row, col, value) of the first sheets that have rows enough, with column named; a document left without any has one error row.

    The first ``max_sheets`` sheets are taken before small ones are dropped, so none moves up.
    """
    first = cells.where(F.col("sheet_idx") < max_sheets)
    sizes = first.groupBy("doc_id", "sheet_idx").agg((F.max("row") + 1).alias("_rows")).where(F.col("_rows") >= min_rows).select("doc_id", "sheet_idx")
    kept = first.join(sizes, ["doc_id", "sheet_idx"], "left_semi").withColumn("value", F.col("value").cast("string"))
    kept = kept.withColumn("column", F.concat(F.lit("Col_"), F.col("col").cast("string"))).withColumn("error", F.lit(None).cast("string"))
    bare = cells.select("doc_id").distinct().join(sizes.select("doc_id"), "doc_id", "left_anti").withColumn("error", F.lit("no usable sheet"))
    return kept.unionByName(bare, allowMissingColumns=True)


def cap_pages(pages: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` pages of each document."""
    return pages.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no"))).where(F.col("_n") <= n).drop("_n")


def text_prefix(files: DataFrame, n: int = 2000) -> DataFrame:
    """``files`` with text: the first ``n`` characters of the content as UTF-8, bytes that are none left out; null content is an error row."""
    text = F.replace(F.make_valid_utf8(F.col("content").cast("binary").cast("string")), F.lit("�"), F.lit(""))
    return files.withColumn("text", F.substring(text, 1, n)).withColumn("error", F.when(F.col("content").isNull(), "unreadable"))
