"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers of ``spark``, once for each application; returns ``spark``."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).parent
        to = Path(tempfile.mkdtemp(prefix="ledgerleaf-")) / "ledgerleaf.zip"
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(str(to))
        _SHIPPED.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the configured checkpoint folder; one of our own only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ledgerleaf-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def unsized(df: DataFrame) -> DataFrame:
    """``df``, saved, without the size that Spark has estimated for it; for loops.

    The estimate of a join is the product of those of its sides, and a checkpoint keeps it. Where each round joins what the one before has saved,
    the number's digits multiply from round to round, until they fill the driver's memory. Rows are read as Row objects, so it is for short ones.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), spark)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, in any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def numbered(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers n of the complete tables ``folder/name=n``, ascending."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}=*/_SUCCESS")
    there = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found)
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in there or [])


def dealt_out(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` dealt by the columns ``by`` over as many partitions as it has times ``rows`` rows, and at least one for each core.

    So what a task holds doesn't grow with the table, and work on a few small files isn't a few tasks. Rows are counted in a pass of its own.
    There are no more partitions than Spark's shuffle writes without holding rows (200): beyond them a map task would hold all of its split of
    the file, whereas a partition takes a 200th of the table, in aggregates that spill.
    """
    context = df.sparkSession.sparkContext
    most = int(context.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return df.repartition(min(most, max(context.defaultParallelism, -(-df.count() // rows))), *by)
