"""The content registry as it lives across runs: files arrive as a stream, each content is passed on once, known ones are reused.

The registry is a folder of tables: ``base=k`` is the registry as of batch k, ``log=n`` holds the entries of batch n. Batch n sees
the latest base before it and the logs since; its log is written last and completes it, so a batch that is run again either finds its
log and does nothing, or writes the same tables over. Nothing is forgotten by time: a file may be of any age, and a content known for a
year is known. Only names, hashes and ids are joined and stored; the bytes are read once, to be hashed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions.values import extension, mime_type
from ledgerleaf.operators.registry import expired
from ledgerleaf.session import numbered
from ledgerleaf.sources.files import FILE, SUPPORTED

ENTRY = "hash string, file_id string, name string, path string, size long, mime_type string, uploaded_at double"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """Files with a known extension that come into a folder, as a stream. By default a stream passes over files a week older than the newest; here age doesn't matter."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", "*.{" + ",".join(SUPPORTED) + "}")
    return files.option("maxFileAge", "36500d").load(folder)


class Registry:
    """A registry below ``folder``, which all executors share. One stream writes to it at a time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def entries(self, before: int | None = None) -> DataFrame:
        """The registry (hash, file_id, name, path, size, mime_type, uploaded_at), one entry for each hash, the latest; ``before``: as batch ``before`` finds it."""
        fits = lambda n: before is None or n < before
        base = max((n for n in numbered(self.spark, self.folder, "base") if fits(n)), default=None)
        logs = [n for n in numbered(self.spark, self.folder, "log") if fits(n) and (base is None or n > base)]
        parts = [("base", base)] * (base is not None) + [("log", n) for n in logs]
        if not parts:
            return self.spark.createDataFrame([], ENTRY)
        read = lambda part: self.spark.read.schema(ENTRY).parquet(f"{self.folder}/{part[0]}={part[1]}").withColumn("_batch", F.lit(part[1]))
        rows = reduce(DataFrame.unionByName, map(read, parts))
        own = [f.name for f in rows.schema if f.name not in ("hash", "_batch")]
        return rows.drop("_batch") if not logs else rows.groupBy("hash").agg(F.max_by(F.struct(*own), "_batch").alias("e")).select("hash", "e.*")

    def absorb(self, files: DataFrame, batch: int, now: Column | float, force: bool = False, days: int | None = None) -> None:
        """Judges ``files`` (path, content, and length if known) as batch number ``batch``.

        Of a content that isn't registered, the first file by path is new and gets an id; all other files reuse the id of theirs. ``force``
        makes every content new, and its entry replaces the old one. With ``days``, entries older than that at ``now`` (epoch seconds) don't
        count. Written are ``seen=batch`` (path, hash, file_id, new) and ``log=batch``, the new entries.
        """
        if batch in numbered(self.spark, self.folder, "log"):
            return
        now = now if isinstance(now, Column) else F.lit(float(now))
        size = F.col("length") if "length" in files.columns else F.octet_length("content").cast("long")
        hashed = files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), size.alias("size")).where("hash is not null")
        hashed.write.mode("overwrite").parquet(f"{self.folder}/hashed={batch}")
        hashed = self.spark.read.schema("path string, hash string, size long").parquet(f"{self.folder}/hashed={batch}")
        known = self.entries(batch)
        known = known if days is None else known.where(~expired(F.col("uploaded_at"), now, days))
        known = known.limit(0) if force else known
        first = hashed.groupBy("hash").agg(F.min("path").alias("first")).join(known.select("hash", F.col("file_id").alias("known")), "hash", "left")
        # an id follows from the content and the batch that registered it
        ids = first.select("hash", "first", F.col("known").isNull().alias("fresh"), F.coalesce("known", F.concat(F.lit("file-"), F.substring(F.sha2(F.concat("hash", F.lit(f":{batch}")), 256), 1, 24))).alias("file_id"))
        seen = hashed.join(ids, "hash").select("path", "hash", "size", "file_id", (F.col("fresh") & (F.col("path") == F.col("first"))).alias("new"))
        seen.write.mode("overwrite").parquet(f"{self.folder}/seen={batch}")
        fresh = self.spark.read.schema("path string, hash string, size long, file_id string, new boolean").parquet(f"{self.folder}/seen={batch}").where("new").dropDuplicates(["hash"])
        name = F.regexp_extract("path", r"([^/]*)$", 1)
        fresh.select("hash", "file_id", name.alias("name"), "path", "size", mime_type(extension(F.col("path"))).alias("mime_type"), now.cast("double").alias("uploaded_at")).write.mode("overwrite").parquet(f"{self.folder}/log={batch}")

    def seen(self) -> DataFrame:
        """(path, hash, size, file_id, new, batch) of all files of complete batches."""
        done = numbered(self.spark, self.folder, "log")
        schema = "path string, hash string, size long, file_id string, new boolean"
        if not done:
            return self.spark.createDataFrame([], schema + ", batch int")
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.folder}/seen={n}").withColumn("batch", F.lit(n)) for n in done])

    def compact(self) -> None:
        """Writes the registry as of now as a base, so that later batches read one table instead of all logs."""
        done = numbered(self.spark, self.folder, "log")
        if done and done[-1] not in numbered(self.spark, self.folder, "base"):
            self.entries().write.mode("overwrite").parquet(f"{self.folder}/base={done[-1]}")

    def run_once(self, files: DataFrame, checkpoint: str, now: float, force: bool = False, days: int | None = None) -> None:
        """Absorbs what has arrived on the stream ``files`` since the last run with this checkpoint.

        A batch's number is the stream's own, so a batch that was cut off is done again under the same number. A stream with a new checkpoint
        needs a new registry.
        """
        each = lambda batch, number: self.absorb(batch, number, now, force, days)
        files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
