"""From documents to token ids: quality, language, near duplicates, source mix, sampled pieces.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and works on all that its predecessor kept. Null and
empty texts are judged like others by the classifier, have no language and go there. An empty table passes every stage as an empty one.
Other columns are handed on, whatever their names but those that begin with two underscores, up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import langid, mixing, piece_sampling, quality, shingle_join
from ledgerleaf.llm.common import fold, saved, shared_folder, table
from ledgerleaf.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 or more); learned from the labelled ones among ``docs``."""
    model = quality.learned(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return docs.where(quality.scorer(model)("text") >= 0.3)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those without a letter, and those near no centroid, go."""
    model = langid.fit(ship(spark) and docs.where(fold(F.col("doc_id"), 4) != 2))
    return docs.where(langid.accepter(model)("text"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest id (ties: the hash of the text; rows without an id come last).

    Texts decide, not ids: different texts under one id stay unless they are near duplicates, and rows equal in id and text are
    copies, of which one stays. Texts without words are near nothing, so they all stay.
    """
    found = saved(shingle_join.classes_of(ship(spark) and docs))
    worded = found.where("n > 0")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_id")
    first = saved(worded.groupBy("component").agg(F.min(row).alias("first"), F.count("*").alias("rows")).where("rows > 1").select("component", "first"))
    gone = worded.join(_small(first), "component").where(~row.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("__id"), F.col("text_id").alias("__text")).distinct()
    again = worded.groupBy(F.col("doc_id").alias("__id"), F.col("text_id").alias("__text")).count().where("count > 1").select("__id", "__text")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (shingle_join.text_id(F.col("text")) == F.col("__text"))
    stay, again = docs.join(_small(gone), same, "left_anti"), _small(again)
    if again.isEmpty():
        return stay
    return stay.join(again, same, "left_anti").unionByName(stay.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` (ids and hashes, no texts) saved, and broadcast if they are at most a million."""
    rows = saved(rows)
    return F.broadcast(rows) if rows.count() <= 1_000_000 else rows


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes its words, rounded; those that it takes less than half of go.

    Rows that share an id are told apart by the hash of their text; rows equal in both have one mean. Texts without words go, as the
    mix takes words only.
    """
    text = shingle_join.text_id(F.col("text"))
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("__mix_id"), F.col("text_id").alias("__mix_text"), F.col("source").alias("__mix_source"))
    taken = taken.agg(F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias("__mix_times"))
    same = F.col("doc_id").eqNullSafe(F.col("__mix_id")) & (text == F.col("__mix_text")) & F.col("source").eqNullSafe(F.col("__mix_source"))
    named = docs.join(taken, same).where("__mix_times > 0")
    return named.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), "__mix_times"))).select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and ids, the sampled pieces of the text, which decode to it exactly."""
    return piece_sampling.encode(ship(spark) and docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece encoding", pieces_stage),
]

#: Centroids, seeded sampling and a schedule of points have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            _removed(spark, f"{folder}/{number - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)


def _removed(spark: SparkSession, folder: str) -> None:
    """Removes a stage's rows, which no later stage reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
