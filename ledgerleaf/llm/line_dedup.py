"""Lines that many documents share are dropped everywhere but in one document; DataFrame functions only.

Texts are exploded to lines; a line's key is hashed to 128 bits, the distinct documents of each hash are counted, the places of lines
whose key is over the threshold are found by a join on the hash, and each text is put together again from its other lines by position.

Only hashes, ids and positions are shuffled for the counts; texts meet the places of their dropped lines once. A key on so many lines
that one task would get a good part of them (there are at most HEAVY_PART such keys) meets its lines in a broadcast, all others in
a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import ascii_lower, saved

#: White space that counts at the ends of a line.
ENDS = " \t\n\x0b\x0c\r"
#: A key with this part of all lines of frequent keys, and HEAVY_LINES at least, is heavy: so at most HEAVY_PART keys are.
HEAVY_PART, HEAVY_LINES = 4096, 256


def lines_of(text: Column) -> Column:
    """The text split at line ends; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """What tells rows apart: the id and a hash of the text, so that rows that repeat an id keep lines of their own."""
    return [F.col(doc_id).alias("__id"), F.xxhash64(F.col(text)).alias("__text")]


def _hashed(docs: DataFrame, least_length: int) -> DataFrame:
    """(h1, h2, __id, __text, pos) of each line whose key is long enough; pos counts from 1."""
    texts = docs.select(*_row(), lines_of(F.col("text")).alias("lines"))  # the text is hashed once, not for each of its lines
    bare = texts.select("__id", "__text", F.posexplode("lines").alias("at", "line")).select("__id", "__text", (F.col("at") + 1).alias("pos"), F.trim("line", F.lit(ENDS)).alias("bare"))
    key = ascii_lower(F.col("bare"))  # as long as it was
    return bare.where(F.char_length("bare") >= least_length).select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), "__id", "__text", "pos")


def frequent_lines(docs: DataFrame, least_length: int = 40, least_documents: int = 5) -> DataFrame:
    """(h1, h2, keeper, lines): hashes of keys found in enough documents, the largest doc_id that holds one, and its lines in all.

    Distinct ids are counted; rows without an id are one document together, smaller than all others.
    """
    found = _hashed(docs, least_length).groupBy("h1", "h2", "__id").agg(F.count("*").alias("lines"))  # summed up before the shuffle
    n = found.groupBy("h1", "h2").agg(F.count("*").alias("documents"), F.max("__id").alias("keeper"), F.sum("lines").alias("lines"))
    return n.where(F.col("documents") >= least_documents).drop("documents")


def dropped_places(docs: DataFrame, frequent: DataFrame, least_length: int = 40) -> DataFrame:
    """(__id, __text, pos) of the lines that go; ``frequent`` as saved by the caller."""
    total = frequent.agg(F.sum("lines")).first()[0] or 0
    heavy = F.col("lines") >= max(HEAVY_LINES, -(-total // HEAVY_PART))
    few = F.broadcast(frequent.where(heavy).select("h1", "h2", F.col("keeper").alias("known")))
    # lines of heavy keys have met theirs already, so they pass the shuffle under hashes of their places
    lines = _hashed(docs, least_length).join(few, ["h1", "h2"], "left")
    met = F.col("known").isNotNull()
    lines = lines.select(F.when(met, F.xxhash64("__id", "__text", "pos")).otherwise(F.col("h1")).alias("h1"), F.when(met, 0).otherwise(F.col("h2")).alias("h2"), "known", "__id", "__text", "pos")
    keeper = F.coalesce("known", "keeper")
    return lines.join(frequent.where(~heavy).drop("lines"), ["h1", "h2"], "left").where(keeper.isNotNull() & ~F.col("__id").eqNullSafe(keeper)).select("__id", "__text", "pos")


def deduplicate(docs: DataFrame, least_length: int = 40, least_documents: int = 5) -> DataFrame:
    """``docs`` (doc_id, text, ...) → its columns and __n_lines, __n_dropped, __kept (the text without its dropped lines).

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of ``least_length`` code points or more in
    ``least_documents`` documents or more lose all their lines except in the document with the largest doc_id among them, which keeps
    all of its own. Other lines stay as they are, joined by line ends. Null and empty texts are one empty line, which stays. Rows that
    share an id are one document when documents are counted, and each keeps its row; rows without an id are one document, never the
    one that keeps. A line of any length and a text of any number of lines are whole. Other columns are handed on, whatever
    their names but those that begin with two underscores. An empty table gives no rows.
    """
    frequent = saved(frequent_lines(docs, least_length, least_documents))
    gone = dropped_places(docs, frequent, least_length).groupBy("__id", "__text").agg(F.collect_set("pos").alias("__gone"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__text"))
    told = docs.join(gone, same, "left").drop("__id", "__text")
    # one pass over the lines: the places that stay are a difference of sets, and the split text is bound once
    kept = lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col("__gone")), lambda at: F.element_at(lines, at)), "\n")
    whole = F.coalesce(F.col("text"), F.lit(""))
    left = F.when(F.col("__gone").isNull(), whole).otherwise(F.transform(F.array(lines_of(F.col("text"))), kept)[0])
    n_lines = F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    dropped = F.coalesce(F.size("__gone"), F.lit(0))
    return told.select(*docs.columns, n_lines.cast("long").alias("__n_lines"), F.when(F.col("__gone").isNull(), 0).otherwise(dropped).cast("long").alias("__n_dropped"), left.alias("__kept"))
