"""Mixing of sources to target weights by a low-discrepancy schedule (DataFrame functions only).

The words of each source are laid out in a shuffled order and cut into blocks of equal size, BLOCK words; a source too small for
LEAST such blocks has smaller ones, down to one word. Slot t of the schedule takes the golden-ratio point frac((t + 1) / phi), which
the cumulative targets map to a source; the source's next BLOCK words, one block or as many small ones as make them up, go there,
beginning anew after the last one. Every prefix of the schedule then has nearly the target shares. A source has as many blocks in all
as its target needs; those that the points don't give it are spread evenly over the schedule. Positions inside a source and ranks
of slots are running sums over chunks that grow in number with the source, whose totals are summed first, so that no source is
ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.common import WORD, saved

#: Most passes over a source; words of a block; cells of [0, 1) by which points meet sources; rows of a chunk; slots of a chunk; chunks that are summed at once.
MOST, BLOCK, CELLS, CHUNK, RUN, FEW = 3, 256, 4096, 1024, 8192, 1024
GOLDEN = 0.6180339887498949
#: Fewest blocks of a source that has as many words.
LEAST = 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``sources`` (source, source_size) with weight and target.

    Weights follow the sources in code-point order, null last. Targets share the sum of the sizes by weight, at most MOST times
    a source's size; the excess is shared again. In ascending order of MOST * size / weight the sources at their limit come first.
    One row for each source, so the windows hold as many rows as there are sources.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(names) - 1) % len(cycle) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * MOST)
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    share = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("share", share).withColumn("full", F.col("most") <= F.col("weight") * F.col("share"))
    level = F.max(F.when(~F.col("full"), F.col("share"))).over(everything)
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * level)
    return s.select("source", "source_size", "weight", target.cast("double").alias("target"))


def block_words(block: int) -> Column:
    """Words of a block of a source of source_size words: at most ``block``, all blocks as even as whole words allow."""
    size = F.greatest(F.col("source_size"), F.lit(1))
    count = F.greatest(F.ceil(size / block), F.least(size, F.lit(LEAST)))
    return F.ceil(size / count)


def schedule(goals: DataFrame, total: int, block: int) -> DataFrame:
    """(slot, no, epoch, block) from ``goals`` (no, source_size, target): source no's r-th slot takes block r modulo its blocks.

    Slots beyond MOST passes over a source or beyond its target are left out.
    """
    spark, slots = goals.sparkSession, (total + block - 1) // block
    blocks = F.ceil(F.col("source_size") / block_words(block))
    own = goals.where("target > 0 and source_size > 0").withColumn("blocks", blocks)
    own = own.withColumn("ranks", F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.col("blocks") * MOST))
    own = saved(own.select("no", "blocks", "ranks", F.greatest(F.round(block / block_words(block)), F.lit(1)).cast("long").alias("each")))
    upto = F.sum("target").over(Window.orderBy("no").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("target").over(Window.partitionBy())
    cuts = goals.withColumn("hi", upto).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("no")), F.lit(0.0)))
    last = F.col("no") == F.max("no").over(Window.partitionBy())
    cuts = cuts.withColumn("hi", F.when(last, 1.0).otherwise(F.col("hi"))).where("target > 0").select("no", "lo", "hi")
    cells = saved(cuts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1))))))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0)).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * CELLS))
    placed = points.join(cells, "cell").where("x >= lo and x < hi").select("slot", "no", F.floor(F.col("slot") / RUN).alias("run"))
    runs = running(placed.groupBy("no", "run").agg(F.count("*").alias("n")), "run", "n")
    given = runs.groupBy("no").agg(F.sum("n").alias("points"))
    runs = runs.select("no", "run", "base")
    turn = F.col("base") + F.row_number().over(Window.partitionBy("no", "run").orderBy("slot")) - 1
    ranked = placed.join(runs, ["no", "run"]).select("slot", "no", turn.alias("turn")).join(F.broadcast(own.select("no", "each")), "no")
    ranked = ranked.select("slot", "no", F.explode(F.sequence(F.col("turn") * F.col("each"), (F.col("turn") + 1) * F.col("each") - 1)).alias("rank"))
    lacking = own.join(given, "no", "left").withColumn("given", F.coalesce(F.col("points") * F.col("each"), F.lit(0))).where("ranks > given")
    lacking = lacking.withColumn("rank", F.explode(F.sequence(F.col("given"), F.col("ranks") - 1)))
    spread = F.floor((F.col("rank") - F.col("given") + 0.5) / (F.col("ranks") - F.col("given")) * slots)
    out = ranked.unionByName(lacking.select(spread.alias("slot"), "no", "rank")).join(F.broadcast(own), "no").where("rank < ranks")
    return out.select("slot", "no", F.floor(F.col("rank") / F.col("blocks")).alias("epoch"), (F.col("rank") % F.col("blocks")).alias("block")).where(F.col("epoch") < MOST)


def running(sums: DataFrame, order: str, value: str) -> DataFrame:
    """``sums`` (no, ``order``: a number from 0 on, ``value``) with base, what comes before in the order of its no; FEW rows of the order are summed together first.

    Both sums and result are saved, as they are read more than once and are small: a row for each chunk.
    """
    sums = saved(sums)
    before = lambda *by: F.coalesce(F.sum(value).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.floor(F.col(order) / FEW)
    whole = sums.groupBy("no", part.alias("_part")).agg(F.sum(value).alias(value))
    whole = whole.select("no", "_part", before("no", "_part").alias("_base"))
    inside = sums.withColumn("_part", part).withColumn("_inside", before("no", "_part", order))
    return saved(inside.join(whole, ["no", "_part"]).withColumn("base", F.col("_base") + F.col("_inside")).drop("_part", "_base", "_inside"))


def laid_out(rows: DataFrame) -> DataFrame:
    """``rows`` (row, doc_id, text_id, no, size) with start: the words of the same source that come before it in the shuffled order."""
    mixed = F.xxhash64(F.lit("mix"), "doc_id", "text_id")
    r = rows.where("size > 0").withColumn("mixed", mixed)
    chunks = r.groupBy("no").agg(F.ceil(F.count("*") / CHUNK).alias("_chunks"))
    r = r.join(F.broadcast(chunks), "no").withColumn("chunk", F.pmod(F.shiftright("mixed", 20), F.col("_chunks"))).drop("_chunks")
    sums = running(r.groupBy("no", "chunk").agg(F.sum("size").alias("words")), "chunk", "words").drop("words")
    # rows that tie up to their text are equal in all that the result holds
    inside = Window.partitionBy("no", "chunk").orderBy("mixed", "size", "text_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    return r.join(sums, ["no", "chunk"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))


def pieces(rows: DataFrame, block: int) -> DataFrame:
    """One row for each block that a document's words fall into: row, no, block, words."""
    end, step = F.col("start") + F.col("size"), F.col("step")
    out = laid_out(rows).withColumn("step", block_words(block)).withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((end - 1) / step))))
    words = F.least(end, (F.col("block") + 1) * step) - F.greatest("start", F.col("block") * step)
    return out.select("row", "no", "block", words.alias("words"))


def mix(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), block: int = BLOCK) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) → row, doc_id, text_id, size, source, source_size, target, taken.

    One row for each input row, repeated ids included. size: words of the text, 0 for a null or empty one, which is never taken; a
    text of any length counts whole. taken: the document's words in all scheduled blocks, repeats counted; at most MOST times size.
    A null source is a source of its own. The result depends on the rows' ids and texts alone, so runs agree, over other partitions
    too. Sources are met in one window, so their number must fit a task. Other columns don't matter, whatever their names. An empty
    table gives none.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_id")).withColumn("row", F.monotonically_increasing_id())
    rows = saved(rows)
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), cycle)
    goals = saved(goals.withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    total = goals.agg(F.sum("source_size")).first()[0] or 0
    known = goals.select(F.col("source").alias("goal"), "no", "source_size", "target")
    named = rows.join(known, F.col("source").eqNullSafe(F.col("goal"))).drop("goal")
    # the schedule and what it takes are saved, so that no plan holds both and the rows again
    used = saved(schedule(goals, total, block).groupBy("no", "block").agg(F.count("*").alias("times")))
    taken = saved(pieces(named, block).join(used, ["no", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken")))
    out = named.join(taken, "row", "left")
    return out.select("row", "doc_id", "text_id", "size", "source", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
