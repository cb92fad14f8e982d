"""URL filter by a cascade of Bloom filters (DataFrame functions only).

Level 1 encodes the listed keys. The unlisted keys of the universe that it lets through are encoded by level 2, the listed keys
that level 2 lets through by level 3, and so on, until a level lets nothing wrong through: over that universe the answer is
exact. The key space is cut into shards by hash, each level of a shard is one bitmap of 4 KB, so filters grow by adding bitmaps.
Up to ``LITERAL_BYTES`` a level's bitmaps stand in the expression itself, as a literal: rows are judged where they are, without a
join. A larger level is met by a join on shard and salt, so that the many rows of one key don't meet in one task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import ascii_lower, saved

BITS, HASHES, KEYS_PER_SHARD, LITERAL_BYTES, SALTS = 32768, 5, 2048, 8 << 20, 64


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty for null and where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and action of the longest of ``rules`` (action, host, path) that fits; null where none does."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, action = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(act)).otherwise(action)
    return text, action


def _shard(key: Column, shards: int) -> Column:
    """Shard of a key. The level's number isn't part of it, as its bits are hashed with that."""
    return F.pmod(F.xxhash64(key), F.lit(shards))


def _positions(key: Column, level: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(BITS)) for j in range(HASHES)])


def _hit(bitmap: Column, key: Column, level: int) -> Column:
    """Whether every bit of ``key`` is set; false for a null bitmap."""

    def bit(j: int) -> Column:
        at = F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(BITS)).cast("int")
        byte = F.conv(F.hex(F.substring(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1)) == 1

    return F.coalesce(reduce(lambda a, b: a & b, map(bit, range(HASHES))), F.lit(False))


class Level:
    """One level: ``bitmaps`` (shard, bitmap) for ``shards`` shards; those of a small level are read once, at most LITERAL_BYTES of them."""

    def __init__(self, bitmaps: DataFrame, shards: int, number: int):
        self.bitmaps, self.shards, self.number, self.literal = bitmaps, shards, number, None
        if shards * BITS // 8 <= LITERAL_BYTES:
            known = {r.shard: bytes(r.bitmap) for r in bitmaps.collect()}
            self.literal = F.array(*[F.lit(known[i]) if i in known else F.lit(None).cast("binary") for i in range(shards)])

    def marked(self, rows: DataFrame, key: str, out: str) -> DataFrame:
        """``rows`` with a boolean: whether the level lets the key through."""
        shard = _shard(F.col(key), self.shards).cast("int")
        if self.literal is not None:
            return rows.withColumn(out, _hit(F.get(self.literal, shard), F.col(key), self.number))
        salted = self.bitmaps.select(F.col("shard").alias("__shard"), F.col("bitmap").alias("__bitmap"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
        named = rows.withColumn("__at", shard).withColumn("__turn", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        joined = named.join(salted, (F.col("__at") == F.col("__shard")) & (F.col("__turn") == F.col("__salt")), "left")
        return joined.withColumn(out, _hit(F.col("__bitmap"), F.col(key), self.number)).drop("__at", "__turn", "__shard", "__salt", "__bitmap")


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def judge(self, rows: DataFrame, key: str, out: str = "listed") -> DataFrame:
        """``rows`` with a boolean ``out``, in the place of a column of that name: whether the key is listed. Exact for every key of the
        universe; a null key isn't listed. Columns that begin with two underscores are taken for the work."""
        kept = [c for c in rows.columns if c != out]
        rows, listed = rows.withColumn("__key", F.col(key)), F.lit(False)
        for level in self.levels:
            rows = level.marked(rows, "__key", f"__level{level.number}")
        for level in reversed(self.levels):
            listed = F.col(f"__level{level.number}") & ~listed
        return rows.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(listed, F.lit(False)).alias(out))


def build(universe: DataFrame) -> Cascade:
    """Cascade over ``universe`` (key string, listed boolean).

    Repeated keys count once and are listed if any of their rows is; null keys are left out. An empty universe, and one without
    listed keys, give a cascade that lists nothing.
    """
    keys = saved(universe.where("key is not null").groupBy("key").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed")))
    members, testers, levels = keys.where("listed"), keys.where("not listed"), []
    while True:
        shards = max(1, math.ceil(members.count() / KEYS_PER_SHARD))
        bits = members.select(_shard(F.col("key"), shards).alias("shard"), F.explode(_positions(F.col("key"), len(levels) + 1)).alias("at"))
        level = Level(saved(bits.groupBy("shard").agg(F.bitmap_construct_agg("at").alias("bitmap"))), shards, len(levels) + 1)
        levels.append(level)
        through = saved(level.marked(testers, "key", "__through").where("__through").drop("__through"))
        if through.isEmpty():
            return Cascade(levels)
        members, testers = through, members


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``pages`` (page_id, url, ...) → page_id, host, path, rule, verdict.

    The keys are host and path of all pages; those whose longest fitting rule blocks are listed. The cascade gives every row's
    verdict; a url that no rule fits isn't listed, so it is allowed. A null url, and one without ``://``, has host and path ''; urls
    of any length are read whole. Rows with one url, or one id, are judged one by one. Other columns don't matter, whatever their
    names. An empty table gives no rows.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).fillna("", ["host", "path"])
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.select("*", rule.alias("rule"), F.concat("host", "path").alias("key"))
    cascade = build(parsed.select(F.concat("host", "path").alias("key"), (F.coalesce(action, F.lit("allow")) == "block").alias("listed")))
    return cascade.judge(judged, "key").select("page_id", "host", "path", "rule", F.when(F.col("listed"), "block").otherwise("allow").alias("verdict"))
