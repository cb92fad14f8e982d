"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters of the vocabulary.

The vocabulary is a table, counted by Spark. Its words of one length make a shard of blocked Bloom filters: every word sets BITS
bits of one block of 512. Shards are built in pieces by Spark and handed to the tasks in rounds of at most ROUND_BYTES, so what is
broadcast has a bound at any vocabulary; a shard over the bound is cut into several rounds by its blocks. Each word's deletions are
probed in the shard of the length below, its replacements in its own; an insertion is the other word's deletion. Only edits
that a filter knows leave the task; an exact join with the vocabulary removes the false positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import ascii_lower, mixed, parts, release, saved

#: A run of letters; after lower-casing A-Z its letters are these.
RUN = "([A-Za-zÀ-ÿ]+)"
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint64)
#: Bits that a word sets in its block, bits of a shard for each of its words, bits of a block, blocks of a piece.
BITS, BITS_A_WORD, BLOCK_BITS, PIECE = 7, 12, 512, 4096
#: Bytes of all filters that are broadcast in a round; words that a task probes, about; letters that are probed at once.
ROUND_BYTES, TASK_WORDS, STEP = 32 << 20, 20_000, 1 << 16
_BASE = 0x9E3779B97F4A7C15
_UNBASE = np.uint64(pow(_BASE, -1, 1 << 64))


def words_of(docs: DataFrame, every: int = 97) -> DataFrame:
    """(word): one row for each run of letters, A-Z lower-cased; where ``every`` divides the crc32 of id and run, one letter is missing."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(key.alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(1))).alias("run")).select("id", ascii_lower(F.col("run")).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    return hashed.select(F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of the words long and frequent enough; repeated words are added up before the shuffle."""
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


@dataclass
class Shard:
    """Blocks ``low`` to ``high`` of the ``blocks`` of a length's filter."""

    blocks: int
    low: int
    high: int
    bits: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Places in ``hashes`` of those that may be in the vocabulary."""
        block = _block(hashes, self.blocks)
        places = np.flatnonzero((block >= self.low) & (block < self.high))
        block, marks = block[places] - self.low, mixed(hashes[places] + np.uint64(1))
        for k in range(BITS):
            bit = (marks >> np.uint64(9 * k)) & np.uint64(BLOCK_BITS - 1)
            known = (self.bits[block * (BLOCK_BITS // 64) + (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            places, block, marks = places[known], block[known], marks[known]
        return places


def _block(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def bitmap(hashes: np.ndarray, blocks: int, low: int) -> np.ndarray:
    """Bits of one piece of a filter of ``blocks``, which begins with block ``low``."""
    out = np.zeros((min(PIECE, blocks - low), BLOCK_BITS // 64), np.uint64)
    block, marks = _block(hashes, blocks) - low, mixed(hashes + np.uint64(1))
    for k in range(BITS):
        bit = (marks >> np.uint64(9 * k)) & np.uint64(BLOCK_BITS - 1)
        np.bitwise_or.at(out, (block, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _powers(length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(length - 1, _BASE, np.uint64)]))


def _letters(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def hash_of(letters: np.ndarray) -> np.ndarray:
    """A polynomial in the letters, so that an edit's hash follows from the word's, and mixed."""
    with np.errstate(over="ignore"):
        return mixed(((letters.astype(np.uint64) + np.uint64(1)) * _powers(letters.shape[1])).sum(1, dtype=np.uint64))


def known_edits(words: list[str], own: Shard | None, shorter: Shard | None) -> Iterator[tuple[int, str]]:
    """(place in ``words``, edit) for the edits of words of one length that a filter knows.

    Edits are deletions and replacements by a larger letter, each string once: deleting any letter of a run of equal letters gives the same.
    """
    letters = _letters(words)
    size, length = letters.shape
    with np.errstate(over="ignore"):
        c, power = letters.astype(np.uint64) + np.uint64(1), _powers(length)
        before = np.zeros((size, length + 1), np.uint64)
        np.cumsum(c * power, axis=1, out=before[:, 1:])
        whole = before[:, -1:]
        if shorter:
            first = np.ones(letters.shape, bool)
            first[:, 1:] = letters[:, 1:] != letters[:, :-1]
            row, at = np.nonzero(first)
            hashes = mixed(before[row, at] + (whole[row, 0] - before[row, at + 1]) * _UNBASE)
            for p in shorter.has(hashes):
                yield int(row[p]), words[row[p]][: at[p]] + words[row[p]][at[p] + 1 :]
        for letter in LETTERS if own else ():
            row, at = np.nonzero(letters < letter)
            hashes = mixed(whole[row, 0] + (letter + np.uint64(1) - c[row, at]) * power[at])
            for p in own.has(hashes):
                yield int(row[p]), words[row[p]][: at[p]] + chr(int(letter)) + words[row[p]][at[p] + 1 :]


def _by_length(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The words of a batch by length, in steps whose letters fit in memory many times over."""
    b = b.reset_index(drop=True)
    for length, rows in b.groupby(b["word"].str.len()):
        step = max(1, STEP // int(length))
        for at in range(0, len(rows), step):
            yield rows.iloc[at : at + step]


def _hashes(words: DataFrame) -> DataFrame:
    """(length, h) of the vocabulary."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts(batches):
            for rows in _by_length(b):
                letters = _letters(rows["word"].tolist())
                yield pd.DataFrame({"length": np.int32(letters.shape[1]), "h": hash_of(letters).view(np.int64)})

    return words.select("word").mapInPandas(each, "length int, h long")


def _pieces(words: DataFrame, blocks: Column) -> DataFrame:
    """(length, blocks, piece, bits): the filters in pieces, each built in one group of about PIECE * BLOCK_BITS / BITS_A_WORD hashes."""
    counts = words.groupBy(F.char_length("word").alias("length")).agg(blocks.alias("blocks"))
    high = F.shiftrightunsigned("h", 32)
    dealt = _hashes(words).join(F.broadcast(counts), "length").withColumn("piece", F.floor(F.shiftrightunsigned(high * F.col("blocks"), 32) / PIECE).cast("int"))

    def each(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        length, of, piece = (int(k) for k in key)
        return pd.DataFrame({"length": [length], "blocks": [of], "piece": [piece], "bits": [bitmap(group["h"].to_numpy().view(np.uint64), of, piece * PIECE).tobytes()]})

    return dealt.groupBy("length", "blocks", "piece").applyInPandas(each, "length int, blocks long, piece int, bits binary")


def candidates(words: DataFrame) -> DataFrame:
    """(word, n, edit) of ``words`` (word, n; saved): all edits that are in the vocabulary, and a few that aren't."""
    spark = words.sparkSession
    pieces = saved(_pieces(words, F.greatest(F.lit(1), F.ceil(F.count("*") * BITS_A_WORD / BLOCK_BITS))))
    ids = [(r.length, r.piece, r.size) for r in pieces.select("length", "piece", F.length("bits").alias("size")).sort("length", "piece").toLocalIterator()]
    rounds: list[list[tuple[int, int]]] = []
    room = 0
    for length, piece, size in ids:
        if size > room:
            rounds.append([])
            room = max(ROUND_BYTES, size)
        rounds[-1].append((length, piece))
        room -= size
    tasks = max(spark.sparkContext.defaultParallelism, words.count() // TASK_WORDS)
    dealt = words.repartition(tasks, "word")
    found = None
    for ends in rounds:
        one = saved(_probed(dealt, pieces, ends[0], ends[-1]))
        found = one if found is None else found.unionByName(one)
    return found if found is not None else words.select("word", "n", F.col("word").alias("edit"))


def _probed(words: DataFrame, pieces: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """The candidates of one round: the filters from the piece ``first`` to ``last``, in order of length and piece."""
    place, ends = F.struct("length", "piece"), [F.struct(F.lit(length), F.lit(piece)) for length, piece in (first, last)]
    asked = pieces.where(place.between(*ends)).collect()  # ROUND_BYTES at most
    shards = {}
    for length in {r.length for r in asked}:
        own = sorted((r for r in asked if r.length == length), key=lambda r: r.piece)
        low, bits = own[0].piece * PIECE, np.frombuffer(b"".join(r.bits for r in own), np.uint64)
        shards[length] = Shard(own[0].blocks, low, low + len(bits) * 64 // BLOCK_BITS, bits)
    told = words.sparkSession.sparkContext.broadcast(shards)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rows in _by_length(b):
                texts, n = rows["word"].tolist(), rows["n"].tolist()
                found = list(known_edits(texts, told.value.get(len(texts[0])), told.value.get(len(texts[0]) - 1)))
                yield pd.DataFrame({"word": [texts[i] for i, _ in found], "n": [n[i] for i, _ in found], "edit": [edit for _, edit in found]}, dtype=object)
        release()

    return words.mapInPandas(each, "word string, n long, edit string")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): both directions of each pair of ``words`` (word, n; saved) that are one edit apart."""
    known = words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    pairs = candidates(words).where("word <> edit").join(known, "edit")
    both = F.array(F.struct("word", F.col("edit").alias("near"), F.col("edit_n").alias("near_n")), F.struct(F.col("edit").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.explode(both).alias("pair")).select("pair.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form; saved): where following the forms ends.

    Counts double with each step, so no path is longer than 63; each round doubles the steps taken. Words whose pointer has reached an
    end leave the rounds, so a popular end draws no rows to one task.
    """
    ends = F.broadcast if forms.count() <= 1_000_000 else lambda df: df
    going = forms.select(F.col("word").alias("form")).withColumn("last", F.lit(False))
    steps = saved(forms.join(ends(going), "form", "left").select("word", F.col("form").alias("root"), F.coalesce("last", F.lit(True)).alias("last")))
    while not steps.where("not last").isEmpty():
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("last").alias("next_last"))
        moved = steps.where("not last").join(ends(further), "root").select("word", F.col("next").alias("root"), F.col("next_last").alias("last"))
        steps = saved(steps.where("last").unionByName(moved))
    return steps.drop("last")


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``docs`` (doc_id, text, ...) → word, form, root, n, n_near, form_n: one row for each word of the vocabulary.

    A word is a run of letters (A-Z, a-z and U+00C0 to U+00FF), A-Z lower-cased, of ``least_length`` letters and with ``least_count``
    occurrences in all texts; where 97 divides the crc32 of ``doc_id:run`` one letter is taken out before it is counted. Words are
    near if one inserted, deleted or replaced letter makes one of the other. The form is the near word with the largest n (ties: the smallest by code points)
    if that is twice the word's own or more, else null; root follows forms to the last. Null and empty texts have no words; a null id counts as the empty
    text; repeated rows count each time. Words of any length take part, other columns don't. An empty table gives no rows.
    """
    words = saved(vocabulary(words_of(docs), least_length, least_count))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    told = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best")).alias("best"))
    told = saved(told.select("word", F.col("best.near").alias("form"), "n", "n_near", (-F.col("best.less")).alias("form_n")))
    ends = roots(told.where("form is not null").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
