"""Spelling variants beside brute force, filters in one round and in many, chains of forms, messy rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import spelling
from ledgerleaf.llm.common import LOWER, UPPER, table

LOW = str.maketrans(UPPER, LOWER)


def expected(rows, least_length=5, least_count=3):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_length and c >= least_count}
    letters = [chr(c) for c in [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]]
    form, near_count = {}, {}
    for w in n:
        near = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + x + w[i + k :] for i in range(len(w) + 1) for x in letters for k in (0, 1)}
        near = {u for u in near if u in n and u != w}
        near_count[w] = len(near)
        best = min(near, key=lambda u: (-n[u], u), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    root = {}
    for w in n:
        root[w] = w
        while form[root[w]] is not None:
            root[w] = form[root[w]]
    return sorted((w, str(form[w]), root[w], n[w], near_count[w], str(n.get(form[w]))) for w in n)


def found(docs, **how):
    return sorted((r.word, str(r.form), r.root, r.n, r.n_near, str(r.form_n)) for r in spelling.variants(docs, **how).collect())


def made(count, seed):
    """Rows of words near each other: few letters, lengths from 3 to 9, counts from 1 to hundreds."""
    dice = random.Random(seed)
    words = ["".join(dice.choice("abÿ×") for _ in range(dice.randrange(3, 8))) for _ in range(count)]
    return [(None if i == 7 else i % 40, " ".join(dice.choices(words, [2.0 ** -(k % 11) for k in range(count)], k=400)).replace("ab", "AB", 3)) for i in range(60)]


@pytest.mark.parametrize("size", [32 << 20, 1])
def test_variants(spark, monkeypatch, size):
    """All filters in one broadcast, and each piece in a round of its own."""
    monkeypatch.setattr(spelling, "ROUND_BYTES", size)
    monkeypatch.setattr(spelling, "PIECE", 4096 if size > 1 else 4)
    rows = made(300, 1)
    told = expected(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == told and len(told) > 100 and any(r[1] != "None" for r in told)


def test_messy_rows(spark):
    rows = [(1, None), (2, ""), (3, "1234 ,.; \n"), (None, "gräßlich GRÄßLICH gräßlich"), (4, "x" * 3000 + " " + "x" * 3001), (5, "x" * 3000), (5, "x" * 3000), (5, "x" * 3001), (6, "x" * 3001), (7, "naïve naive ﬁre naïve naïve naive naive naïve 漢字漢字漢字")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("word", "n", "run", "id", "h", "edit", "near")])
    assert found(df) == expected(rows) and found(df.limit(0)) == []
    assert found(df, least_length=1, least_count=1) == expected(rows, 1, 1)


def test_chain_of_forms(spark):
    """Each word has less than half the count of the next: many steps to one root."""
    words = ["a" * (5 + k) for k in range(8)]
    rows = [(i, " ".join(w for k, w in enumerate(words) if i < 4 * 2.4**k)) for i in range(2000)]
    told = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert told == expected(rows) and sum(r[2] == words[-1] for r in told) >= 5


def test_filters_lose_nothing():
    dice = np.random.default_rng(0)
    hashes = spelling.mixed(dice.integers(0, 1 << 63, 40_000).astype(np.uint64))
    blocks = -(-len(hashes) * spelling.BITS_A_WORD // spelling.BLOCK_BITS)
    shard = spelling.Shard(blocks, 0, blocks, spelling.bitmap(hashes, blocks, 0).ravel())
    assert len(shard.has(hashes)) == len(hashes)
    others = spelling.mixed(dice.integers(0, 1 << 63, 100_000).astype(np.uint64))
    assert len(shard.has(others)) < 1500


def test_edits_have_the_hash_of_their_text():
    words = ["abcab", "aabbz", "ÿÿÿÿÿ"]
    every = {w[:i] + w[i + 1 :] for w in words for i in range(5)} | {w[:i] + chr(int(x)) + w[i + 1 :] for w in words for i in range(5) for x in spelling.LETTERS if chr(int(x)) > w[i]}
    shards = []
    for length in (5, 4):
        texts = sorted(e for e in every if len(e) == length)
        hashes = spelling.hash_of(spelling._letters(texts))
        shards.append(spelling.Shard(64, 0, 64, spelling.bitmap(hashes, 64, 0).ravel()))
    told = [e for _, e in spelling.known_edits(words, *shards)]
    assert set(told) == every and len(told) == sum(len({w[:i] + w[i + 1 :] for i in range(5)}) + sum(int((spelling.LETTERS > ord(x)).sum()) for x in w) for w in words)


def test_documents(spark, data):
    docs = table(spark, data, "documents")
    assert found(docs) == expected([(r.doc_id, r.text) for r in docs.collect()])
