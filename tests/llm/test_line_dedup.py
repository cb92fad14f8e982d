"""Shared lines beside brute force, on the given table and on messy rows."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import line_dedup
from ledgerleaf.llm.common import LOWER, UPPER, table

LOW = str.maketrans(UPPER, LOWER)


def expected(rows, least_length=40, least_documents=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_length:
                holders[key(line)].add(i)
    keeper = {k: max(i for i in ids if i is not None) for k, ids in holders.items() if len(ids) >= least_documents}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if keeper.get(key(line), i) == i]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def found(docs, **how):
    return sorted((str(r.doc_id), r["__n_lines"], r["__n_dropped"], r["__kept"]) for r in line_dedup.deduplicate(docs, **how).collect())


def test_documents(spark, data):
    docs = table(spark, data, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(docs) == expected(rows) and any(r[2] for r in expected(rows))
    assert found(docs, least_length=10, least_documents=2) == expected(rows, 10, 2)


@pytest.mark.parametrize("heavy", [256, 1])
def test_messy_rows(spark, monkeypatch, heavy):
    """Null and empty texts, repeated ids and rows, rows without an id, a key at the edge of each limit, both ways of the join."""
    monkeypatch.setattr(line_dedup, "HEAVY_LINES", heavy)
    monkeypatch.setattr(line_dedup, "HEAVY_PART", 1 << 20 if heavy == 1 else 4096)
    a, b, short = "Ä" + "a" * 39, "B" * 45, "c" * 39
    rows = [(i, f"{a}\n\n  {b} \r\n{short}\n{i}") for i in range(6)] + [(None, a.upper().replace("Ä", "Ä")), (None, a), (None, a), (7, None), (8, ""), (9, "\n"), (3, f"\x0c{b.lower()}"), (3, f"\x0c{b.lower()}"), (5, f"q\n{a}\nx"), (5, "z" * 50), (11, "z" * 50)]
    rows += [(20 + i, "long " * 30_000 + f"\n{b}\n" * 3) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("pos", "line", "lines", "key", "h1", "h2", "keeper")])
    assert found(df) == expected(rows)
    assert line_dedup.deduplicate(df).columns == [*df.columns, "__n_lines", "__n_dropped", "__kept"]
    assert found(df.limit(0)) == []


def test_many_lines_in_linear_time(spark):
    text = "\n".join(f"this line of forty code points or more has number {i}" for i in range(50_000))
    df = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")
    rows = line_dedup.deduplicate(df).select("doc_id", "__n_dropped", F.sha2(F.col("__kept").cast("binary"), 256).alias("sha")).collect()
    whole, nothing = (hashlib.sha256(t.encode()).hexdigest() for t in (text, ""))
    assert {(r.doc_id, r["__n_dropped"], r.sha) for r in rows} == {(i, 50_000, nothing) for i in range(5)} | {(5, 0, whole)}


def test_native_plan(spark, data):
    plan = line_dedup.deduplicate(table(spark, data, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
