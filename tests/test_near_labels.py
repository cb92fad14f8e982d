"""Labels a few edits from a hint, beside all pairs."""

from __future__ import annotations

import random

from ledgerleaf.operators import schema


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def expected(label, hints):
    if label is None:
        return None, None, None
    key, out = label.lower().strip(" "), []
    for field, listed in hints:
        for pos, hint in enumerate(listed):
            hint = hint.lower()
            d = edits(key, hint)
            if d <= (0 if len(hint) < 4 else 1 if len(hint) < 8 else 2):
                out.append((d, pos, field, hint))
    return (min(out)[2], min(out)[3], min(out)[0]) if out else (None, None, None)


def test_near_labels_by_all_pairs(spark):
    dice = random.Random(3)
    word = lambda: "".join(dice.choice("abc ") for _ in range(dice.randrange(1, 14))).strip() or "a"
    hints = [(f"f{n}", [word() for _ in range(6)]) for n in range(25)] + [("same", ["aaaaaaaaaa", "aaaa", "bbbbbbbb"]), ("odd", ["Straße Nr", "x" * 300, ""])]
    flat = [h for _, listed in hints for h in listed]

    def off(text, n):
        for _ in range(n):
            at = dice.randrange(len(text) + 1)
            text = text[:at] + dice.choice(["", "a", "z", "ß"]) + text[at + dice.randrange(2) :]
        return text

    labels = [off(dice.choice(flat), dice.randrange(4)) for _ in range(400)] + [None, "", " ", "AAAAAAAAAAA", "aaaaaaaaaaaa", "aaaaaaa", "straße nr", "strasse nr", "x" * 301, "x" * 303] + ["abca"] * 5
    df = spark.createDataFrame([(n, x, "other") for n, x in enumerate(labels)], "n int, label string, pos string")
    found = {r.n: (r.field, r.hint, r.distance) for r in schema.match_near_labels(df, spark.createDataFrame(hints, "field string, hints array<string>")).collect()}
    assert found == {n: expected(x, hints) for n, x in enumerate(labels)}
    assert sum(d == 2 for _, _, d in found.values()) > 20 and sum(d is None for _, _, d in found.values()) > 20
    assert schema.match_near_labels(df.limit(0), spark.createDataFrame(hints, "field string, hints array<string>")).count() == 0


def test_no_label_meets_all_hints(spark):
    """The index proposes a small part of all pairs."""
    dice = random.Random(4)
    hints = ["".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(500)]
    index = schema._index(spark.createDataFrame([(h,) for h in hints], "hint string"))
    labels = spark.createDataFrame([(h[:5] + "#" + h[6:],) for h in hints], "label string")
    from pyspark.sql import functions as F

    proposed = labels.select("label", F.explode(schema._grams(F.col("label"))).alias("piece")).join(index, "piece").select("label", "hint").distinct()
    assert 500 <= proposed.count() < 500 * 500 / 50
    plan = proposed._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
