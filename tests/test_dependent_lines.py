"""Lines computed from computed lines."""

from __future__ import annotations

import pytest

from ledgerleaf.operators import reconcile
from ledgerleaf.plans import catalog

LINES = "record_id int, form string, line string, value double"


def test_source_that_is_not_stated(spark):
    rows = [
        (1, "form_1120", "1a", 10.0), (1, "form_1120", "2", 3.0), (1, "form_1120", "3", 7.0),  # 1c isn't stated
        (2, "form_1120", "1a", 10.0), (2, "form_1120", "1c", None), (2, "form_1120", "30", 4.0), (2, "form_1120", "12", 5.0), (2, "form_1120", "12", 1.0),
        (3, "form_1120", "1a", 10.0), (3, "form_1120", "1c", 20.0), (3, "form_1120", "3", 20.0), (4, "no such form", "3", 1.0), (5, "form_1120", None, 1.0),
    ]
    df = spark.createDataFrame(rows, LINES)
    rules = catalog.line_rules(spark)
    found = {(r.record_id, r.target): (r.stated, r.computed, r.ok) for r in reconcile.check_lines(df, rules).collect()}
    assert found == {(1, "3"): (7.0, 7.0, True), (2, "30"): (4.0, 4.0, True), (3, "1c"): (20.0, 10.0, False), (3, "3"): (20.0, 20.0, True)}
    every = {(r.record_id, r.target): r.computed for r in reconcile.computed_lines(df, rules).collect()}
    assert every[2, "11"] == 10.0 and every[2, "27"] == 6.0 and every[1, "30"] == 7.0 and len(every) == 15
    assert reconcile.check_lines(df.limit(0), rules).collect() == []


def test_deep_chains_and_circles(spark):
    schema = "form string, target string, source string, sign int"
    chain = [("f", f"l{n}", f"l{n - 1}", 1 if n % 2 else -1) for n in range(1, 40)]
    df = spark.createDataFrame([(1, "f", "l0", 5.0), (1, "f", "l39", 5.0), (2, "f", "l0", 5.0), (2, "f", "l20", 1.0), (2, "f", "l39", -1.0)], LINES)
    found = {(r.record_id, r.target): (r.computed, r.ok) for r in reconcile.check_lines(df, spark.createDataFrame(chain[::-1], schema)).collect()}
    assert found == {(1, "l39"): (-5.0, False), (2, "l20"): (5.0, False), (2, "l39"): (-1.0, True)}
    with pytest.raises(ValueError, match="depend on each other"):
        reconcile.check_lines(df, spark.createDataFrame([*chain, ("f", "l0", "l39", 1)], schema))


def test_tasks_do_not_grow_with_the_lines(spark, monkeypatch):
    """Twice the lines are twice the tasks, whatever AQE would put together."""
    rules = catalog.line_rules(spark)
    monkeypatch.setattr(reconcile, "LINES", 1000, raising=False)

    def parts(records):
        lines = spark.range(records * 2).selectExpr("cast(id div 2 as int) as record_id", "'form_1120' as form", "if(id % 2 = 0, '1a', '1c') as line", "1.0D as value")
        found = reconcile.computed_lines(lines, rules)
        assert found.where("target = '1c' and stated = 1 and computed = 1").count() == records
        return found.rdd.getNumPartitions()

    assert parts(5000) == 10
    assert parts(10000) == 20


def test_dealt_out_keeps_to_the_writer_that_holds_no_rows(spark):
    """A table of many times the rows of a task isn't dealt over more partitions than are written row by row."""
    from ledgerleaf.session import dealt_out

    assert dealt_out(spark.range(1000), 2, "id").rdd.getNumPartitions() == 200
    assert dealt_out(spark.range(1000), 100, "id").rdd.getNumPartitions() == 10
