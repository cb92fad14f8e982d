"""Totals, balances and statement lines checked against their parts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.session import dealt_out

TOLERANCE = 0.01


def matches(a: Column, b: Column, tol: float = TOLERANCE) -> Column:
    """Whether two amounts differ by at most ``tol``; null where either is."""
    return F.abs(a - b) <= tol + 1e-9


def check_totals(parts: DataFrame, stated: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """``stated`` (record_id, section, total) with computed, the sum of ``parts`` (record_id, section, amount), and ok."""
    sums = parts.groupBy("record_id", "section").agg(F.sum("amount").alias("computed"))
    joined = stated.join(sums, ["record_id", "section"], "left").withColumn("computed", F.coalesce("computed", F.lit(0.0)))
    return joined.withColumn("ok", matches(F.col("total"), F.col("computed"), tol))


def net_worth(assets: Column, liabilities: Column) -> Column:
    return assets - liabilities


def ownership_total(owners: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """(business_id, total, complete): whether a business's shares (percentage) add up to 100."""
    return owners.groupBy("business_id").agg(F.sum("percentage").alias("total")).withColumn("complete", matches(F.col("total"), F.lit(100.0), tol))


def missing_ownership(businesses: DataFrame, owners: DataFrame) -> DataFrame:
    """The ``businesses`` (business_id) without an owner."""
    return businesses.join(owners.where("percentage is not null").select("business_id"), "business_id", "left_anti")


def check_ledger(transactions: DataFrame, opening: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """``transactions`` (account, date, seq, deposit, withdrawal, balance) with running, the balance from ``opening`` (account, opening) on, and ok, whether the stated step fits."""
    order = Window.partitionBy("account").orderBy("date", "seq")
    step = F.coalesce("deposit", F.lit(0.0)) - F.coalesce("withdrawal", F.lit(0.0))
    rows = transactions.join(opening, "account").withColumn("running", F.col("opening") + F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.coalesce(F.lag("balance").over(order), F.col("opening"))
    return rows.withColumn("ok", matches(F.col("balance") - before, step, tol))


def statement_balance(transactions: DataFrame, opening: DataFrame) -> DataFrame:
    """(account, ending): opening plus deposits less withdrawals."""
    sums = transactions.groupBy("account").agg(F.sum(F.coalesce("deposit", F.lit(0.0)) - F.coalesce("withdrawal", F.lit(0.0))).alias("net"))
    return opening.join(sums, "account", "left").select("account", (F.col("opening") + F.coalesce("net", F.lit(0.0))).alias("ending"))


#: Days of a bucket, by which transactions meet the periods of their account.
BUCKET = 31


def _bucket(date: Column) -> Column:
    return F.floor(F.unix_date(date.cast("date")) / BUCKET)


def period_gaps(periods: DataFrame) -> DataFrame:
    """``periods`` (account, period, first_day, last_day, ...) with gap and overlap: the days between a period and all earlier ones of its account that no
    period covers, and those that it shares with an earlier one; both null for the first.

    Periods of an account come in the order of first_day, last_day and period. One without a first or last day, or that ends before it begins, is not
    ``valid``; it has neither, and the others are judged as if it weren't there.
    """
    valid = F.coalesce(F.col("first_day") <= F.col("last_day"), F.lit(False))
    order = Window.partitionBy("account", "valid").orderBy("first_day", "last_day", "period")
    before = F.when(F.col("valid"), F.max("last_day").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    space = F.date_diff(F.col("first_day"), F.col("_before")) - 1
    shared = F.date_diff(F.least("last_day", "_before"), F.col("first_day")) + 1
    marked = periods.withColumn("valid", valid).withColumn("_before", before)
    counted = lambda days: F.when(F.col("_before").isNotNull(), F.greatest(days, F.lit(0)))
    return marked.withColumn("gap", counted(space)).withColumn("overlap", counted(shared)).drop("_before")


def in_periods(transactions: DataFrame, periods: DataFrame) -> DataFrame:
    """``transactions`` (account, date, ...) with period: a row for each period of their account that holds their date, or one with null.

    Periods are listed under each bucket of BUCKET days that they touch, so an account's transactions meet the few periods of their bucket by
    equality, and no account's history meets in one task.
    """
    spans = periods.where("first_day <= last_day").select("account", "period", "first_day", "last_day", F.explode(F.sequence(_bucket(F.col("first_day")), _bucket(F.col("last_day")))).alias("_bucket"))
    day = F.col("date").cast("date")
    met = transactions.withColumn("_bucket", _bucket(F.col("date"))).alias("t").join(spans.alias("p"), (F.col("t.account") == F.col("p.account")) & (F.col("t._bucket") == F.col("p._bucket")) & day.between(F.col("p.first_day"), F.col("p.last_day")), "left")
    return met.select(*[F.col(f"t.`{c}`") for c in transactions.columns], F.col("p.period").alias("period"))


def check_periods(transactions: DataFrame, periods: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """One row for each of ``periods`` (account, period, first_day, last_day, beginning, ending), with what its transactions make of it.

    start is the beginning balance: what the statement says, or else what the period before ended with: its stated ending, or else its
    own start and transactions, and so on back to a balance that is stated; null if there is none. deposits and withdrawals are summed over the period's
    transactions (account, date, deposit, withdrawal); computed is start plus deposits less withdrawals; ok tells whether the stated ending
    fits it, carried whether a stated beginning fits what the period before ended with, each null where there is nothing to compare. gap and overlap are those of
    period_gaps(); a period that isn't valid has no transactions and carries nothing on.
    """
    sums = in_periods(transactions, periods).where("period is not null").groupBy("account", "period")
    sums = sums.agg(F.sum(F.coalesce("deposit", F.lit(0))).cast("double").alias("deposits"), F.sum(F.coalesce("withdrawal", F.lit(0))).cast("double").alias("withdrawals"), F.count("*").alias("transactions"))
    rows = period_gaps(periods).join(sums, ["account", "period"], "left").fillna(0, ["deposits", "withdrawals", "transactions"])
    order = Window.partitionBy("account", "valid").orderBy("first_day", "last_day", "period")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    net = F.col("deposits") - F.col("withdrawals")
    rows = rows.withColumn("_moved", F.coalesce(F.sum(net).over(so_far), F.lit(0.0)))
    known = F.when(F.col("valid"), F.coalesce("beginning", F.lag("ending").over(order)))
    # a known balance less what was moved before it is the same for all periods up to the next known one
    rows = rows.withColumn("_base", F.last(known - F.col("_moved"), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("start", F.when(F.col("valid"), F.coalesce("beginning", F.col("_base") + F.col("_moved")))).withColumn("computed", F.col("start") + net)
    ended = F.when(F.col("valid"), F.lag(F.coalesce("ending", "computed")).over(order))
    rows = rows.withColumn("ok", matches(F.col("ending"), F.col("computed"), tol)).withColumn("carried", matches(F.col("beginning"), ended, tol))
    return rows.select("account", "period", "valid", "gap", "overlap", "transactions", "start", "deposits", "withdrawals", "computed", "ok", "carried")


#: Rules of a catalog of forms, at most: they stand as a literal in the expression.
RULES = 10_000
#: Lines of records that a task sums up.
LINES = 250_000


def rule_order(rules: DataFrame) -> list[tuple[str, str, list[tuple[str, float]]]]:
    """(form, target, [(source, sign)]) of ``rules`` (form, target, source, sign; a catalog), each target after the targets that it depends on."""
    rows = rules.select("form", "target", "source", "sign").limit(RULES + 1).collect()
    if len(rows) > RULES:
        raise ValueError(f"more than {RULES} rules are no catalog")
    waiting: dict[tuple[str, str], list[tuple[str, float]]] = {}
    for r in sorted(rows):
        waiting.setdefault((r.form, r.target), []).append((r.source, float(r.sign)))
    out: list[tuple[str, str, list[tuple[str, float]]]] = []
    while waiting:
        ready = [k for k, sources in waiting.items() if not any((k[0], source) in waiting for source, _ in sources)]
        if not ready:
            raise ValueError(f"rules depend on each other: {sorted(waiting)}")
        out += [(*k, waiting.pop(k)) for k in ready]
    return out


def computed_lines(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """(record_id, form, target, stated, computed): every line of a record's form that has a rule, what the record states for it (null if
    nothing) and the signed sum of its sources.

    A source counts what is stated; one that isn't stated and has a rule counts its own computed value, whatever the depth; any other
    counts 0. ``lines`` has record_id, form, line, value: a null value is none, repeated lines add up. Rules that depend on
    each other in a circle are an error. One aggregate puts a record's lines in a map; the rules are one expression over it, in the order of dependency.
    Records are dealt once, LINES lines to a task, and both aggregates keep to that.
    """
    there = lines.where("value is not null and line is not null").select("record_id", "form", "line", "value")
    sums = dealt_out(there, LINES, "record_id").groupBy("record_id", "form", "line").agg(F.sum("value").cast("double").alias("value"))
    maps = sums.groupBy("record_id", "form").agg(F.map_from_entries(F.collect_list(F.struct("line", "value"))).alias("stated"))
    kind = "array<struct<form: string, target: string, sources: array<struct<source: string, sign: double>>>>"
    order = F.from_json(F.lit(json.dumps([{"form": f, "target": t, "sources": [{"source": s, "sign": g} for s, g in sources]} for f, t, sources in rule_order(rules)])), kind)

    def step(known: Column, rule: Column) -> Column:
        value = lambda s: s["sign"] * F.coalesce(F.element_at(known["stated"], s["source"]), F.element_at(known["computed"], s["source"]), F.lit(0.0))
        total = F.aggregate(rule["sources"], F.lit(0.0), lambda t, s: t + value(s))
        return F.struct(known["stated"].alias("stated"), F.map_concat(known["computed"], F.create_map(rule["target"], total)).alias("computed"))

    start = F.struct(F.col("stated"), F.create_map().cast("map<string,double>").alias("computed"))
    known = F.aggregate(F.filter(order, lambda r: r["form"] == F.col("form")), start, step, lambda k: k["computed"])
    told = maps.select("record_id", "form", "stated", F.explode(known).alias("target", "computed"))
    return told.select("record_id", "form", "target", F.element_at("stated", F.col("target")).alias("stated"), "computed")


def check_lines(lines: DataFrame, rules: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """(record_id, form, target, stated, computed, ok): each stated target line of ``lines`` against the signed sum of its sources, as in computed_lines()."""
    return computed_lines(lines, rules).where("stated is not null").withColumn("ok", matches(F.col("stated"), F.col("computed"), tol))


def debt_summary(debts: DataFrame) -> DataFrame:
    """(applicant, creditor, debts, original, current, monthly, average_rate), with a total for each applicant (creditor null) and for all."""
    return debts.rollup("applicant", "creditor").agg(
        F.count("*").alias("debts"), F.sum("original_amount").alias("original"), F.sum("current_balance").alias("current"), F.sum("monthly_payment").alias("monthly"), F.avg("interest_rate").alias("average_rate"),
    )


def debt_to_income(debts: DataFrame, incomes: DataFrame) -> DataFrame:
    """(applicant, ratio): twelve monthly payments by annual income; null without one."""
    paid = debts.groupBy("applicant").agg(F.sum("monthly_payment").alias("monthly"))
    return paid.join(incomes, "applicant", "left").select("applicant", (12 * F.col("monthly") / F.nullif("annual_income", F.lit(0))).alias("ratio"))
