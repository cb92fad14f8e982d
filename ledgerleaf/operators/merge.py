"""Ordered deep merge of batch results, and summaries of what was filled.

At the top level the first truthy value of a key wins, below it the last one. Keys that start with an underscore are left out at
the top. Objects merge key by key; lists are replaced. A falsy value enters only with the object that first brings its parent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.values import truthy_json
from ledgerleaf.session import dealt_out, saved


#: Levels of objects that are opened in one pass over the data.
AT_ONCE = 6
#: Batches whose objects a task opens, and whose members it sorts by path.
BATCHES = 100_000


def leaves_of(batches: DataFrame, key: str = "app_id", order: str = "batch_ord") -> DataFrame:
    """(``key``, ``order``, path, value): everything in the JSON objects in ``payload`` (VARIANT) that holds nothing more, at any depth; value is JSON text.

    An empty object is a leaf, a list is one. AT_ONCE levels are opened in one pass, each row going on as its members; only records that
    are deeper take another. A payload that is no object has no leaves. Batches are dealt over tasks by their number, so those of one
    application are opened by many.
    """
    spark = batches.sparkSession
    rows = dealt_out(batches.select(key, order, F.col("payload").alias("v")), BATCHES, key, order)
    rows = rows.select(key, order, F.array().cast("array<string>").alias("path"), "v").where(F.try_variant_get("v", "$", "map<string,variant>").isNotNull())
    done: list[DataFrame] = []
    while True:
        for _ in range(AT_ONCE):
            opened = spark.sql("SELECT d.*, t.k, t.m FROM {d} AS d LATERAL VIEW OUTER explode(try_variant_get(d.v, '$', 'map<string,variant>')) t AS k, m", d=rows)
            inner = F.col("k").isNotNull()
            rows = opened.select(key, order, F.when(inner, F.array_append("path", F.col("k"))).otherwise(F.col("path")).alias("path"), F.when(inner, F.col("m")).otherwise(F.col("v")).alias("v"))
        text = F.to_json("v")
        deep = F.startswith(text, F.lit("{")) & (text != "{}")
        rows = saved(rows.where(F.size("path") > 0).select(key, order, "path", F.when(~F.coalesce(deep, F.lit(False)), F.coalesce(text, F.lit("null"))).alias("value"), F.when(deep, F.col("v")).alias("v")))
        done.append(rows.where("value is not null").drop("v"))
        rows = rows.where("value is null").drop("value")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)


def _merged_paths(batches: DataFrame, key: str, order: str) -> DataFrame:
    """(``key``, paths): what each application's batches say of each path, in one aggregate by application and path.

    paths is an array of path; full, the first batch in which the path is an object with content; empty, the first in which it is an
    empty one; first and given, the first batch that has it and the value there; won, the value that truth decides: the first truthy one at the top, the last one below.
    """
    leaves = leaves_of(batches, key, order).where(~F.startswith(F.get("path", F.lit(0)), F.lit("_")))
    # each leaf says of the paths above it that they have content
    above = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.struct(F.slice("path", F.lit(1), n).alias("path"), F.when(n == F.size("path"), F.col("value")).alias("value")))
    rows = leaves.select(key, order, F.explode(above).alias("p")).select(key, order, "p.path", "p.value")
    truth, at = truthy_json(F.col("value")), F.col(order)
    top = F.size("path") == 1
    told = rows.groupBy(key, "path").agg(
        F.min(F.when(F.col("value").isNull(), at)).alias("full"), F.min(F.when(F.col("value") == "{}", at)).alias("empty"), F.min(at).alias("first"),
        F.min_by("value", F.when(F.col("value").isNotNull(), at)).alias("given"), F.min_by("value", F.when(truth, at)).alias("won_first"), F.max_by("value", F.when(truth, at)).alias("won_last"),
    )
    won = F.when(top, F.col("won_first")).otherwise(F.col("won_last")).alias("won")
    return told.groupBy(key).agg(F.collect_list(F.struct("path", "full", "empty", "first", "given", won)).alias("paths"))


def _conflict(paths: Column) -> Column:
    """Whether a path is an object with content in one batch and another truthy value in another, so that the order of batches decides its kind."""
    return F.exists(paths, lambda p: p["full"].isNotNull() & p["won"].isNotNull())


def _set_based(merged: DataFrame, key: str) -> DataFrame:
    """(``key``, path, value): the merged record of each application without conflicts: its leaves, and objects as ``{}``.

    An object that comes with content is placed whole, falsy members and all; one that was placed empty (in the batch that placed its
    parent whole, or at the top as the first value) takes truthy members only.
    """
    objects = F.map_from_entries(F.transform(F.filter("paths", lambda p: p["full"].isNotNull()), lambda p: F.struct(p["path"], F.struct(p["full"], p["empty"], p["first"]))))
    rows = merged.select(key, objects.alias("objects"), F.explode("paths").alias("p"))

    def from_top(known: Column, n: Column) -> Column:
        """``known``: whether the object above was placed empty, and the batch of its first content."""
        own = F.element_at("objects", F.slice("p.path", F.lit(1), n))
        bare = F.when(n == 1, own["empty"] == own["first"]).otherwise(~known["bare"] & (own["empty"] == known["full"]))
        return F.struct((F.coalesce(bare, F.lit(False)) & (own["empty"] < own["full"])).alias("bare"), own["full"].alias("full"))

    depth = F.size("p.path")
    start = F.struct(F.lit(False).alias("bare"), F.lit(None).cast(merged.schema["paths"].dataType.elementType["full"].dataType).alias("full"))
    parent = F.aggregate(F.filter(F.sequence(F.lit(0), depth - 1), lambda n: n > 0), start, from_top)
    placed = F.when(depth == 1, F.col("p.given")).when(~F.col("parent.bare") & (F.col("p.first") == F.col("parent.full")), F.col("p.given"))
    value = F.when(F.col("p.full").isNotNull(), "{}").otherwise(F.coalesce("p.won", placed))
    return rows.withColumn("parent", parent).select(key, "p.path", value.alias("value")).where("value is not null")


def _merged(batches: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame | None]:
    """(paths and values of applications without conflicts, folded records of those with some, None if there are none)."""
    paths = saved(_merged_paths(batches, key, order))
    odd = paths.where(_conflict(F.col("paths"))).select(key)
    if odd.isEmpty():
        return _set_based(paths, key), None
    return _set_based(paths.where(~_conflict(F.col("paths"))), key), saved(fold_records(batches.join(odd, key, "left_semi"), key, order))


def deep_merge(batches: DataFrame, key: str = "app_id", order: str = "batch_ord") -> DataFrame:
    """(``key``, path, value): the leaves of each application's merged record, as JSON texts, but for empty objects and nulls in an object's place.

    One aggregate by application and path and one by application, however deep the records are. Applications in which the kind of a path
    depends on the order of its batches, and only those, are folded (fold_records).
    """
    values, folded_ = _merged(batches, key, order)
    out = values.where("value <> '{}'")
    if folded_ is None:
        return out
    again = leaves_of(folded_.select(key, F.lit(0).alias(order), F.parse_json("record").alias("payload")), key, order)
    return out.unionByName(again.where("value <> '{}'").select(key, "path", "value"))


def merge_records(batches: DataFrame, key: str = "app_id", order: str = "batch_ord") -> DataFrame:
    """(``key``, record): each application's merged record as one JSON text, keys in order, with all its empty objects and nulls.

    As deep_merge(); equal to the fold of all batches, whatever the kinds of their values. An application without any key has no record.
    """
    values, folded_ = _merged(batches, key, order)
    out = rebuilt(values, key)
    return out if folded_ is None else out.unionByName(folded_)


def rebuilt(leaves: DataFrame, key: str = "app_id") -> DataFrame:
    """(``key``, record): the leaves put together as one JSON text for each application, keys in order; an object without a leaf doesn't show."""
    rows = saved(leaves)
    for depth in range(rows.agg(F.max(F.size("path"))).first()[0] or 0, 0, -1):
        deep = F.size("path") == depth
        pair = F.concat(F.to_json(F.array(F.element_at("path", -1))), F.lit(":"), F.col("value"))
        text = F.regexp_replace(pair, r'^\[("(?:[^"\\]|\\.)*")\]:', "$1:")
        parts = F.collect_list(F.when(deep, text))
        whole = F.concat(F.lit("{"), F.array_join(F.sort_array(parts), ","), F.lit("}"))
        rows = rows.groupBy(key, F.when(deep, F.slice("path", 1, depth - 1)).otherwise(F.col("path")).alias("path")).agg(F.when(F.size(parts) > 0, whole).otherwise(F.first("value")).alias("value"))
    return rows.select(key, F.col("value").alias("record"))


def fold_into(old: dict, new: dict, top: bool = True) -> dict:
    """``old`` with ``new`` merged into it, whatever the kinds of their values."""
    for k, v in new.items():
        if top and k.startswith("_"):
            continue
        if isinstance(old.get(k), dict) and isinstance(v, dict):
            fold_into(old[k], v, False)
        elif (top and k not in old) or (v and not (top and old.get(k))):
            old[k] = v
    return old


def folded(records: list[dict]) -> dict:
    """The same merge of one application's records, one after another."""
    return reduce(fold_into, records, {})


def fold_records(batches: DataFrame, key: str = "app_id", order: str = "batch_ord") -> DataFrame:
    """(``key``, record): the merge as JSON text by a sequential fold, which conflicts need.

    The batches of an application are folded one after another as they pass in their order; a task holds one merged record at a time.
    """
    rows = batches.select(key, order, F.to_json("payload").alias("text")).where(F.startswith("text", F.lit("{")))
    schema = rows.select(key, F.col("text").alias("record")).schema

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out(done: list) -> pa.RecordBatch:
            texts = [json.dumps(r, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for _, r in done]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array(texts, pa.string())], [key, "record"])

        for b in parts:
            kind = b.column(key).type
            for k, text in zip(b.column(key).to_pylist(), b.column("text").to_pylist(), strict=True):
                if not held or held[-1][0] != k:
                    held.append((k, {}))
                fold_into(held[-1][1], json.loads(text))
            if len(held) > 1:
                yield out(held[:-1])
                held = held[-1:]
        if held:
            yield out(held)

    return rows.repartition(key).sortWithinPartitions(key, order).select(key, "text").mapInArrow(each, schema)


def fill_report(filled: DataFrame, key: str = "app_id") -> DataFrame:
    """(``key``, total, filled, fill_rate, checkboxes, texts) of fields (value text, boolean): filled values that look like boxes and others."""
    there = F.coalesce(F.col("value") != "", F.lit(False))
    box = there & (F.col("boolean") | F.col("value").isin("Yes", "No", "/Yes", "/No"))
    rate = F.count_if(there) / F.count("*") * 100
    return filled.groupBy(key).agg(F.count("*").alias("total"), F.count_if(there).alias("filled"), rate.alias("fill_rate"), F.count_if(box).alias("checkboxes"), F.count_if(there & ~box).alias("texts"))


def type_breakdown(fields: DataFrame, key: str = "form_id") -> DataFrame:
    """(``key``, text, checkbox, other) by field_type."""
    kind = F.when(F.col("field_type").isin("text", "checkbox"), F.col("field_type")).otherwise("other")
    return fields.withColumn("_k", kind).groupBy(key).pivot("_k", ["text", "checkbox", "other"]).count().fillna(0)


#: Fields that a report lists by category.
COVERAGE = {
    "Personal": ["Name", "Social Security Number", "Date of Birth", "Mobile Telephone Number", "Email address"],
    "Business": ["Business Applicant Name", "What percentage of the applicant business do/will you own?", "Do you have ownership in other entities aside from the Applicant Business?"],
    "Financial": ["total_assets", "total_liabilities", "net_worth"],
}


def category(field_name: Column) -> Column:
    return reduce(lambda c, kind: F.when(field_name.isin(*COVERAGE[kind]), kind).otherwise(c), COVERAGE, F.lit("Other"))


def coverage(filled: DataFrame, key: str = "app_id") -> DataFrame:
    """(``key``, category, listed, filled): for personal and business fields how many are listed and filled, for the rest the filled count; financial ones are not reported."""
    listed = F.create_map(*[x for kind in COVERAGE for x in (F.lit(kind), F.lit(len(COVERAGE[kind])))])
    there = F.coalesce(F.col("value") != "", F.lit(False))
    kinds = F.explode(F.array(F.lit("Personal"), F.lit("Business"), F.lit("Other")))
    found = filled.where(there).groupBy(key, category(F.col("field_name")).alias("category")).agg(F.count("*").alias("n"))
    every = filled.select(key).distinct().select(key, kinds.alias("category"))
    return every.join(found, [key, "category"], "left").select(key, "category", F.element_at(listed, F.col("category")).alias("listed"), F.coalesce("n", F.lit(0)).alias("filled"))


def application_summary(filled: DataFrame) -> DataFrame:
    """(app_id, form_id, level, forms, fields, filled, completion): each form of an application (level 0), with a total for each application (level 1,
    form_id null) and for all (level 3, both null); forms is how many were processed. A form or an application without an id is one of its own, at its level."""
    there = F.coalesce(F.col("value") != "", F.lit(False))
    form = F.struct("app_id", "form_id")
    return filled.withColumn("_form", form).rollup("app_id", "form_id").agg(F.grouping_id().cast("int").alias("level"), F.count_distinct("_form").alias("forms"), F.count("*").alias("fields"), F.count_if(there).alias("filled"), (F.count_if(there) / F.count("*") * 100).alias("completion"))


def application_records(filled: DataFrame) -> DataFrame:
    """(app_id, forms_processed, fields, filled, completion, forms): one row for each application, with an entry (form_id, fields, filled, completion)
    for each of its forms, in the order of their ids, one without an id first.

    Each form is summed up once; the application's own figures are the sums of its forms', so the share is over all its fields.
    """
    there = F.coalesce(F.col("value") != "", F.lit(False))
    each = filled.groupBy("app_id", "form_id").agg(F.count("*").alias("fields"), F.count_if(there).alias("filled"))
    entry = F.struct("form_id", "fields", "filled", (F.col("filled") / F.col("fields") * 100).alias("completion"))
    out = each.groupBy("app_id").agg(F.count("*").alias("forms_processed"), F.sum("fields").alias("fields"), F.sum("filled").alias("filled"), F.collect_list(entry).alias("forms"))
    order = lambda a, b: F.when(a["form_id"].isNull() & b["form_id"].isNull(), 0).when(a["form_id"].isNull(), -1).when(b["form_id"].isNull(), 1).when(a["form_id"] < b["form_id"], -1).when(a["form_id"] > b["form_id"], 1).otherwise(0)
    return out.select("app_id", "forms_processed", "fields", "filled", (F.col("filled") / F.col("fields") * 100).alias("completion"), F.array_sort("forms", order).alias("forms"))


def run_summary(documents: DataFrame) -> DataFrame:
    """(processed, successful, success_rate, average_confidence) of documents (confidence): successful above 0.5."""
    good = F.count_if(F.col("confidence") > 0.5)
    return documents.agg(F.count("*").alias("processed"), good.alias("successful"), (good / F.nullif(F.count("*"), F.lit(0)) * 100).alias("success_rate"), F.avg("confidence").alias("average_confidence"))
