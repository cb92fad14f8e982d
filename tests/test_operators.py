"""Edge cases of the operators on small fixtures."""

from __future__ import annotations

import json
import math
import random
import struct
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerleaf.functions import values as V
from ledgerleaf.operators import forms, mapping, merge, planning, registry, replies, routing, schema
from ledgerleaf.plans import catalog
from ledgerleaf.sources import files, sinks



def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_dates_and_numbers(spark):
    dates = ["2024-02-30", "03/04/1970", "", None, "May 1980", "a/b", "12-3-4"]
    assert one(spark, *[V.format_date(F.lit(d).cast("string")).alias(f"c{i}") for i, d in enumerate(dates)]) == ("02/30/2024", "03/04/1970", None, None, "May 1980", "a/b", "12-3-4")
    numbers = [0.0, 12345678.5, 5e-4, 1e9, -3.0, 1.23456789, 5e-7, 1.5e-10, -2.5e-5, 0.1, 123456789.123, float("nan"), float("inf"), 1e15 + 0.5, 3.25e-101]
    expected = tuple(str(int(x)) if math.isfinite(x) and x == int(x) else str(x) for x in numbers)
    assert one(spark, *[V.number_text(F.lit(x)).alias(f"c{i}") for i, x in enumerate(numbers)]) == expected
    assert one(spark, V.money(F.lit("$1,500,000")), V.money(F.lit("n/a")), V.percent(F.lit("75%")), V.iso_date(F.lit("March 4, 2021")), V.dashed_id(F.lit("12-3456789"), (2, 7)), V.dashed_id(F.lit("123"), (3, 2, 4))) == (1500000.0, None, 75.0, "2021-03-04", "12-3456789", None)


def test_yes_no_and_truth(spark):
    assert one(spark, V.yes_no(F.lit("Y")), V.yes_no(F.lit("0")), V.yes_no(F.lit("2")), V.yes_no(F.lit(None).cast("string")), V.yes_no(F.lit(False), True)) == ("Yes", "No", None, None, "No")
    texts = ["null", "false", "0", "0.0", '""', "[]", "{}", "1", '"a"', "[0]", '{"a":null}', "true"]
    assert one(spark, *[V.truthy_json(F.lit(t)).alias(f"c{i}") for i, t in enumerate(texts)]) == (False,) * 7 + (True,) * 5


MERGES = [
    (['{"s":""}', '{"s":"a"}', '{"s":"b"}'], {"s": "a"}),
    (['{"p":{"x":1}}', '{"p":{"x":2}}', '{"p":{"x":0}}'], {"p": {"x": 2}}),
    (['{"p":{"x":1}}', '{"p":{"y":false}}'], {"p": {"x": 1}}),
    (['{"p":{"y":false}}', '{"p":{"x":1}}'], {"p": {"y": False, "x": 1}}),
    (['{"p":{"l":[1]}}', '{"p":{"l":[2]}}'], {"p": {"l": [2]}}),
    (['{"_m":1,"s":1}', '{"_m":2}'], {"s": 1}),
    (['{"p":null}', '{"p":{"x":0}}'], {"p": {"x": 0}}),
    (['{"p":{"x":1}}', '{"p":{"q":{}}}', '{"p":{"q":{"z":0}}}'], {"p": {"x": 1, "q": {"z": 0}}}),
]


def batches(spark, cases):
    rows = [(app, n, text) for app, texts in enumerate(cases) for n, text in enumerate(texts)]
    return spark.createDataFrame(rows, "app_id long, batch_ord long, text string").select("app_id", "batch_ord", F.try_parse_json("text").alias("payload"))


def rebuilt(spark, cases):
    return {r[0]: json.loads(r[1]) for r in merge.merge_records(batches(spark, cases)).collect()}


def test_merge_cases(spark):
    exact = {r[0]: json.loads(r[1]) for r in merge.fold_records(batches(spark, [m[0] for m in MERGES])).collect()}
    assert exact == {i: m[1] for i, m in enumerate(MERGES)}
    set_based = rebuilt(spark, [m[0] for m in MERGES])
    assert set_based == exact


def nested(depth, leaves):
    return leaves if depth == 0 else {"a": nested(depth - 1, leaves)}


def test_merge_and_counts_at_any_depth(spark):
    cases = [[json.dumps(nested(8, {"x": 1})), json.dumps(nested(8, {"y": 2}))], [json.dumps(nested(12, {"x": 0, "y": [1]})), json.dumps(nested(3, {"b": 5}))]]
    exact = {r[0]: json.loads(r[1]) for r in merge.fold_records(batches(spark, cases)).collect()}
    assert rebuilt(spark, cases) == exact and exact[0] == nested(8, {"x": 1, "y": 2})
    flat = merge.leaves_of(batches(spark, [[json.dumps(nested(4, {"x": 1, "y": "a", "z": [0], "_h": 1, "n": {}}))]]))
    assert flat.agg(F.max(F.size("path"))).first()[0] == 5
    assert replies.count_data_points(flat).first().data_points == 3


leaf = st.sampled_from([0, 1, 2, "", "a", "b", False, True, None, [], [1], {}])
inner = st.dictionaries(st.sampled_from("xy"), leaf, max_size=2)
member = st.one_of(inner, st.fixed_dictionaries({}, optional={"z": inner, "x": leaf}))
steady = st.fixed_dictionaries({}, optional={"s": leaf, "t": leaf, "p": st.fixed_dictionaries({}, optional={"u": leaf, "q": member}), "_m": leaf})
mixed = st.fixed_dictionaries({}, optional={"s": st.one_of(leaf, inner), "p": st.one_of(leaf, st.fixed_dictionaries({}, optional={"u": leaf, "q": st.one_of(leaf, member)})), "_m": leaf})


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(steady, min_size=1, max_size=4), min_size=20, max_size=60), st.lists(st.lists(mixed, min_size=1, max_size=5), min_size=20, max_size=60))
def test_merge_agrees_with_fold(spark, some, others):
    """Records whose paths keep their kind, and such whose paths change it from batch to batch."""
    cases = some + others
    expected = {i: merge.folded([json.loads(json.dumps(r)) for r in c]) for i, c in enumerate(cases)}
    found = rebuilt(spark, [[json.dumps(r) for r in c] for c in cases])
    assert {i: found.get(i, {}) for i in expected} == expected


def test_only_conflicts_are_folded(spark, monkeypatch):
    cases = [['{"p":{"q":{"d":1}}}', '{"p":{"q":5}}'], ['{"p":{"q":{"d":1}}}', '{"p":{"q":0}}', '{"p":{"q":{}}}'], ["[1]", '{"p":3}', "7", '{"p":{"q":1}}'], ["[1]"]]
    asked, fold = [], merge.fold_records
    monkeypatch.setattr(merge, "fold_records", lambda df, *how: asked.extend(r.app_id for r in df.collect()) or fold(df, *how))
    assert rebuilt(spark, cases) == {0: {"p": {"q": 5}}, 1: {"p": {"q": {"d": 1}}}, 2: {"p": 3}} and set(asked) == {0, 2}
    leaves = {(r.app_id, tuple(r.path)): r.value for r in merge.deep_merge(batches(spark, cases)).collect()}
    assert leaves == {(0, ("p", "q")): "5", (1, ("p", "q", "d")): "1", (2, ("p",)): "3"}
    plan = merge.merge_records(batches(spark, cases[1:2]))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
    assert merge.merge_records(batches(spark, cases).limit(0)).count() == 0


def test_replies(spark):
    texts = ['x ```json{"a":1}``` y', "```\n{}\n```", '```json{"a":1}', "[1]", '{"a":1,"a":2}', None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, reply string")
    assert [r.failed for r in replies.parse_reply(df).orderBy("id").collect()] == [False, False, True, True, True, True, True]

    def model(b):
        raise ValueError("no model")

    failed = replies.score(df, model, "id int, out string, ok boolean, error string").orderBy("id").collect()
    assert [(r.id, r.ok, r.error, r.out) for r in failed][:1] == [(0, False, "ValueError: no model", None)] and len(failed) == len(texts)


def test_registry_ties_and_gaps(spark):
    cols = "hash string, file_id string, path string, size long, uploaded_at double"
    reg = spark.createDataFrame([("h", "f1", "a", None, None), ("h", "f2", "b", 5, 10.0), ("g", "f2", "c", 7, 5.0)], cols)
    assert [r.file_id for r in registry.upsert(reg, reg.limit(0)).orderBy("hash").collect()] == ["f2", "f2"]
    assert registry.drop_ids(reg, spark.createDataFrame([("f2",)], "file_id string")).count() == 1
    assert registry.expire(reg, now=5.0 + 7 * 86400).count() == 2
    assert registry.stats(reg.limit(0)).first().entries == 0


def test_routing_and_forms(spark):
    df = spark.createDataFrame([("real estate",), ("Company",), ("loan",), ("x",)], "n string")
    assert [r[0] for r in df.select(routing.section(F.col("n"))).collect()] == ["Personal Information", "Business Information", "Financial Information", "Additional Information"]
    notes = [("f", 1, 1, "/Tx", "A", 2, None), ("f", 2, 1, "/Ch", "A", 0, ["x"]), ("f", 1, 2, None, "B", 3, None), ("f", 1, 3, "/Btn", "", 3, None), ("g", 1, 1, "/Tx", "birth date", 3, None)]
    fields = forms.fields_from_annotations(spark.createDataFrame(notes, "form_id string, page int, ord int, FT string, T string, Ff int, Opt array<string>"))
    assert {(r.form_id, r.field_name, r.field_type, r.required) for r in fields.collect()} == {("f", "A", "dropdown", False), ("g", "birth date", "date", True)}
    assert [r.options for r in fields.orderBy("form_id").collect()] == [["x"], None]
    every = forms.with_fallback(spark.createDataFrame([("f",), ("h",)], "form_id string"), fields, catalog.common_fields(spark))
    assert every.where("form_id = 'h'").count() == 25


def test_mapping_plan_has_no_python(spark, data):
    from ledgerleaf.plans.bridge import records

    plan = mapping.rule_values(records(spark, data))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_boxes(spark):
    states = F.array(F.lit("/Off"), F.lit("/On"))
    assert one(spark, mapping.checkbox_state(F.lit("On"), states), mapping.checkbox_state(F.lit("On"), F.lit(None).cast("array<string>")), mapping.checkbox_state(F.lit(None).cast("string"), states)) == ("/On", "/Yes", "/Off")


def test_schema_documents(spark):
    fields = catalog.model_fields(spark)
    assert fields.count() == 71
    docs = {r.model: json.loads(r.schema) for r in schema.schema_docs(fields).collect()}
    assert docs["DebtScheduleItem"]["required"] == ["creditorName", "currentBalance"]
    assert docs["BeneficialOwnerMetadata"]["properties"]["dateOfBirth"]["format"] == "date-time"
    assert list(json.loads(schema.combined(schema.schema_docs(fields), ["BusinessMetadata"]).first()[0])["properties"]) == ["businessmetadata"]
    assert schema.struct_type("DebtScheduleItem")["interestRate"].dataType.simpleString() == "double"
    assert schema.debt_schema()["debts"].dataType.simpleString().startswith("array<struct<creditorName:string")
    with pytest.raises(KeyError):
        schema.struct_type("None")


def png(width, height, rows):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "b.PDF").write_bytes(b"two")
    (tmp_path / "c.png").write_bytes(b"three")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/d.xlsx").write_bytes(b"four")
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(files.scan_files(spark, str(tmp_path))) == ["a.pdf", "c.png"]
    assert names(files.scan_files(spark, str(tmp_path), recursive=True)) == ["a.pdf", "d.xlsx"]
    assert files.scan_files(spark, str(tmp_path / "none")).count() == 0
    bad = spark.createDataFrame([(b"a\xff b",), (None,)], "content binary")
    assert [r.text for r in files.text_prefix(bad).collect()] == ["a b", None]


def test_image_statistics(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(png(4, 4, [bytes([0, 255, 0, 255])] * 4))
    (tmp_path / "y.png").write_bytes(png(4, 4, [bytes([9] * 4)] * 4))
    images = spark.read.format("image").load(str(tmp_path))
    found = {r.origin[-5]: (round(r.variance), r.text_heavy, r.media_type) for r in planning.text_heavy(images).collect()}
    assert found["y"] == (0, False, "image/jpeg") and found["x"] == (round(254**2 * 2 / 9), True, "image/png")


def test_sinks_and_mappings(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/one.json").write_text('{"version": "2", "mappings": {"A": {"source_field": "a", "type": "text", "transform": "uppercase", "required": true}}}')
    (tmp_path / "m/one_mapping.json").write_text('{"mappings": {"B": {"source_field": "b", "type": "text"}}}')
    (tmp_path / "m/two_dynamic.json").write_text('{"fields": {"C": {"field_type": "checkbox", "required": true}}}')
    rows = {(r.form_id, r.pdf_field, r.source_field, r.version) for r in sinks.load_mappings(spark, str(tmp_path / "m")).collect()}
    assert rows == {("one", "A", "a", "2"), ("two", "C", "C", "1.0")}
    (tmp_path / "l").mkdir()
    layout = {"sheet": {"name": "Sheet", "assets_section": {"title": "ASSETS", "current": {"line_items": [{"line": "1a", "description": "Cash", "field": "cash"}, {"description": "Other", "field": "other"}], "subtotal": "Total Current"}, "total": "TOTAL"},
                        "info": {"fields": ["ein", {"label": "Name:", "field": "name", "width": 200}], "font": "x"}, "net": {"a": {"b": {"c": {"d": {"income_fields": ["deep"], "calculation": "A - B", "final_total": "NET"}}}}}}}
    (tmp_path / "l/x.json").write_text(json.dumps(layout))
    found = {tuple(r) for r in sinks.load_layouts(spark, str(tmp_path / "l")).collect()}
    assert found == {
        ("sheet", "assets_section", "current", 0, "1a", "Cash", "cash", "line_item"), ("sheet", "assets_section", "current", 1, None, "Other", "other", "line_item"),
        ("sheet", "assets_section", "current", None, None, "Total Current", None, "subtotal"), ("sheet", "assets_section", None, None, None, "TOTAL", None, "total"),
        ("sheet", "info", None, 0, None, None, "ein", "field"), ("sheet", "info", None, 1, None, "Name:", "name", "field"), ("sheet", "net", "a/b/c/d", 0, None, None, "deep", "field"),
        ("sheet", "net", "a/b/c/d", None, None, "A - B", None, "calculation"), ("sheet", "net", "a/b/c/d", None, None, "NET", None, "total"),
    }
    df = spark.createDataFrame([(1, "t", "x")], "app_id int, doc_type string, v string")
    sinks.write_json(df, str(tmp_path / "out"), "doc_type", "app_id")
    assert spark.read.json(str(tmp_path / "out")).first().v == "x"


def test_report(spark):
    runs = spark.createDataFrame([(1, "hybrid", 12.5), (2, "hybrid", 0.0)], "app_id int, method string, seconds double")
    docs = spark.createDataFrame([(1, "b.pdf", None, "ocr", 1.0), (1, "a.pdf", "pfs", "images", 0.0)], "app_id int, name string, doc_type string, method string, confidence double")
    stats = spark.createDataFrame([(1, "success", 1.0, None), (1, "files", None, "2"), (1, "empty", 0.0, None)], "app_id int, name string, share double, text string")
    found = {r.app_id: r.report for r in sinks.report_lines(runs, docs, stats).collect()}
    assert found[1] == (
        "# Document Extraction Results\n\n**Processing Time**: 12.50s\n**Method**: hybrid\n\n## Documents Processed\n\n### a.pdf\n- Type: pfs\n- Method: images\n- Confidence: 0.00%\n\n"
        "### b.pdf\n- Type: unknown\n- Method: ocr\n- Confidence: 100.00%\n\n## Statistics\n\n- empty: 0.00%\n- files: 2\n- success: 100.00%\n"
    )
    assert found[2].endswith("## Documents Processed\n")


def test_requested_forms(spark):
    """Every request gets a row, also for a form of which nothing is filled, one without required fields and one without fields; repeated requests are one."""
    wide = [(3, f"F{n:03}", n % 2 == 0) for n in range(300)]
    fields = spark.createDataFrame([(1, "A", True), (1, "B", True), (2, "C", False), *wide], "form_id int, field_name string, required boolean")
    filled = spark.createDataFrame([(7, 1, "A", "x"), (7, 1, "B", ""), (7, 2, "C", "x"), *[(7, 3, f"F{n:03}", "x") for n in range(300) if n % 4]], "app_id int, form_id int, field_name string, value string")
    asked = spark.createDataFrame([(7, 1, "late"), (8, 2, None), (7, 1, "late"), (7, 9, "late"), (7, 3, "late")], "app_id int, form_id int, error string")
    found = {(r.app_id, r.form_id): (r.completion, r.confidence, r.error[-6:]) for r in mapping.fallback_result(filled, fields, asked).collect()}
    assert found == {(7, 1): (50.0, 0.8, ": late"), (8, 2): (0.0, None, "ping: "), (7, 9): (0.0, None, ": late"), (7, 3): (75.0, 0.8, ": late")}
    done = {(r.app_id, r.form_id): (r.completion, r.missing) for r in mapping.completion(filled, fields, asked).collect()}
    assert done == {(7, 1): (50.0, ["B"]), (8, 2): (100.0, []), (7, 9): (100.0, []), (7, 3): (50.0, [f"F{n:03}" for n in range(0, 300, 4)])}
    assert mapping.fallback_result(filled, fields, asked.limit(0)).count() == mapping.completion(filled, fields, asked.limit(0)).count() == 0


def test_fields_are_looked_up_without_a_shuffle_by_name(spark, data):
    from ledgerleaf.plans.bridge import records

    maps = mapping.rule_maps(records(spark, data))
    fields = spark.createDataFrame([(1, "FIRST name"), (1, "Remarks"), (2, "dob"), (2, "DOB")], "form_id int, field_name string")
    every = mapping.map_fields(maps, fields)
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "nation" in plan  # the join of the given tables that makes applicants; no other
    asked = maps.select("app_id", F.lit(2).alias("form_id"))
    assert sorted(map(tuple, every.where("form_id = 2").collect())) == sorted(map(tuple, mapping.map_fields(maps, fields, asked).collect()))
    assert {r.field_name for r in every.collect()} == {"FIRST name", "dob", "DOB"}
    assert mapping.map_fields(maps, fields.limit(0)).count() == 0


def test_absent_required_fields(spark):
    values = spark.createDataFrame([(1, "ein", "12-3456789"), (2, "businessName", "x"), (2, "ein", "bad")], "record_id int, field string, value string")
    found = {tuple(r) for r in schema.validate(values, catalog.model_fields(spark), "BusinessMetadata").collect()}
    assert found == {(1, "businessName", "required"), (2, "ein", "pattern")}


def test_whole_numbers_of_any_size(spark):
    dice = random.Random(1)
    numbers = [0.0, -0.0, 1.0, -5.0, 1e19, 9.3e18, -1e20, 1e39, 1e23, 2.0**62, 2.0**63, -(2.0**63), 2.0**64, 1.7976931348623157e308, -1e300, 123456789012345680.0] + [dice.uniform(1, 10) * 10 ** dice.randrange(16, 308) for _ in range(100)]
    found = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", V.number_text(F.col("x")).alias("text")).collect()
    assert all(r.text == str(int(r.x)) for r in found)


def test_failures_share_calls_of_the_model(spark):
    """One request in a hundred fails: the others near it are not asked one by one, and all values stay as they are."""
    asked = spark.sparkContext.accumulator(0)

    def model(b):
        asked.add(1)
        if (b["id"] % 100 == 7).any():
            raise ValueError("no")
        return b.assign(out=b["id"] + (1 << 60))

    rows = replies.score(spark.range(0, 2000, 1, 1), model, "id long, out long, ok boolean, error string").collect()
    assert sorted((r.id, r.out, r.ok, r.error) for r in rows) == [(i, None, False, "ValueError: no") if i % 100 == 7 else (i, i + (1 << 60), True, None) for i in range(2000)]
    assert asked.value < 1000  # one by one: 2001


def test_tasks_do_not_grow_with_the_batches(spark, monkeypatch):
    """Twice the batches are opened and sorted by twice the tasks."""
    monkeypatch.setattr(merge, "BATCHES", 500, raising=False)

    def parts(n):
        batches = spark.range(n).selectExpr("id div 10 as app_id", "id as batch_ord", "parse_json('{\"a\":' || id || ',\"p\":{\"q\":1}}') as payload")
        leaves = merge.leaves_of(batches)
        assert leaves.count() == 2 * n
        return leaves.rdd.getNumPartitions()

    assert parts(4000) == 8
    assert parts(8000) == 16
