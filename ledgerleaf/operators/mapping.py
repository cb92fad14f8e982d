"""From extracted values to form fields: rules, suggestions, explicit mappings, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions import values as V
from ledgerleaf.plans.catalog import OTHER, OWN


#: The rules by name, each with the part of a record that it takes.
RULES = {
    "Name": "name", "First Name": "first", "Last Name": "last",
    "Social Security Number": "ssn", "SSN": "ssn", "Date of Birth": "born", "DOB": "born",
    "Mobile Telephone Number": "mobile", "Mobile Phone": "mobile", "Business Phone": "work",
    "Email address": "email", "Email": "email",
    "Residence Address": "street", "Home Address": "street", "City, State, Zip": "csz",
    "City": "city", "State": "state", "Zip": "zip",
    "Business Applicant Name": "firm", "Business Name": "firm", OWN: "share", "Ownership Percentage": "share", "EIN": "ein",
    "Are you a U.S. Citizen?": "citizen", "US Citizen": "citizen", OTHER: "other",
    "Have you ever declared bankruptcy?": "bankrupt",
    "Are you a defendant in any lawsuits or legal actions?": "lawsuits",
    "Are you delinquent on any taxes?": "taxes",
}
#: Rows of a catalog of forms, at most, that stands as a literal in an expression; forms whose fields are broadcast, at most.
LITERAL, BROADCAST = 10_000, 100_000


def record_parts(records: DataFrame, key: str = "app_id") -> DataFrame:
    """(``key``, a column for each part of RULES) of ``records`` (record, of the extraction contract), each part evaluated once for a record."""
    record = F.col("record")
    pa, home = record["personal"]["primary_applicant"], record["addresses"]["current_residence"]
    firm, asked = record["business"]["primary_business"], record["checkboxes_and_questions"]
    plain = {
        "first": pa["name"]["first"], "last": pa["name"]["last"], "ssn": pa["ssn"], "mobile": pa["phones"]["mobile"], "work": pa["phones"]["business"], "email": pa["email"],
        "street": V.street(home), "city": home["city"], "state": home["state"], "zip": home["zip"], "firm": firm["legal_name"], "ein": firm["ein"],
    }
    made = {
        "name": V.full_name(pa["name"]), "born": V.format_date(pa["dob"]), "csz": V.city_state_zip(home), "citizen": V.yes_no(pa["citizenship"]["is_us_citizen"], True),
        "other": V.other_businesses(record["business"]["affiliated_businesses"]), "bankrupt": V.yes_no(asked["has_declared_bankruptcy"], True),
        "lawsuits": V.yes_no(asked["pending_lawsuits"], True), "taxes": V.yes_no(asked["delinquent_on_taxes"], True),
    }
    own = {"_own": pa["ownership_percentage"], "_owners": firm["ownership"]}
    one = records.select(key, *[c.alias(n) for n, c in (plain | made | own).items()])
    return one.withColumn("share", V.ownership_pct(F.col("_own"), F.col("_owners"), F.col("name"))).drop(*own)


def rule_maps(records: DataFrame, key: str = "app_id") -> DataFrame:
    """(``key``, values): the truthy values of all rules, in a map by the rule's name in lower case."""
    names, parts = F.array(*[F.lit(n.lower()) for n in RULES]), F.array(*[F.col(p) for p in RULES.values()])
    return record_parts(records, key).select(key, F.map_filter(F.map_from_arrays(names, parts), lambda _, v: v != "").alias("values"))


def rule_values(records: DataFrame, key: str = "app_id") -> DataFrame:
    """(``key``, rule_name, value): the truthy values of all rules, one pass over ``records`` (record)."""
    # the outer form is read once; the inner one is repeated in a filter that the optimizer infers
    pairs = F.explode_outer(F.array(*[F.struct(F.lit(name).alias("rule_name"), F.col(part).alias("value")) for name, part in RULES.items()]))
    return record_parts(records, key).select(key, pairs.alias("r")).select(key, "r.rule_name", "r.value").where("value <> ''")


def unmapped_fields(fields: DataFrame) -> DataFrame:
    """The ``fields`` (form_id, field_name, ...) that no rule has the name of, without regard to case."""
    return fields.where(~F.lower("field_name").isin(*[n.lower() for n in RULES]))


def _form_names(fields: DataFrame) -> DataFrame:
    """(form_id, names): the fields of each form that a rule has the name of."""
    ruled = fields.where(F.lower("field_name").isin(*[n.lower() for n in RULES])).select("form_id", "field_name")
    return ruled.groupBy("form_id").agg(F.array_sort(F.collect_list("field_name")).alias("names"))


def map_fields(maps: DataFrame, fields: DataFrame, requests: DataFrame | None = None, key: str = "app_id") -> DataFrame:
    """(``key``, form_id, field_name, value): each form's fields that a rule has a truthy value for, found in the application's map by name without regard to case.

    ``maps`` is of rule_maps(), ``fields`` has form_id, field_name. ``requests`` (``key``, form_id) says which forms an application asks for.
    Without it every application gets every form of a catalog of at most LITERAL ruled fields, which stands in the expression as a
    literal; a larger catalog needs requests. Nothing is shuffled by name.
    """
    found = lambda names: F.filter(F.transform(names, lambda n: F.struct(n.alias("field_name"), F.element_at("values", F.lower(n)).alias("value"))), lambda f: f["value"].isNotNull())
    if requests is None:
        ruled = fields.where(F.lower("field_name").isin(*[n.lower() for n in RULES])).select("form_id", "field_name")
        rows = ruled.limit(LITERAL + 1).collect()
        if len(rows) > LITERAL:
            raise ValueError(f"a catalog of more than {LITERAL} fields needs requests")
        if not rows:
            return maps.select(key, F.lit(None).cast(ruled.schema["form_id"].dataType).alias("form_id"), F.lit("").alias("field_name"), F.lit("").alias("value")).where("false")
        kind = ruled.schema["form_id"].dataType
        listed = F.array(*[F.struct(F.lit(r.form_id).cast(kind).alias("form_id"), F.lit(r.field_name).alias("field_name")) for r in sorted(rows)])
        each = F.transform(listed, lambda f: F.struct(f["form_id"].alias("form_id"), f["field_name"].alias("field_name"), F.element_at("values", F.lower(f["field_name"])).alias("value")))
        return maps.select(key, F.explode_outer(each).alias("f")).select(key, "f.*").where("value is not null")
    names = _form_names(fields)
    asked = requests.select(key, "form_id").distinct().join(_catalog(names), "form_id").join(maps, key)
    return asked.select(key, "form_id", F.explode_outer(found(F.col("names"))).alias("f")).select(key, "form_id", "f.*").where("value is not null")


def _catalog(forms: DataFrame) -> DataFrame:
    """``forms``, a row for each form, for a join: broadcast up to BROADCAST forms."""
    return F.broadcast(forms) if forms.limit(BROADCAST + 1).count() <= BROADCAST else forms


def merge_suggestions(ruled: DataFrame, model: DataFrame) -> DataFrame:
    """Rule values and a model's, by (app_id, form_id, field_name): the model's where truthy, with method."""
    keys = ["app_id", "form_id", "field_name"]
    both = ruled.select(*keys, F.col("value").alias("rule_value")).join(model.select(*keys, F.col("value").alias("model_value")), keys, "full_outer")
    told = V.truthy(F.col("model_value"), "text")
    return both.select(*keys, F.when(told, F.col("model_value")).otherwise(F.col("rule_value")).alias("value"), F.when(told, "model").otherwise("rule").alias("method"))


def fallback_result(filled: DataFrame, fields: DataFrame, requests: DataFrame) -> DataFrame:
    """(app_id, form_id, completion, confidence, method, error) of rule values alone, for each of ``requests`` (app_id, form_id, error).

    completion is the percentage of all the form's fields that are filled, 0 where none is or the form has none; confidence is that of
    each filled field, null where there is none; error says why the model's answer is missing.
    """
    total = fields.groupBy("form_id").agg(F.count("*").alias("total"))
    done = filled.where("value <> ''").groupBy("app_id", "form_id").agg(F.count("*").alias("n"))
    every = requests.select("app_id", "form_id", "error").distinct().join(_catalog(total), "form_id", "left").join(done, ["app_id", "form_id"], "left")
    n = F.coalesce("n", F.lit(0))
    told = F.concat(F.lit("LLM mapping failed, using deterministic mapping: "), F.coalesce("error", F.lit("")))  # a fixed text
    return every.select("app_id", "form_id", F.coalesce(n / F.col("total") * 100, F.lit(0.0)).alias("completion"), F.when(n > 0, 0.8).alias("confidence"), F.lit("deterministic_fallback").alias("method"), told.alias("error"))


def completion(filled: DataFrame, fields: DataFrame, requests: DataFrame) -> DataFrame:
    """(app_id, form_id, completion, missing) for each of ``requests`` (app_id, form_id): percent of the form's required fields that are
    filled, and the names of the others, sorted. A form without required fields is complete.

    The required fields of a form are bits, 63 to a word, in the order of their names; filled ones are OR-ed for each application and form,
    what is missing is the rest, and names come back for those bits only.
    """
    need = fields.where("required").groupBy("form_id").agg(F.array_sort(F.collect_set("field_name")).alias("need"))
    need = _catalog(need)
    words = -(-(need.agg(F.max(F.size("need"))).first()[0] or 1) // 63)
    numbered = need.select("form_id", F.posexplode("need").alias("at", "field_name"))
    bits = filled.where("value <> ''").join(_catalog(numbered), ["form_id", "field_name"])
    word = lambda w: F.bit_or(F.when(F.floor(F.col("at") / 63) == w, F.expr("shiftleft(1L, at % 63)")).otherwise(F.lit(0).cast("long")))
    have = bits.groupBy("app_id", "form_id").agg(F.array(*[word(w) for w in range(words)]).alias("have"))
    every = requests.select("app_id", "form_id").distinct().join(need, "form_id", "left").join(have, ["app_id", "form_id"], "left")
    set_ = lambda at: F.coalesce(F.getbit(F.get("have", (at / 63).cast("int")), at % 63) == 1, F.lit(False))
    missing = F.coalesce(F.filter("need", lambda _, at: ~set_(at)), F.array().cast("array<string>"))
    told = every.select("app_id", "form_id", F.coalesce(F.size("need"), F.lit(0)).alias("n"), missing.alias("missing"))
    share = F.when(F.col("n") == 0, 100.0).otherwise((1 - F.size("missing") / F.col("n")) * 100)
    return told.select("app_id", "form_id", share.alias("completion"), "missing")


def with_provenance(leaves: DataFrame, key: str = "app_id") -> DataFrame:
    """(``key``, field_name, value, source, confidence): the last truthy value of each field, with the document and confidence it came with."""
    won = F.max_by(F.struct("value", "source", "confidence"), F.when(V.truthy(F.col("value"), "text"), F.col("ord")))
    return leaves.groupBy(key, "field_name").agg(won.alias("w")).where("w is not null").select(key, "field_name", "w.value", "w.source", "w.confidence")


def apply_mapping(filled: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """(app_id, form_id, pdf_field, value): source fields that are there, put through their rule; without a mapping (None or empty) non-null values under their own names.

    ``filled`` has app_id, form_id, field_name, value; ``mapping`` form_id, pdf_field, source_field, type, transform.
    """
    plain = filled.where("value is not null").select("app_id", "form_id", F.col("field_name").alias("pdf_field"), "value")
    if mapping is None:
        return plain
    ruled = filled.join(mapping.withColumnRenamed("source_field", "field_name"), ["form_id", "field_name"])
    ruled = ruled.select("app_id", "form_id", "pdf_field", V.transform(F.col("value"), F.col("transform"), F.col("type")).alias("value"))
    return ruled.unionByName(plain.join(mapping.select("form_id").distinct(), "form_id", "left_anti"))


def drop_false_boxes(filled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): values that say true become ``true``, those that say false go; counts has removed for each application and form."""
    low = F.lower("value")
    kept = filled.where(~F.coalesce(low == "false", F.lit(False))).withColumn("value", F.when(low == "true", "true").otherwise(F.col("value")))
    return kept, filled.groupBy("app_id", "form_id").agg(F.count_if(low == "false").alias("removed"))


def split_kinds(filled: DataFrame, fields: DataFrame) -> DataFrame:
    """``filled`` with kind, box or text by the form's field; names that the form doesn't have go."""
    kinds = fields.select("form_id", "field_name", F.when(F.col("field_type").isin("checkbox", "button"), "box").otherwise("text").alias("kind"))
    return filled.join(kinds, ["form_id", "field_name"])


def checkbox_state(value: Column, states: Column) -> Column:
    """The state to set: the first listed one other than /Off, or /Yes, if the value means checked; else /Off."""
    on = F.coalesce(F.get(F.filter(states, lambda s: s != "/Off"), F.lit(0)), F.lit("/Yes"))
    return F.when(F.lower(value).isin(*V.CHECKED), on).otherwise("/Off")


def propagate_children(boxes: DataFrame, widgets: DataFrame) -> DataFrame:
    """``boxes`` (app_id, form_id, field_name, state) and a row with the same state for each child widget (form_id, field_name, parent)."""
    children = boxes.join(widgets.where("parent is not null").select("form_id", F.col("field_name").alias("_child"), F.col("parent").alias("field_name")), ["form_id", "field_name"])
    return boxes.unionByName(children.select("app_id", "form_id", F.col("_child").alias("field_name"), "state"))
