"""Schemas from the model catalog, validation, aliases of field names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerleaf.plans.catalog import JSON_TYPES, MODELS, SPARK_TYPES
from ledgerleaf.session import saved

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def _mapped(kind: Column, to: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in to.items() for x in pair]), kind)


def json_type(kind: Column) -> Column:
    """JSON type of a model type; a DateTime is a string with the format date-time."""
    return _mapped(kind, JSON_TYPES)


def struct_type(model: str) -> StructType:
    """Spark type of a model's records; an unknown model is an error."""
    if model not in MODELS:
        raise KeyError(f"no model {model!r}; there are {', '.join(MODELS)}")
    return StructType.fromDDL(", ".join(f"{field} {SPARK_TYPES[kind]}" for field, kind, *_ in MODELS[model]))


def schema_docs(fields: DataFrame, include_optional: bool = True, note: str | None = None) -> DataFrame:
    """(model, schema): a JSON schema for each model of ``fields`` (model_fields); ``note`` is appended to descriptions."""
    told = F.concat(F.col("description"), F.lit(f". {note}")) if note else F.col("description")
    form = F.coalesce("format", F.when(F.col("type") == "DateTime", "date-time"))
    prop = F.struct(json_type(F.col("type")).alias("type"), told.alias("description"), form.alias("format"), "pattern", "enum")
    rows = fields if include_optional else fields.where("required")
    need = F.transform(F.array_sort(F.collect_list(F.when(F.col("required"), F.struct("ord", "field")))), lambda x: x["field"])
    props = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("ord", "field", prop.alias("p")))), lambda x: F.struct(x["field"], x["p"])))
    return rows.groupBy("model").agg(F.to_json(F.struct(F.lit("object").alias("type"), props.alias("properties"), need.alias("required"))).alias("schema"))


def debt_schema() -> StructType:
    return StructType().add("debts", StructType.fromDDL("x array<struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in struct_type("DebtScheduleItem")) + ">>")[0].dataType).add("totalDebt", "long")


def combined(docs: DataFrame, models: list[str]) -> DataFrame:
    """(schema): one object with a property for each of ``models``, named in lower case."""
    entry = F.concat(F.to_json(F.array(F.lower("model"))), F.lit(":"), F.col("schema"))
    joined = F.array_join(F.sort_array(F.collect_list(F.regexp_replace(entry, r'^\["(\w+)"\]', '"$1"'))), ",")
    return docs.where(F.col("model").isin(models)).agg(F.concat(F.lit('{"type":"object","properties":{'), joined, F.lit("}}")).alias("schema"))


def validate(values: DataFrame, fields: DataFrame, model: str) -> DataFrame:
    """Violations (record_id, field, rule) of long records ``values`` (record_id, field, value) against the catalog of ``model``: required, pattern, enum, email.

    A required field that a record doesn't have at all is a violation like one that is null or empty.
    """
    rules = fields.where(F.col("model") == model).select("field", "required", "format", "pattern", "enum")
    need = rules.where("required").agg(F.collect_list("field").alias("_need")).withColumn("_one", F.lit(1))
    needed = values.select("record_id").distinct().withColumn("_one", F.lit(1)).join(F.broadcast(need), "_one").select("record_id", F.explode("_need").alias("field"))
    absent = needed.join(values.select("record_id", "field"), ["record_id", "field"], "left_anti").withColumn("value", F.lit(None).cast("string"))
    every = values.select("record_id", "field", "value").unionByName(absent).join(F.broadcast(rules), "field")
    v, given = F.col("value"), F.coalesce(F.col("value") != "", F.lit(False))
    broken = F.when(F.col("required") & ~given, "required").when(given & F.col("pattern").isNotNull() & ~F.regexp_like(v, F.col("pattern")), "pattern")
    broken = broken.when(given & F.col("enum").isNotNull() & ~F.array_contains(F.col("enum"), v), "enum").when(given & (F.col("format") == "email") & ~v.rlike(EMAIL), "email")
    return every.withColumn("rule", broken).where("rule is not null").select("record_id", "field", "rule")


def _generated(name: Column) -> Column:
    spaced = F.replace(name, F.lit("_"), F.lit(" "))
    around = [F.concat(F.lit("total "), spaced), F.concat(spaced, F.lit(" total")), F.concat(F.lit("annual "), spaced), F.concat(spaced, F.lit(" amount")), F.concat(spaced, F.lit(" value"))]
    return F.array(name, spaced, F.replace(name, F.lit("_"), F.lit("")), F.initcap(spaced), *around)


def alias_hints(fields: DataFrame, aliases: DataFrame) -> DataFrame:
    """(field, hints): the listed variations in their order, else generated ones, distinct and sorted."""
    listed = aliases.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "alias"))), lambda x: x["alias"]).alias("listed"))
    return fields.select("field").distinct().join(F.broadcast(listed), "field", "left").select("field", F.coalesce("listed", F.array_sort(F.array_distinct(_generated(F.col("field"))))).alias("hints"))


def match_labels(labels: DataFrame, hints: DataFrame) -> DataFrame:
    """``labels`` (label) with field, the canonical field one of whose hints the label is; the earliest hint wins, then the field's name."""
    each = hints.select("field", F.posexplode("hints").alias("pos", "hint")).withColumn("hint", F.lower("hint"))
    best = each.groupBy("hint").agg(F.min(F.struct("pos", "field")).alias("best")).select("hint", F.col("best.field").alias("field"))
    return labels.join(best, F.lower(F.trim("label")) == F.col("hint"), "left").drop("hint")


#: Length of the pieces of text that propose a hint for a label; labels whose matches are broadcast, at most.
GRAM, MATCHES = 3, 1_000_000


def edits_allowed(length: Column) -> Column:
    """Edits by which a label may differ from a hint of this length: none below 4 characters, one below 8, else two."""
    return F.when(length < 4, 0).when(length < 8, 1).otherwise(2)


def _grams(text: Column) -> Column:
    """The distinct pieces of GRAM characters of ``text`` between two marks on each side."""
    padded = F.concat(F.lit("\x02" * (GRAM - 1)), text, F.lit("\x03" * (GRAM - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) + GRAM - 1), lambda at: F.substring(padded, at, F.lit(GRAM))))


def _index(hints: DataFrame) -> DataFrame:
    """(piece, hint): under which pieces a label finds ``hints`` (hint).

    An edit changes GRAM pieces at most, so a label within k edits has one of any k * GRAM + 1 pieces of the hint: the rarest are taken. A hint
    with fewer pieces is listed under the lengths that a label may have.
    """
    k = edits_allowed(F.char_length("hint"))
    named = hints.where(k > 0).select("hint", k.alias("k"), _grams(F.col("hint")).alias("grams"))
    each = named.where(F.size("grams") > F.col("k") * GRAM).select("hint", "k", F.explode("grams").alias("piece"))
    rare = each.groupBy("piece").agg(F.count("*").alias("n"))
    order = Window.partitionBy("hint").orderBy("n", "piece")
    kept = each.join(rare, "piece").withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= F.col("k") * GRAM + 1).select("piece", "hint")
    length = F.char_length("hint")
    lengths = F.transform(F.sequence(length - F.col("k"), length + F.col("k")), lambda n: F.concat(F.lit("\x01"), n.cast("string")))
    return kept.unionByName(named.where(F.size("grams") <= F.col("k") * GRAM).select(F.explode(lengths).alias("piece"), "hint"))


def match_near_labels(labels: DataFrame, hints: DataFrame) -> DataFrame:
    """``labels`` (label, ...) with field, hint and distance: the field one of whose ``hints`` (field, hints) is the label, or else the nearest hint within a few edits.

    Labels are compared in lower case without spaces at their ends. Equality comes first (distance 0; as match_labels()); else the hint with
    the least edit distance within edits_allowed() of its length, the earliest in its list, then the field's name. Null where there is none.
    Distinct labels meet the hints through an index of pieces of text, and only proposed pairs are compared; no label meets all hints.
    """
    each = hints.select("field", F.posexplode("hints").alias("pos", "hint")).withColumn("hint", F.lower("hint"))
    best = each.groupBy("hint").agg(F.min(F.struct("pos", "field")).alias("best"))
    key = F.lower(F.trim("label"))
    asked = labels.select(key.alias("_key")).where("_key is not null").distinct()
    same = asked.join(best, F.col("_key") == F.col("hint")).select("_key", "best.field", "hint", F.lit(0).alias("distance"))
    rest = asked.join(best, F.col("_key") == F.col("hint"), "left_anti")
    pieces = F.array_append(_grams(F.col("_key")), F.concat(F.lit("\x01"), F.char_length("_key").cast("string")))
    proposed = rest.select("_key", F.explode(pieces).alias("piece")).join(_index(best.select("hint")), "piece").select("_key", "hint").distinct()
    k = edits_allowed(F.char_length("hint"))
    near = proposed.where(F.abs(F.char_length("_key") - F.char_length("hint")) <= k).withColumn("distance", F.levenshtein("_key", "hint")).where(F.col("distance") <= k).join(best, "hint")
    near = near.groupBy("_key").agg(F.min(F.struct("distance", "best.pos", "best.field", "hint")).alias("m")).select("_key", "m.field", "m.hint", "m.distance")
    found = saved(same.unionByName(near))
    found = F.broadcast(found) if found.count() <= MATCHES else found
    return labels.join(found, key == F.col("_key"), "left").select(*[labels[c] for c in labels.columns], "field", "hint", "distance")


def unpivoted(records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(record_id, field, value): the string columns of ``records`` as rows."""
    args = ", ".join(f"'{c}', `{c}`" for c in columns)
    return records.select(F.col(key).alias("record_id"), F.expr(f"stack({len(columns)}, {args}) as (field, value)"))


def required_names(model: str) -> list[str]:
    return [field for field, _, need, _ in MODELS[model] if need]
