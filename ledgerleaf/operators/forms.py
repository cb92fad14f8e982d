"""Form fields from annotations, mappings or fallbacks. Fields have form_id, field_name, field_type, required, page, options."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.operators.routing import classify_sections


def fields_from_annotations(annotations: DataFrame) -> DataFrame:
    """Fields of ``annotations`` (form_id, page, ord, FT, T, Ff, Opt) that have a type and a name; of one name the last page and place wins."""
    code, name = F.regexp_extract("FT", "[A-Za-z]+", 0), F.col("T")
    kind = F.when(code == "Btn", "checkbox").when(code == "Ch", "dropdown").when(code == "Sig", "signature").when(F.lower(name).contains("date"), "date").otherwise("text")
    order = Window.partitionBy("form_id", "T").orderBy(F.desc("page"), F.desc("ord"))
    rows = annotations.where("FT is not null and T <> ''").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    need = F.coalesce(F.col("Ff").bitwiseAND(F.lit(2)) != 0, F.lit(False))
    return rows.select("form_id", name.alias("field_name"), kind.alias("field_type"), need.alias("required"), "page", F.when(kind == "dropdown", F.col("Opt")).alias("options"))


def with_fallback(forms: DataFrame, fields: DataFrame, common: DataFrame) -> DataFrame:
    """``fields``, and ``common`` for each of ``forms`` (form_id) that has none."""
    bare = forms.select("form_id").distinct().join(fields.select("form_id"), "form_id", "left_anti")
    names = common.select(F.collect_list(F.struct("field_name", "field_type", "required", "page")).alias("f"))
    filled = bare.withColumn("_one", F.lit(1)).join(F.broadcast(names.withColumn("_one", F.lit(1))), "_one").select("form_id", F.explode("f").alias("f")).select("form_id", "f.*")
    return fields.unionByName(filled.withColumn("options", F.lit(None).cast("array<string>")))


def form_structure(fields: DataFrame) -> DataFrame:
    """(form_id, total_fields, required_fields, sections): sections as ``name: fields`` in their order."""
    sections = classify_sections(fields).groupBy("form_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section_no", "section", "field_names"))), lambda s: F.struct(s["section"].alias("section"), s["field_names"].alias("field_names"))).alias("sections"))
    return fields.groupBy("form_id").agg(F.count("*").alias("total_fields"), F.count_if("required").alias("required_fields")).join(sections, "form_id")


def fields_from_mapping(mapping: DataFrame) -> DataFrame:
    """Fields of a static mapping (form_id, pdf_field, type, required): checkbox where the type says so, else text."""
    kind = F.when(F.lower("type").contains("checkbox"), "checkbox").otherwise("text")
    return mapping.select("form_id", F.col("pdf_field").alias("field_name"), kind.alias("field_type"), F.coalesce("required", F.lit(False)).alias("required"), F.lit(1).alias("page"), F.lit(None).cast("array<string>").alias("options"))


def resolve_fields(*sources: DataFrame) -> DataFrame:
    """For each form the fields of the first of ``sources`` that has any (static mapping, dynamic, fallback)."""
    ranked = reduce(DataFrame.unionByName, [s.withColumn("source_no", F.lit(n)) for n, s in enumerate(sources)])
    return ranked.withColumn("_r", F.dense_rank().over(Window.partitionBy("form_id").orderBy("source_no"))).where("_r = 1").drop("_r")
