"""Classification of documents, packages, templates and fields by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions.values import extension, first_of

#: Keywords of form sections, in order.
SECTIONS = {
    "Personal Information": ["name", "ssn", "social", "birth", "phone", "email", "address", "city", "state", "zip", "marital", "citizen"],
    "Business Information": ["business", "company", "ownership", "ein", "entity", "corporation", "llc", "partnership"],
    "Financial Information": ["asset", "liability", "income", "expense", "worth", "financial", "bank", "loan", "mortgage", "debt"],
}
OTHER_SECTION = "Additional Information"
RASTER = (".png", ".jpg", ".jpeg", ".bmp", ".tiff")


def doc_type(path: Column) -> Column:
    """Type of a document by its path; null if no rule fits."""
    p = F.lower(path)
    rules = [(p.contains("pfs") | p.contains("personal_financial"), "pfs"), (p.contains("debt") & p.contains("schedule"), "debt_schedule"), (p.contains("sba"), "sba_forms"), (p.contains("tax") | p.contains("return"), "tax_returns")]
    return first_of(rules)


def package_type(files: DataFrame, key: str = "app_id") -> DataFrame:
    """(``key``, package_type): the type of the first path in order ``ord`` that has one; mixed if none has."""
    kind = doc_type(F.col("path"))
    return files.groupBy(key).agg(F.coalesce(F.min_by(kind, F.when(kind.isNotNull(), F.col("ord"))), F.lit("mixed")).alias("package_type"))


def output_group(kind: Column) -> Column:
    return F.when(kind.isin("pfs", "debt_schedule", "sba_forms", "tax_returns"), kind).otherwise("mixed")


def owner(files: DataFrame, keywords: list[tuple[str, str]], key: str = "app_id") -> DataFrame:
    """(``key``, owner): label of the first keyword found in the first path that has one, else unknown; first and last name, where both are there, win."""
    label = first_of([(F.lower("path").contains(word), name) for word, name in keywords])
    named = F.max(F.when((F.col("first") != "") & (F.col("last") != ""), F.replace(F.lower(F.concat_ws("_", "first", "last")), F.lit(" "), F.lit("_"))))
    return files.groupBy(key).agg(F.coalesce(named, F.min_by(label, F.when(label.isNotNull(), F.col("ord"))), F.lit("unknown")).alias("owner"))


def format_class(path: Column) -> Column:
    """pdf, excel, raster, or unknown, which is tried as an image and then as text."""
    ext = extension(path)
    return F.when(ext == ".pdf", "pdf").when(ext.isin(".xlsx", ".xls"), "excel").when(ext.isin(*RASTER), "raster").otherwise("unknown")


def block_plan(files: DataFrame, pages: DataFrame, key: str = "app_id") -> DataFrame:
    """(``key``, block_no, kind, doc_id, page_no): the prompt, then a block for each pdf and one for each page of other files. ``files`` without a file_id are left out."""
    sent = files.where("file_id is not null").withColumn("_pdf", format_class(F.col("path")) == "pdf")
    documents = sent.where("_pdf").select(key, F.col("ord"), F.lit("document").alias("kind"), "doc_id", F.lit(0).alias("page_no"))
    images = sent.where("not _pdf").join(pages.select("doc_id", "page_no"), "doc_id").select(key, "ord", F.lit("image").alias("kind"), "doc_id", "page_no")
    prompts = sent.select(key).distinct().select(key, F.lit(-1).cast("long").alias("ord"), F.lit("prompt").alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("page_no"))
    order = Window.partitionBy(key).orderBy("ord", "doc_id", "page_no")
    every = prompts.unionByName(documents).unionByName(images)
    return every.select(key, F.row_number().over(order).alias("block_no"), "kind", "doc_id", "page_no")


def pick_template(forms: DataFrame, rules: list[tuple[str, str]], default: str | None) -> DataFrame:
    """``forms`` (name, ...) with template: that of the first keyword its name contains, else ``default``."""
    return forms.withColumn("template", first_of([(F.col("name").contains(word), template) for word, template in rules], default))


def section(field_name: Column) -> Column:
    """Section of a field: the first keyword list of which a word is part of its name. ``real estate`` holds ``state``, so it is personal."""
    low = F.lower(field_name)
    return first_of([(low.rlike("|".join(words)), name) for name, words in SECTIONS.items()], OTHER_SECTION)


def classify_sections(fields: DataFrame) -> DataFrame:
    """(form_id, section_no, section, field_names): the sections of a form that have fields, in their fixed order."""
    names = [*SECTIONS, OTHER_SECTION]
    number = first_of([(F.col("section") == n, i) for i, n in enumerate(names)])
    found = fields.withColumn("section", section(F.col("field_name")))
    return found.groupBy("form_id", number.alias("section_no"), "section").agg(F.sort_array(F.collect_list("field_name")).alias("field_names"))
