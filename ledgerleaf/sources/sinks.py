"""JSON and report sinks, mapping and layout sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.session import saved

MAPPING = "version string, mappings map<string,struct<source_field:string,type:string,transform:string,required:boolean>>, fields map<string,struct<field_type:string,required:boolean>>"


def as_json(df: DataFrame, *by: str) -> DataFrame:
    """(``by``, json): each row as a JSON document."""
    return df.select(*by, F.to_json(F.struct(*df.columns)).alias("json"))


def write_json(df: DataFrame, folder: str, *by: str) -> None:
    """JSON documents below ``folder``, partitioned by the columns ``by``."""
    df.write.mode("append").partitionBy(*by).json(folder) if by else df.write.mode("append").json(folder)


def percent_text(share: Column) -> Column:
    return F.when(share.isNotNull(), F.format_string("%.2f%%", share * 100))


def report_lines(runs: DataFrame, documents: DataFrame, statistics: DataFrame, key: str = "app_id") -> DataFrame:
    """(``key``, report): the summary of each of ``runs`` (``key``, method, seconds), in a fixed layout.

    A block for each of ``documents`` (``key``, name, doc_type, method, confidence) in the order of names; a line for each of
    ``statistics`` (``key``, name, share, text) by name: floats come in share and are printed as percent, others in text as they
    are. A report is one text, so it is as long as its run's documents need.
    """
    # headings and labels are fixed values
    own = F.concat_ws("\n", F.concat(F.lit("### "), "name"), F.concat(F.lit("- Type: "), F.coalesce("doc_type", F.lit("unknown"))), F.concat(F.lit("- Method: "), "method"), F.concat(F.lit("- Confidence: "), percent_text(F.col("confidence"))), F.lit(""))
    blocks = documents.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", own.alias("block")))), lambda x: x["block"]), "\n").alias("docs"))
    line = F.concat(F.lit("- "), "name", F.lit(": "), F.coalesce(percent_text(F.col("share")), F.col("text")))
    counts = statistics.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))), lambda x: x["line"]), "\n").alias("stats"))
    head = F.concat_ws("\n", F.lit("# Document Extraction Results"), F.lit(""), F.concat(F.lit("**Processing Time**: "), F.format_string("%.2fs", "seconds")), F.concat(F.lit("**Method**: "), F.col("_method")), F.lit(""), F.lit("## Documents Processed"), F.lit(""))
    report = F.concat_ws("\n", head, F.col("docs"), F.concat(F.lit("## Statistics\n\n"), F.col("stats"), F.lit("\n")))
    every = runs.select(key, F.col("method").alias("_method"), "seconds").join(blocks, key, "left").join(counts, key, "left")
    return every.select(key, report.alias("report"))


def write_report(reports: DataFrame, folder: str) -> None:
    reports.select("report").write.mode("append").text(folder)


def load_mappings(spark: SparkSession, folder: str) -> DataFrame:
    """(form_id, pdf_field, source_field, type, transform, required, version) of the mapping files of a folder.

    A form's file is ``<form>.json``, else ``<form>_mapping.json``, else ``<form>_dynamic.json``. A file with fields instead of
    mappings maps each field to itself. The version is 1.0 where none is given.
    """
    files = spark.read.schema(MAPPING).option("multiLine", "true").json(folder).withColumn("_stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    form = F.regexp_replace("_stem", "_(mapping|dynamic)$", "")
    rank = F.when(F.col("_stem").endswith("_mapping"), 1).when(F.col("_stem").endswith("_dynamic"), 2).otherwise(0)
    best = Window.partitionBy("form_id").orderBy("_rank")
    files = files.withColumn("form_id", form).withColumn("_rank", rank).withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return mapping_rows(files)


def mapping_rows(files: DataFrame) -> DataFrame:
    """The same from rows (form_id, version, mappings, fields)."""
    version = F.coalesce("version", F.lit("1.0")).alias("version")
    mapped = files.select("form_id", version, F.explode("mappings").alias("pdf_field", "m")).select("form_id", "pdf_field", "m.source_field", F.coalesce("m.type", F.lit("text")).alias("type"), "m.transform", F.coalesce("m.required", F.lit(False)).alias("required"), "version")
    own = files.where("mappings is null").select("form_id", version, F.explode("fields").alias("pdf_field", "f"))
    own = own.select("form_id", "pdf_field", F.col("pdf_field").alias("source_field"), F.coalesce("f.field_type", F.lit("text")).alias("type"), F.lit(None).cast("string").alias("transform"), F.coalesce("f.required", F.lit(False)).alias("required"), "version")
    return mapped.unionByName(own)


#: Names under which layouts list their fields and lines, and the roles of single texts.
FIELD_LISTS, LINE_LIST = r"(^|_)fields$", "line_items"


def load_layouts(spark: SparkSession, folder: str) -> DataFrame:
    """(layout, section, subsection, ord, line, description, field, role) of layout files, at any depth.

    Role is field for the items of lists whose names end in fields, line_item for those of line_items, total, subtotal or
    calculation for single texts of these names (total with any word before it). subsection is the path below the section, joined by ``/``; ord counts from 0.
    """
    level = spark.read.option("wholetext", "true").text(folder).select(F.try_parse_json("value").alias("v"), F.array().cast("array<string>").alias("path"))
    out = []
    while True:
        level = spark.sql("SELECT array_append(d.path, coalesce(t.key, cast(t.pos AS string))) AS path, t.value AS v FROM {d} AS d, LATERAL variant_explode(d.v) AS t", d=level)
        level = saved(level.withColumn("nested", F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")))
        out.append(level)
        if level.where("nested").isEmpty():
            break
        level = level.where("nested").select("path", "v")
    every = reduce(DataFrame.unionByName, out)
    text = lambda p: F.try_variant_get("v", p, "string")
    name, last = F.get("path", F.size("path") - 2), F.element_at("path", -1)
    items = every.where(F.size("path") > 3).where(name.rlike(FIELD_LISTS) | (name == LINE_LIST)).where(last.rlike(r"^\d+$"))
    items = items.select(F.slice("path", F.lit(1), F.size("path") - 2).alias("path"), last.cast("int").alias("ord"), text("$.line").alias("line"), F.coalesce(text("$.description"), text("$.label")).alias("description"),
                         F.when(F.col("nested"), text("$.field")).otherwise(text("$")).alias("field"), F.when(name == LINE_LIST, "line_item").otherwise("field").alias("role"))
    role = F.when(last == "subtotal", "subtotal").when(last == "calculation", "calculation").when(last.rlike(r"(^|_)total$"), "total")
    single = every.where(~F.col("nested") & role.isNotNull() & (F.size("path") > 2))
    nothing = F.lit(None).cast("string")
    single = single.select(F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), F.lit(None).cast("int").alias("ord"), nothing.alias("line"), text("$").alias("description"), nothing.alias("field"), role.alias("role"))
    rows = items.unionByName(single)
    below = F.array_join(F.slice("path", F.lit(3), F.size("path")), "/")
    return rows.select(F.get("path", F.lit(0)).alias("layout"), F.get("path", F.lit(1)).alias("section"), F.nullif(below, F.lit("")).alias("subsection"), "ord", "line", "description", "field", "role")
