"""A query for each operator over the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import values as V
from ledgerleaf.operators import evaluate, forms, mapping, merge, planning, reconcile, registry, replies, routing, schema
from ledgerleaf.plans import catalog
from ledgerleaf.plans.bridge import ctes, records, table
from ledgerleaf.session import saved, shared_folder
from ledgerleaf.sources import files as files_source
from ledgerleaf.sources import sinks
from ledgerleaf.streaming import rates
from ledgerleaf.streaming.intake import Registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = 1_700_000.0


def query(*views: str, sql: str | None = None, names: tuple[str, ...] = ("applicant",)) -> Callable:
    """Registers a function of the tables or views ``views``, or of (spark, sf_dir) without them; ``sql`` selects from ``views``, or from ``names``."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[table(spark, sf_dir, v) for v in views]) if views else f(spark, sf_dir)
        if sql:
            with_ = ctes(*views or names)
            head = with_ if with_.strip() != "WITH RECURSIVE" else ""
            body = sql.strip()
            body = body.replace("count_if(", "count(*) FILTER (WHERE ")  # a sum of 128 bits in DuckDB
            ORACLE[f.__name__] = head + body if head else ("WITH RECURSIVE" + body[1:] if body.startswith(",") else body)
        return f

    return register


# scans, sources, sinks


@query("files", "labels", sql="""
SELECT l.doc_id, EXISTS (SELECT 1 FROM files f WHERE f.doc_id = l.doc_id AND f.doc_id % 3 <> 0) AS found FROM labels l""")
def s3_requested(files: DataFrame, labels: DataFrame) -> DataFrame:
    asked = labels.select(F.col("doc_id").cast("string").alias("path"), "doc_id")
    there = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).otherwise(-F.col("doc_id") - 1)  # the others have moved
    found, missing = files_source.match_requested(asked, files.select(there.cast("string").alias("path")))
    return found.select("doc_id", F.lit(True).alias("found")).unionByName(missing.select("doc_id", F.lit(False).alias("found")))


@query("files", sql=r"SELECT path, length, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS ext, length / 1048576.0::DOUBLE AS mb FROM files")
def s4_file_meta(files: DataFrame) -> DataFrame:
    return files_source.file_meta(files.select("path", "length"))


@query("sheet", sql="""
, few AS (SELECT * FROM sheet WHERE sheet_idx < 5), good AS (SELECT doc_id, sheet_idx FROM few GROUP BY ALL HAVING max("row") + 1 >= 2)
SELECT f.doc_id, f.sheet_idx, f."row", 'Col_' || f."col" AS "column", f.value, CAST(NULL AS VARCHAR) AS error FROM few f JOIN good USING (doc_id, sheet_idx)
UNION ALL SELECT DISTINCT doc_id, NULL, NULL, NULL, NULL, 'no usable sheet' FROM sheet WHERE doc_id NOT IN (SELECT doc_id FROM good)""")
def s5_sheets(sheet: DataFrame) -> DataFrame:
    return files_source.select_sheets(sheet).select("doc_id", "sheet_idx", "row", "column", "value", "error")


@query("files", sql="SELECT app_id AS doc_id, ord AS page_no FROM files QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY ord) <= 10")
def s6_page_cap(files: DataFrame) -> DataFrame:
    return files_source.cap_pages(files.select(F.col("app_id").alias("doc_id"), F.col("ord").alias("page_no")))


@query("files", sql="SELECT doc_id, substr(content, 1, 2000) AS text FROM files")
def s7_text_prefix(files: DataFrame) -> DataFrame:
    return files_source.text_prefix(files).select("doc_id", "text")


@query("files", sql="SELECT app_id, CAST(json_object('app_id', app_id, 'doc_id', doc_id, 'path', path) AS VARCHAR) AS json FROM files")
def s8_json_documents(files: DataFrame) -> DataFrame:
    return sinks.as_json(files.select("app_id", "doc_id", "path"), "app_id")


_REPORTED = "CASE WHEN lower(path) LIKE '%pfs%' THEN 'pfs' WHEN lower(path) LIKE '%debt%' AND lower(path) LIKE '%schedule%' THEN 'debt_schedule' WHEN lower(path) LIKE '%sba%' THEN 'sba_forms' WHEN lower(path) LIKE '%tax%' OR lower(path) LIKE '%return%' THEN 'tax_returns' END"


@query("files", sql=f"""
, t AS (SELECT app_id, path, seconds, pages, {_REPORTED} AS k FROM files),
g AS (SELECT app_id, sum(seconds) AS seconds, count(*) AS n, count(k) / count(*) AS typed, count(*) FILTER (WHERE pages > 0) / count(*) AS paged, sum(pages) AS pages,
 string_agg('### ' || path || chr(10) || '- Type: ' || coalesce(k, 'unknown') || chr(10) || '- Method: hybrid' || chr(10) || '- Confidence: ' || printf('%.2f%%', pages / 16 * 100) || chr(10), chr(10) ORDER BY path) AS docs FROM t GROUP BY 1)
SELECT app_id, '# Document Extraction Results' || chr(10) || chr(10) || '**Processing Time**: ' || printf('%.2fs', seconds) || chr(10) || '**Method**: hybrid' || chr(10) || chr(10) || '## Documents Processed' || chr(10) || chr(10) || docs || chr(10)
 || '## Statistics' || chr(10) || chr(10) || '- documents: ' || n || chr(10) || '- paged: ' || printf('%.2f%%', paged * 100) || chr(10) || '- pages: ' || CAST(pages AS BIGINT) || chr(10) || '- typed: ' || printf('%.2f%%', typed * 100) || chr(10) AS report FROM g""")
def s9_report(files: DataFrame) -> DataFrame:
    kind = routing.doc_type(F.col("path"))
    docs = files.select("app_id", F.col("path").alias("name"), kind.alias("doc_type"), F.lit("hybrid").alias("method"), (F.col("pages") / 16).alias("confidence"))
    own = files.groupBy("app_id").agg(F.count("*").alias("n"), F.sum("pages").alias("pages"), (F.count(kind) / F.count("*")).alias("typed"), (F.count_if(F.col("pages") > 0) / F.count("*")).alias("paged"))
    none = F.lit(None).cast("double")
    told = [("documents", none, F.col("n").cast("string")), ("pages", none, F.col("pages").cast("string")), ("typed", F.col("typed"), F.lit(None).cast("string")), ("paged", F.col("paged"), F.lit(None).cast("string"))]
    stats = own.select("app_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), share.alias("share"), text.alias("text")) for n, share, text in told])).alias("s")).select("app_id", "s.*")
    return sinks.report_lines(files.groupBy("app_id").agg(F.sum("seconds").alias("seconds")).withColumn("method", F.lit("hybrid")), docs, stats)


@query("annotation", sql="""
SELECT form_id, "T" AS pdf_field, CASE WHEN form_id % 2 = 0 THEN lower("T") ELSE "T" END AS source_field, max("FT") AS type, CASE WHEN form_id % 2 = 0 THEN 'uppercase' END AS transform, form_id % 2 = 0 AND max(page) > 3 AS required,
 CASE WHEN form_id % 2 = 0 THEN '2.1' ELSE '1.0' END AS version FROM annotation WHERE "T" <> '' AND "FT" IS NOT NULL GROUP BY 1, 2, 3, form_id""")
def s10_mapping_rows(annotation: DataFrame) -> DataFrame:
    """Forms with an even id come in the layout with mappings, others in the one with fields."""
    pairs = annotation.where("T <> '' and FT is not null").groupBy("form_id", "T").agg(F.max("FT").alias("kind"), F.max("page").alias("page"))
    ruled = F.struct(F.lower("T").alias("source_field"), F.col("kind").alias("type"), F.lit("uppercase").alias("transform"), (F.col("page") > 3).alias("required"))
    listed = lambda value: F.map_from_entries(F.collect_list(F.struct("T", value)))
    files = pairs.groupBy("form_id").agg(listed(ruled).alias("mappings"), listed(F.struct(F.col("kind").alias("field_type"), F.lit(False).alias("required"))).alias("fields"))
    even = F.col("form_id") % 2 == 0
    files = files.select("form_id", F.when(even, "2.1").alias("version"), F.when(even, F.col("mappings")).alias("mappings"), F.when(~even, F.col("fields")).alias("fields"))
    return sinks.mapping_rows(files)


# registry


@query("files", "registry", sql="""
, known AS (SELECT DISTINCT sha256(content) AS hash FROM registry)
SELECT sha256(content) AS hash, min(path) AS path FROM files WHERE sha256(content) NOT IN (SELECT hash FROM known) GROUP BY 1""")
def r2_new_contents(files: DataFrame, reg: DataFrame) -> DataFrame:
    latest = registry.with_hash(reg).groupBy("hash").agg(F.max("file_id").alias("file_id"))
    _, new = registry.split_new(registry.with_hash(files), latest)
    return new.select("hash", "path")


@query("files", "registry", sql="""
, known AS (SELECT sha256(content) AS hash, max(file_id) AS file_id FROM registry GROUP BY 1)
SELECT f.path, k.file_id FROM files f JOIN known k ON k.hash = sha256(f.content)""")
def r2_reused(files: DataFrame, reg: DataFrame) -> DataFrame:
    latest = registry.with_hash(reg).groupBy("hash").agg(F.max("file_id").alias("file_id"))
    cached, _ = registry.split_new(registry.with_hash(files), latest)
    return cached.select("path", "file_id")


@query("registry", sql="""
, o AS (SELECT sha256(content) AS hash, file_id, path, uploaded_at, 0 AS fresh FROM registry
 UNION ALL SELECT sha256(content), 'again-' || file_id, path || '.v2', uploaded_at - 1, 1 FROM registry WHERE uploaded_at % 3000 = 0)
SELECT hash, file_id, path FROM o QUALIFY row_number() OVER (PARTITION BY hash ORDER BY fresh DESC, uploaded_at DESC NULLS LAST, path DESC) = 1""")
def r2_upsert(reg: DataFrame) -> DataFrame:
    """A part of the contents is registered again, with an earlier time: the new entry takes the place of the old one."""
    hashed = registry.with_hash(reg).drop("content")
    again = hashed.where("uploaded_at % 3000 = 0").withColumn("file_id", F.concat(F.lit("again-"), "file_id")).withColumn("path", F.concat("path", F.lit(".v2"))).withColumn("uploaded_at", F.col("uploaded_at") - 1)
    return registry.upsert(hashed, again).select("hash", "file_id", "path")


@query("files", "registry", sql="""
, r AS (SELECT DISTINCT path, sha256(content) AS hash FROM registry WHERE content IS NOT NULL), f AS (SELECT DISTINCT path, sha256(content) AS hash FROM files WHERE content IS NOT NULL)
SELECT 0 AS batch, path, 'file-' || substr(sha256(hash || ':0'), 1, 24) AS file_id, path = min(path) OVER (PARTITION BY hash) AS new FROM r
UNION ALL SELECT 1, path, 'file-' || substr(sha256(hash || CASE WHEN hash IN (SELECT hash FROM r) THEN ':0' ELSE ':1' END), 1, 24), hash NOT IN (SELECT hash FROM r) AND path = min(path) OVER (PARTITION BY hash) FROM f
UNION ALL SELECT 2, path, 'file-' || substr(sha256(hash || CASE WHEN hash IN (SELECT hash FROM r) THEN ':0' ELSE ':1' END), 1, 24), false FROM f""")
def r2_registry(files: DataFrame, reg: DataFrame) -> DataFrame:
    """Three batches into a stored registry, made a base after the second; the second comes twice, and its files come again as the third."""
    store = Registry(files.sparkSession, f"{shared_folder(files.sparkSession)}/registry-{uuid.uuid4().hex}")
    store.absorb(reg.select("path", "content"), 0, NOW)
    for batch in (1, 1, 2):
        store.absorb(files.select("path", "content"), batch, NOW)
        store.compact()
    return store.seen().select("batch", "path", "file_id", "new")


@query("files", sql=r"""
SELECT path, CASE lower(regexp_extract(path, '\.([^./]+)$', 1)) WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'txt' THEN 'text/plain'
 WHEN 'xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN 'xls' THEN 'application/vnd.ms-excel' ELSE 'application/octet-stream' END AS mime_type FROM files""")
def r3_mime(files: DataFrame) -> DataFrame:
    return files.select("path", V.mime_type(V.extension(F.col("path"))).alias("mime_type"))


@query("files", "registry", sql="SELECT doc_id, (SELECT max(file_id) FROM registry r WHERE sha256(r.content) = sha256(f.content)) AS file_id FROM files f")
def r4_lookup(files: DataFrame, reg: DataFrame) -> DataFrame:
    return registry.lookup(registry.with_hash(files), registry.with_hash(reg)).select("doc_id", "file_id")


@query("registry", "labels", sql="SELECT file_id, path FROM registry WHERE file_id NOT IN (SELECT 'file-' || (doc_id % 400) FROM labels WHERE toxic = 1)")
def r5_delete(reg: DataFrame, labels: DataFrame) -> DataFrame:
    gone = labels.where("toxic = 1").select(F.concat(F.lit("file-"), (F.col("doc_id") % 400).cast("string")).alias("file_id"))
    return registry.drop_ids(reg, gone).select("file_id", "path")


@query("registry", sql=f"SELECT path FROM registry WHERE NOT coalesce(uploaded_at, 0) < {NOW} - 7 * 86400")
def r6_retention(reg: DataFrame) -> DataFrame:
    return registry.expire(reg, NOW).select("path")


@query("registry", sql="SELECT count(*) AS entries, sum(coalesce(size, 0)) / 1048576.0::DOUBLE AS total_mb FROM registry")
def r7_statistics(reg: DataFrame) -> DataFrame:
    return registry.stats(reg)


@query("files", sql="SELECT path, md5(concat_ws('_', path, ord::VARCHAR, length::VARCHAR)) AS key FROM files")
def r8_cache_key(files: DataFrame) -> DataFrame:
    return files.select("path", V.cache_key(F.col("path"), F.col("ord"), F.col("length")).alias("key"))


@query("files", sql="""
, s AS (SELECT app_id AS template_id, CASE WHEN app_id % 2 = 0 THEN md5(min(content)) ELSE min(md5(content || '?')) END AS stored FROM files WHERE app_id % 3 <> 1 GROUP BY app_id), t AS (SELECT app_id AS template_id, min(content) AS content FROM files GROUP BY 1)
SELECT template_id, md5(content) <> stored AS changed FROM t LEFT JOIN s USING (template_id)""")
def r9_drift(files: DataFrame) -> DataFrame:
    """Templates that are as stored, that have changed, and (a third of them) that were never stored."""
    own = F.min(F.md5(F.concat("content", F.lit("?")).cast("binary")))
    stored = files.groupBy(F.col("app_id").alias("template_id")).agg(F.when(F.col("template_id") % 2 == 0, F.md5(F.min("content").cast("binary"))).otherwise(own).alias("md5")).where("template_id % 3 <> 1")
    return registry.drift(files.groupBy(F.col("app_id").alias("template_id")).agg(F.min("content").alias("content")), stored).select("template_id", "changed")


@query("orders", sql="SELECT o_orderkey AS dataset_id FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def r10_recent(orders: DataFrame) -> DataFrame:
    now = orders.agg(F.max("o_orderdate").alias("now"))
    rows = orders.select(F.col("o_orderkey").alias("dataset_id"), F.col("o_orderdate").alias("created"), F.lit(1).alias("_one")).join(F.broadcast(now.withColumn("_one", F.lit(1))), "_one")
    return registry.keep_recent(rows, F.col("now")).select("dataset_id")


# routing

_TYPE = "CASE WHEN lower(path) LIKE '%pfs%' OR lower(path) LIKE '%personal\\_financial%' ESCAPE '\\' THEN 'pfs' WHEN lower(path) LIKE '%debt%' AND lower(path) LIKE '%schedule%' THEN 'debt_schedule' WHEN lower(path) LIKE '%sba%' THEN 'sba_forms' WHEN lower(path) LIKE '%tax%' OR lower(path) LIKE '%return%' THEN 'tax_returns' END"


@query("files", sql=f"SELECT doc_id, {_TYPE} AS doc_type, coalesce({_TYPE}, 'mixed') AS output_group FROM files")
def c1_document_type(files: DataFrame) -> DataFrame:
    kind = routing.doc_type(F.col("path"))
    return files.select("doc_id", kind.alias("doc_type"), routing.output_group(kind).alias("output_group"))


@query("files", sql=f", t AS (SELECT app_id, ord, {_TYPE} AS k FROM files) SELECT app_id, coalesce(arg_min(k, ord) FILTER (WHERE k IS NOT NULL), 'mixed') AS package_type FROM t GROUP BY 1")
def c2_package_type(files: DataFrame) -> DataFrame:
    return routing.package_type(files)


@query("files", sql="""
, t AS (SELECT app_id, ord, CASE WHEN lower(path) LIKE '%src1%' THEN 'one' WHEN lower(path) LIKE '%src7/pfs%' THEN 'seven' END AS k, CASE WHEN app_id % 9 = 0 THEN 'Ann Lee' END AS first, CASE WHEN app_id % 9 = 0 THEN 'Ray' END AS last FROM files)
SELECT app_id, coalesce(max(lower(replace(first || '_' || last, ' ', '_'))), arg_min(k, ord) FILTER (WHERE k IS NOT NULL), 'unknown') AS owner FROM t GROUP BY 1""")
def c4_owner(files: DataFrame) -> DataFrame:
    named = files.withColumn("first", F.when(F.col("app_id") % 9 == 0, "Ann Lee")).withColumn("last", F.when(F.col("app_id") % 9 == 0, "Ray"))
    return routing.owner(named, [("src1", "one"), ("src7/pfs", "seven")])


@query("files", sql=r"SELECT doc_id, CASE lower(regexp_extract(path, '(\.[^./]+)$', 1)) WHEN '.pdf' THEN 'pdf' WHEN '.xlsx' THEN 'excel' WHEN '.xls' THEN 'excel' WHEN '.png' THEN 'raster' WHEN '.jpg' THEN 'raster' ELSE 'unknown' END AS format FROM files")
def c5_format(files: DataFrame) -> DataFrame:
    return files.select("doc_id", routing.format_class(F.col("path")).alias("format"))


@query("files", sql=r"""
, f AS (SELECT *, lower(path) LIKE '%.pdf' AS pdf FROM files WHERE doc_id % 3 <> 0), b AS (
  SELECT DISTINCT app_id, -1 AS ord, 'prompt' AS kind, CAST(NULL AS BIGINT) AS doc_id, 0 AS page_no FROM f
  UNION ALL SELECT app_id, ord, 'document', doc_id, 0 FROM f WHERE pdf
  UNION ALL SELECT app_id, ord, 'image', doc_id, p.n FROM f, (SELECT unnest(range(1, 4)) AS n) p WHERE NOT pdf AND p.n <= doc_id % 4)
SELECT app_id, CAST(row_number() OVER (PARTITION BY app_id ORDER BY ord, doc_id, page_no) AS INT) AS block_no, kind, doc_id, CAST(page_no AS INT) AS page_no FROM b""")
def c6_blocks(files: DataFrame) -> DataFrame:
    sent = files.withColumn("file_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string")))
    pages = files.where("doc_id % 4 > 0").select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 4).cast("int"))).alias("page_no"))
    return routing.block_plan(sent, pages)


@query("part", sql="SELECT p_partkey, CASE WHEN contains(p_name, 'a') THEN 'first' WHEN contains(p_name, 'e') THEN 'second' ELSE 'second' END AS template, CASE WHEN contains(p_name, 'red') THEN 'red' END AS strict FROM part")
def c7_template(part: DataFrame) -> DataFrame:
    rows = part.select("p_partkey", F.col("p_name").alias("name"))
    one = routing.pick_template(rows, [("a", "first"), ("e", "second")], "second")
    return routing.pick_template(one.withColumnRenamed("template", "loose"), [("red", "red")], None).select("p_partkey", F.col("loose").alias("template"), F.col("template").alias("strict"))


_SECTION = """CASE WHEN regexp_matches(lower(field_name), 'name|ssn|social|birth|phone|email|address|city|state|zip|marital|citizen') THEN 'Personal Information'
 WHEN regexp_matches(lower(field_name), 'business|company|ownership|ein|entity|corporation|llc|partnership') THEN 'Business Information'
 WHEN regexp_matches(lower(field_name), 'asset|liability|income|expense|worth|financial|bank|loan|mortgage|debt') THEN 'Financial Information' ELSE 'Additional Information' END"""


@query("annotation", sql=f""", f AS (SELECT form_id, "T" AS field_name FROM annotation)
SELECT form_id, {_SECTION} AS section, string_agg(field_name, '|' ORDER BY field_name) AS names FROM f GROUP BY 1, 2""")
def c8_sections(annotation: DataFrame) -> DataFrame:
    return routing.classify_sections(annotation.select("form_id", F.col("T").alias("field_name"))).select("form_id", "section", F.array_join("field_names", "|").alias("names"))


# planning


@query("files", sql="SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY app_id ORDER BY ord) - 1) / 2) AS BIGINT) AS batch_ord FROM files")
def p1_batches(files: DataFrame) -> DataFrame:
    return planning.assign_batches(files, "app_id", "ord", 2).select("doc_id", "batch_ord")


@query("files", sql="SELECT app_id, CAST(sum((strlen(content) + 2) // 3 * 4) // 3 AS BIGINT) AS tokens, CASE WHEN sum((strlen(content) + 2) // 3 * 4) // 3 > 30000 THEN 'warn' ELSE 'ok' END AS estimate FROM files GROUP BY 1")
def p3_payload_tokens(files: DataFrame) -> DataFrame:
    return planning.tokens_by_payload(files, "app_id").withColumn("estimate", planning.risk_band(F.col("tokens"), "estimate"))


@query("files", sql="""
, g AS (SELECT app_id, count_if(doc_id % 3 <> 0) AS documents, count_if(doc_id % 3 = 0) AS missing, CAST(coalesce(sum(pages) FILTER (WHERE doc_id % 3 <> 0), 0) AS BIGINT) AS pages, coalesce(sum(length) FILTER (WHERE doc_id % 3 <> 0), 0) / 1048576.0::DOUBLE AS mb FROM files GROUP BY 1)
SELECT *, CAST(floor(pages * 1.2::DOUBLE) AS BIGINT) AS images, pages * 1500 AS tokens, CASE WHEN pages * 1500 > 25000 THEN 'HIGH' WHEN pages * 1500 > 20000 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM g""")
def p5_plan_totals(files: DataFrame) -> DataFrame:
    plan = files.select("app_id", F.col("path").alias("name"), F.col("pages").alias("est_pages"))
    there = F.when(F.col("doc_id") % 3 != 0, F.col("path")).otherwise(F.concat("path", F.lit(".moved")))
    return planning.plan_totals(plan, files.select(there.alias("name"), "length"))


#: Requests of a minute or so for each ten events: tokens of the replies, at times that come out of order.
_USAGE = """, usage AS (SELECT CAST(app_id % 20 AS VARCHAR) AS account, make_timestamp((1700000000 + event_id * 3 - CASE WHEN event_id % 50 = 0 THEN 900 ELSE event_id % 7 * 5 END) * 1000000) AS time, 20 * (coalesce(input_tokens, 0) + output_tokens) AS tokens FROM reply),
w AS (SELECT account, time_bucket(INTERVAL 10 SECOND, time) - INTERVAL (k * 10) SECOND AS start, tokens FROM usage, range(6) r(k)),
s AS (SELECT account, start, start + INTERVAL 60 SECOND AS "end", CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS requests FROM w GROUP BY ALL)
SELECT *, CASE WHEN tokens > 25000 THEN 'HIGH' WHEN tokens > 20000 THEN 'MEDIUM' ELSE 'LOW' END AS risk, tokens > 30000 AS over FROM s"""


def _usage(reply: DataFrame) -> DataFrame:
    behind = F.when(F.col("event_id") % 50 == 0, 900).otherwise(F.col("event_id") % 7 * 5)
    return reply.select("event_id", (F.col("app_id") % 20).cast("string").alias("account"), F.timestamp_seconds(1700000000 + F.col("event_id") * 3 - behind).alias("time"), (20 * (F.coalesce("input_tokens", F.lit(0)) + F.col("output_tokens"))).alias("tokens"))


@query("reply", sql=_USAGE)
def p4_token_rates(reply: DataFrame) -> DataFrame:
    """Tokens of each account in sliding minutes, against the service's limit."""
    return rates.token_rates(_usage(reply))


@query("reply", sql=_USAGE)
def p4_rate_stream(reply: DataFrame) -> DataFrame:
    """The same from usage that comes in four batches, some of it late: closed windows, open ones and what came late, together."""
    spark, usage = reply.sparkSession, _usage(reply)
    log = rates.RateLog(spark, f"{shared_folder(spark)}/rates-{uuid.uuid4().hex}")
    least, most = usage.agg(F.min("event_id"), F.max("event_id")).first()
    for n in range(4 if least is not None else 0):
        log.absorb(usage.where(F.floor((F.col("event_id") - least) * 4 / (most - least + 1)) == n).drop("event_id"), n)
    return log.whole()


@query("files", sql=", r AS (SELECT doc_id, CAST(sum(pages) OVER (PARTITION BY app_id ORDER BY ord) AS BIGINT) AS running_pages FROM files) SELECT * FROM r WHERE running_pages <= 50")
def p6_page_budget(files: DataFrame) -> DataFrame:
    return planning.page_budget(files).select("doc_id", "running_pages")


@query("files", sql=r"""
, k AS (SELECT app_id, path, CASE WHEN path LIKE '%.pdf' THEN 0 ELSE 1 END AS k FROM files WHERE path LIKE '%.pdf' OR path LIKE '%.xlsx'),
n AS (SELECT * FROM k QUALIFY k = 1 OR row_number() OVER (PARTITION BY app_id, k ORDER BY path) <= 3)
SELECT app_id, path, CAST(row_number() OVER (PARTITION BY app_id ORDER BY k, path) AS INT) AS pick FROM n QUALIFY pick <= 4""")
def p7_sample(files: DataFrame) -> DataFrame:
    return planning.sample_kinds(files_source.file_meta(files)).select("app_id", "path", "pick")


@query("part", sql="""
, s AS (SELECT p_partkey, CAST(p_partkey % 3000 + 1 AS INT) AS width, CAST(p_size * 60 AS INT) AS height FROM part),
u AS (SELECT *, CASE WHEN greatest(width, height) < 1024 THEN 1024::DOUBLE / greatest(width, height) ELSE 1 END AS k FROM s),
w AS (SELECT p_partkey, trunc(width * k)::INT AS w, trunc(height * k)::INT AS h FROM u), d AS (SELECT *, CASE WHEN greatest(w, h) > 1900 THEN 1900::DOUBLE / greatest(w, h) ELSE 1 END AS k FROM w),
n AS (SELECT p_partkey, trunc(w * k)::INT AS new_width, trunc(h * k)::INT AS new_height FROM d)
SELECT *, greatest(new_width, new_height) > 1800 AS large, greatest(new_width, new_height) > 2000 AS too_large FROM n""")
def p8_image_sizes(part: DataFrame) -> DataFrame:
    pages = part.select("p_partkey", (F.col("p_partkey") % 3000 + 1).cast("int").alias("width"), (F.col("p_size") * 60).cast("int").alias("height"))
    return planning.image_size_plan(pages).drop("width", "height")


# replies

_EXTRACT = """trim(CASE WHEN strpos(reply, '```json') > 0 THEN CASE WHEN strpos(substr(reply, strpos(reply, '```json') + 7), '```') > 0 THEN split_part(substr(reply, strpos(reply, '```json') + 7), '```', 1) ELSE reply END
 WHEN strpos(reply, '```') > 0 THEN CASE WHEN starts_with(split_part(reply, '```', 2), 'json') THEN substr(split_part(reply, '```', 2), 5) ELSE split_part(reply, '```', 2) END ELSE reply END)"""
_FILLER = "trim(CASE WHEN starts_with(reply, '```') THEN CASE WHEN starts_with(split_part(reply, '```', 2), 'json') THEN substr(split_part(reply, '```', 2), 5) ELSE split_part(reply, '```', 2) END ELSE reply END)"


@query("reply", sql=f"SELECT event_id, {_EXTRACT} AS extractor, {_FILLER} AS filler FROM reply")
def x2_fences(reply: DataFrame) -> DataFrame:
    return reply.select("event_id", replies.strip_fence(F.col("reply")).alias("extractor"), replies.strip_fence(F.col("reply"), "filler").alias("filler"))


@query("reply", sql=f"SELECT event_id, NOT (json_valid({_EXTRACT}) AND coalesce(TRY(json_type({_EXTRACT})), '') = 'OBJECT') AS failed, CASE WHEN event_id % 7 IN (2, 4, 5) THEN 'JSON parse error: ' || substr(reply, 1, 100) END AS error FROM reply")
def x4_parse(reply: DataFrame) -> DataFrame:
    return replies.parse_reply(reply.drop("failed", "error")).select("event_id", "failed", "error")


@query("reply", sql="""SELECT event_id, CASE WHEN error IS NULL THEN NULL WHEN error LIKE '%2000 pixels%' THEN 'size' WHEN lower(error) LIKE '%rate%' OR error LIKE '%429%' THEN 'rate' WHEN error LIKE '%413%' THEN 'payload' WHEN lower(error) LIKE '%timeout%' THEN 'timeout' ELSE 'other' END AS images,
 CASE WHEN error IS NULL THEN NULL WHEN error LIKE '%413%' OR error LIKE '%too large%' THEN 'payload' WHEN lower(error) LIKE '%rate%' OR error LIKE '%429%' THEN 'rate' WHEN lower(error) LIKE '%timeout%' THEN 'timeout' ELSE 'other' END AS files FROM reply""")
def x5_error_class(reply: DataFrame) -> DataFrame:
    return reply.select("event_id", replies.error_class(F.col("error")).alias("images"), replies.error_class(F.col("error"), "files").alias("files"))


@query("reply", sql="SELECT app_id, CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS BIGINT) AS total_tokens, CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS BIGINT) / nullif(sum(seconds), 0) AS tokens_per_second FROM reply GROUP BY 1")
def x6_usage(reply: DataFrame) -> DataFrame:
    return replies.usage(reply)


@query("files", sql="SELECT app_id, count(*) AS documents, CAST(sum(pages) AS BIGINT) AS images, CAST(sum(length) AS BIGINT) / 1048576.0::DOUBLE AS mb, count(*) / nullif(sum(seconds), 0) AS docs_per_second, sum(pages) = 0 AS failed FROM files GROUP BY 1")
def x7_run_metadata(files: DataFrame) -> DataFrame:
    return replies.run_metadata(files)


def _payloads(batch: DataFrame) -> DataFrame:
    text = F.format_string('{"k":%d,"_note":1,"s":"%s","p":{"x":%d,"flag":%s,"in":%s},"_p":{"x":5}}', "batch_ord", "status", "x", F.col("flag").cast("string"), F.when(F.col("has_inner"), F.concat(F.lit('{"t":"'), "inner_text", F.lit('"}'))).otherwise("{}"))
    return batch.select("app_id", "batch_ord", F.try_parse_json(text).alias("payload"))


@query("batch", sql="""SELECT app_id, batch_ord, 'k' AS key, CAST(batch_ord AS VARCHAR) AS value FROM batch UNION ALL SELECT app_id, batch_ord, 's', '"' || status || '"' FROM batch
UNION ALL SELECT app_id, batch_ord, 'p', '{"flag":' || flag || ',"in":' || CASE WHEN has_inner THEN '{"t":"' || inner_text || '"}' ELSE '{}' END || ',"x":' || x || '}' FROM batch""")
def x8_control_keys(batch: DataFrame) -> DataFrame:
    return replies.drop_control_keys(_payloads(batch))


@query("reply", sql="SELECT app_id, count(*) AS total_batches, count_if(NOT failed) AS successful_batches, count_if(NOT failed) = 0 AS failed_all, CAST(sum(files) AS BIGINT) AS files FROM reply GROUP BY 1")
def x9_batch_outcome(reply: DataFrame) -> DataFrame:
    return replies.batch_outcome(reply)


@query("batch", sql="SELECT batch_ord, CAST(x AS BIGINT) AS x, flag, CAST(x AS BIGINT) AS gotten, CAST(NULL AS VARCHAR) AS absent FROM batch")
def x10_contract(batch: DataFrame) -> DataFrame:
    rows = replies.to_contract(_payloads(batch), "s string, p struct<x: bigint, flag: boolean>")
    return rows.select("batch_ord", "record.p.x", "record.p.flag", replies.get_path(F.col("payload"), "$.p.x", "bigint").alias("gotten"), replies.get_path(F.col("payload"), "$.s.x.y").alias("absent"))


@query("batch", sql="SELECT app_id, CAST(sum((batch_ord <> 0)::INT + (status <> '')::INT + (x <> 0)::INT + flag::INT + (has_inner AND inner_text <> '')::INT) AS BIGINT) AS data_points FROM batch GROUP BY 1")
def x12_data_points(batch: DataFrame) -> DataFrame:
    return replies.count_data_points(merge.leaves_of(_payloads(batch)))


@query("batch", sql="SELECT batch_ord, (status <> '')::INT + (x <> 0)::INT + flag::INT AS score FROM batch")
def x13_presence(batch: DataFrame) -> DataFrame:
    return _payloads(batch).select("batch_ord", replies.presence_score(F.col("payload"), ["$.s", "$.p.x", "$.p.flag", "$.q.z"]).alias("score"))


@query("applicant", sql="""SELECT app_id, CAST((coalesce(first, '') <> '' OR app_id % 4 <> 1)::INT + coalesce(ssn <> '', false)::INT + coalesce(own_pct <> 0, false)::INT + (legal_name <> '')::INT + (ein <> '')::INT + (affiliated <> 0)::INT
 + (cents <> 0)::INT + (app_id % 2 = 0)::INT + (app_id % 3 = 0 AND cents <> 0)::INT AS INT) AS score FROM applicant""")
def x13_complete(applicant: DataFrame) -> DataFrame:
    """The nine paths of a complete extraction, each of them absent, null or falsy in some records."""
    firm = F.struct("legal_name", "ein", F.col("affiliated").alias("annual_revenue"))
    sums = F.struct(F.struct(F.col("cents").alias("total_assets")).alias("assets"), F.struct((F.col("app_id") % 2 == 0).alias("total_liabilities")).alias("liabilities"), F.when(F.col("app_id") % 3 == 0, F.col("cents")).alias("net_worth"))
    name = F.coalesce(F.nullif(F.col("first"), F.lit("")), F.lit(""))
    person = F.struct(F.when(F.col("app_id") % 4 != 1, F.to_json(F.struct(name.alias("first")))).otherwise(name).alias("name"), "ssn", F.col("own_pct").alias("ownership_percentage"))
    record = F.struct(F.struct(person.alias("primary_applicant")).alias("personal"), F.struct(firm.alias("primary_business")).alias("business"), sums.alias("financials"))
    return applicant.select("app_id", replies.presence_score(F.parse_json(F.to_json(record))).alias("score"))


@query("applicant", sql="SELECT app_id, CASE WHEN app_id % 3 = 0 THEN NULL ELSE cents END AS total_assets, nullif(cents % 2, 0) AS total_liabilities, nullif(cents, 0) AS net_worth, coalesce(own_pct, 0) AS average_confidence FROM applicant")
def x14_application_row(applicant: DataFrame) -> DataFrame:
    docs = applicant.select("app_id", F.when(F.col("app_id") % 3 == 0, 0).otherwise(F.col("cents")).alias("total_assets"), (F.col("cents") % 2).alias("total_liabilities"), F.col("cents").alias("net_worth"), F.col("own_pct").alias("confidence"))
    return replies.application_row(docs)


# merge

_MERGED = """
, i AS (SELECT app_id, min(batch_ord) FILTER (WHERE has_inner) AS a, min(batch_ord) AS b FROM batch GROUP BY 1),
m AS (SELECT app_id, coalesce(min(batch_ord) FILTER (WHERE batch_ord <> 0), 0) AS k, coalesce(arg_min(status, batch_ord) FILTER (WHERE status <> ''), arg_min(status, batch_ord)) AS s,
 coalesce(arg_max(x, batch_ord) FILTER (WHERE x <> 0), arg_min(x, batch_ord)) AS x, coalesce(bool_or(flag), false) AS flag,
 coalesce(arg_max(inner_text, batch_ord) FILTER (WHERE has_inner AND inner_text <> ''), max(inner_text) FILTER (WHERE has_inner AND batch_ord = least(i.b, coalesce(i.a, i.b)))) AS t
 FROM batch JOIN i USING (app_id) GROUP BY 1)"""


@query("batch", sql=_MERGED + """
SELECT app_id, 'k' AS path, CAST(k AS VARCHAR) AS value FROM m UNION ALL SELECT app_id, 's', '"' || s || '"' FROM m UNION ALL SELECT app_id, 'p/x', CAST(x AS VARCHAR) FROM m
UNION ALL SELECT app_id, 'p/flag', CAST(flag AS VARCHAR) FROM m UNION ALL SELECT app_id, 'p/in/t', '"' || t || '"' FROM m WHERE t IS NOT NULL""")
def m1_deep_merge(batch: DataFrame) -> DataFrame:
    return merge.deep_merge(_payloads(batch)).select("app_id", F.array_join("path", "/").alias("path"), "value")


@query("batch", sql=_MERGED + """
SELECT app_id, '{"k":' || k || ',"p":{"flag":' || flag || ',"in":{' || CASE WHEN t IS NOT NULL THEN '"t":"' || t || '"' ELSE '' END || '},"x":' || x || '},"s":"' || s || '"}' AS record FROM m""")
def m2_deep_merge_exact(batch: DataFrame) -> DataFrame:
    return merge.merge_records(_payloads(batch))


@query("batch", sql="""
, b AS (SELECT *, app_id % 3 = 0 AND batch_ord % 5 = 1 AS scalar FROM batch), s AS (SELECT app_id, coalesce(max(batch_ord) FILTER (WHERE scalar), -1) AS last FROM b GROUP BY 1),
q AS (SELECT app_id, last, count(*) FILTER (WHERE batch_ord > last) AS objects, coalesce(arg_max(x % 4, batch_ord) FILTER (WHERE batch_ord > last AND x % 4 <> 0), arg_min(x % 4, batch_ord) FILTER (WHERE batch_ord > last)) AS d FROM b JOIN s USING (app_id) GROUP BY ALL)
SELECT app_id, '{"p":{"q":' || CASE WHEN objects = 0 THEN last::VARCHAR ELSE '{"d":' || d || '}' END || '}}' AS record FROM q""")
def m2_conflicts(batch: DataFrame) -> DataFrame:
    """In a third of the applications some batches have a number where others have an object: those are folded, the rest is merged as sets."""
    odd = (F.col("app_id") % 3 == 0) & (F.col("batch_ord") % 5 == 1)
    text = F.format_string('{"p":{"q":%s}}', F.when(odd, F.col("batch_ord").cast("string")).otherwise(F.concat(F.lit('{"d":'), (F.col("x") % 4).cast("string"), F.lit("}"))))
    return merge.merge_records(batch.select("app_id", "batch_ord", F.try_parse_json(text).alias("payload")))


@query("filled", sql="""SELECT app_id, count(*) AS total, count_if(value <> '') AS filled, count_if(value <> '') / count(*) * 100 AS fill_rate, count_if(value <> '' AND (boolean OR value IN ('Yes', 'No', '/Yes', '/No'))) AS checkboxes,
 count_if(value <> '' AND NOT (boolean OR value IN ('Yes', 'No', '/Yes', '/No'))) AS texts FROM filled GROUP BY 1""")
def m3_fill_report(filled: DataFrame) -> DataFrame:
    return merge.fill_report(filled)


_FIELDS = """, f AS (SELECT form_id, "T" AS field_name, CASE regexp_extract("FT", '[A-Za-z]+') WHEN 'Btn' THEN 'checkbox' WHEN 'Ch' THEN 'dropdown' WHEN 'Sig' THEN 'signature' ELSE CASE WHEN lower("T") LIKE '%date%' THEN 'date' ELSE 'text' END END AS field_type,
 ("Ff" & 2) <> 0 AS required, page, CASE WHEN regexp_extract("FT", '[A-Za-z]+') = 'Ch' THEN p_type END AS options FROM annotation WHERE "FT" IS NOT NULL AND "T" <> '' QUALIFY row_number() OVER (PARTITION BY form_id, "T" ORDER BY page DESC, ord DESC) = 1)"""


def _fields(annotation: DataFrame) -> DataFrame:
    return forms.fields_from_annotations(annotation.withColumn("Opt", F.array("p_type")))


@query("annotation", sql=_FIELDS + " SELECT form_id, count_if(field_type = 'text') AS text, count_if(field_type = 'checkbox') AS checkbox, count_if(field_type NOT IN ('text', 'checkbox')) AS other FROM f GROUP BY 1")
def m4_type_breakdown(annotation: DataFrame) -> DataFrame:
    return merge.type_breakdown(_fields(annotation))


@query("filled", sql="""
, g AS (SELECT app_id, CASE WHEN field_name IN ('Name', 'Email address') THEN 'Personal' WHEN field_name = 'Business Applicant Name' THEN 'Business' WHEN field_name = 'total_assets' THEN 'Financial' ELSE 'Other' END AS category, value FROM filled)
SELECT app_id, c.category, CASE c.category WHEN 'Personal' THEN 5 WHEN 'Business' THEN 3 END::INT AS listed, count_if(g.category = c.category AND value <> '') AS filled FROM g, (VALUES ('Personal'), ('Business'), ('Other')) c(category) GROUP BY 1, 2""")
def m5_coverage(filled: DataFrame) -> DataFrame:
    return merge.coverage(filled)


@query("filled", sql="SELECT app_id, form_id, CAST(GROUPING_ID(app_id, form_id) AS INT) AS level, count(DISTINCT (app_id, form_id)) AS forms, count(*) AS fields, count_if(value <> '') AS filled, count_if(value <> '') / count(*) * 100 AS completion FROM filled GROUP BY ROLLUP (app_id, form_id)")
def m6_application_summary(filled: DataFrame) -> DataFrame:
    return merge.application_summary(filled)


@query("filled", sql="""
, f AS (SELECT CASE WHEN app_id % 50 = 7 THEN NULL ELSE app_id END AS app_id, CASE WHEN field_name = 'Consent' AND app_id % 4 = 0 THEN NULL WHEN boolean THEN 10 + app_id % 2 ELSE app_id % 3 END AS form_id, value FROM filled),
e AS (SELECT app_id, form_id, count(*) AS fields, count_if(value <> '') AS filled FROM f GROUP BY ALL)
SELECT app_id, count(*) AS forms_processed, CAST(sum(fields) AS BIGINT) AS fields, CAST(sum(filled) AS BIGINT) AS filled, sum(filled) / sum(fields) * 100 AS completion,
 string_agg(coalesce(form_id::VARCHAR, 'none') || ':' || filled || '/' || fields, '|' ORDER BY form_id NULLS FIRST) AS forms FROM e GROUP BY app_id""")
def m6_application_records(filled: DataFrame) -> DataFrame:
    """Applicants with several forms each, some of them without an id, some applicants without one."""
    n = F.col("app_id")
    form = F.when((F.col("field_name") == "Consent") & (n % 4 == 0), None).when(F.col("boolean"), 10 + n % 2).otherwise(n % 3)
    rows = filled.select(F.when(n % 50 != 7, n).alias("app_id"), form.alias("form_id"), "value")
    named = F.transform("forms", lambda f: F.concat(F.coalesce(f["form_id"].cast("string"), F.lit("none")), F.lit(":"), f["filled"].cast("string"), F.lit("/"), f["fields"].cast("string")))
    return merge.application_records(rows).withColumn("forms", F.array_join(named, "|"))


@query("lineitem", sql="SELECT count(*) AS processed, count_if(l_quantity > 32) AS successful, count_if(l_quantity > 32) / count(*) * 100 AS success_rate, avg(l_quantity / 64) AS average_confidence FROM lineitem")
def m7_run_summary(lineitem: DataFrame) -> DataFrame:
    return merge.run_summary(lineitem.select((F.col("l_quantity") / 64).alias("confidence")))


# schema


@query("applicant", sql=r"""
, o AS (SELECT *, CASE WHEN app_id % 2 = 0 THEN substr(ssn, 1, 3) || '-' || substr(ssn, 4, 2) || '-' || substr(ssn, 6) ELSE ssn END AS number FROM applicant)
SELECT app_id AS record_id, 'business' AS kind, 'businessName' AS field, 'required' AS rule FROM o WHERE coalesce(legal_name, '') = ''
UNION ALL SELECT app_id, 'business', 'ein', 'pattern' FROM o WHERE NOT regexp_matches(ein, '^\d{2}-\d{7}$')
UNION ALL SELECT app_id, 'business', 'entityType', 'enum' FROM o WHERE entity_type = 'Corp'
UNION ALL SELECT app_id, 'owner', 'firstName', 'required' FROM o WHERE coalesce(first, '') = ''
UNION ALL SELECT app_id, 'owner', 'lastName', 'required' FROM o WHERE coalesce(last, '') = ''
UNION ALL SELECT app_id, 'owner', 'ssn', 'pattern' FROM o WHERE NOT regexp_matches(number, '^\d{3}-\d{2}-\d{4}$')
UNION ALL SELECT app_id, 'owner', 'email', 'email' FROM o WHERE email = 'no mail'""".replace("\\\\", "\\"))
def d6_validation(applicant: DataFrame) -> DataFrame:
    fields = catalog.model_fields(applicant.sparkSession)
    ssn = F.when(F.col("app_id") % 2 == 0, F.concat_ws("-", F.substring("ssn", 1, 3), F.substring("ssn", 4, 2), F.substring("ssn", 6, 4))).otherwise(F.col("ssn"))
    business = applicant.select("app_id", F.col("legal_name").alias("businessName"), "ein", F.col("entity_type").alias("entityType"))
    owner = applicant.select("app_id", F.col("first").alias("firstName"), F.col("last").alias("lastName"), F.when(F.col("ssn").isNotNull(), ssn).alias("ssn"), "email")
    out = []
    for kind, model, wide in (("business", "BusinessMetadata", business), ("owner", "BeneficialOwnerMetadata", owner)):
        long = schema.unpivoted(wide, "app_id", wide.columns[1:]).where("value is not null")  # what is null isn't there at all
        out.append(schema.validate(long, fields, model).withColumn("kind", F.lit(kind)))
    return out[0].unionByName(out[1])


_LISTED = ", ".join(f"('{f}', '{'|'.join(x)}')" for f, x in catalog.ALIASES.items())


@query("part", sql=f"""
, n AS (SELECT DISTINCT replace(lower(p_brand), '#', '_') AS f FROM part), s AS (SELECT f, replace(f, '_', ' ') AS b FROM n)
SELECT f AS field, array_to_string(list_sort(list_distinct([f, b, replace(f, '_', ''), upper(b[1]) || substr(b, 2), 'total ' || b, b || ' total', 'annual ' || b, b || ' amount', b || ' value'])), '|') AS hints FROM s
UNION ALL SELECT * FROM (VALUES {_LISTED}) l(field, hints)""")
def d7_alias_hints(part: DataFrame) -> DataFrame:
    """Generated hints for fields named by brand, and the listed ones of every field that has some."""
    listed = catalog.aliases(part.sparkSession)
    names = part.select(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")).alias("field")).unionByName(listed.select("field"))
    return schema.alias_hints(names, listed).select("field", F.array_join("hints", "|").alias("hints"))


@query("conversations", sql="""SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'net_worth' WHEN 2 THEN 'first_name' WHEN 3 THEN 'business_name' END AS field FROM conversations""")
def d8_label_match(conversations: DataFrame) -> DataFrame:
    label = F.element_at(F.array(F.lit(" E-Mail "), F.lit("equity"), F.lit("Name"), F.lit("DBA"), F.lit("nothing")), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    hints = schema.alias_hints(catalog.aliases(conversations.sparkSession), catalog.aliases(conversations.sparkSession))
    return schema.match_labels(conversations.select("conv_id", "turn", label.alias("label")), hints).select("conv_id", "turn", "field")


_HINTS = [(n, field, pos, hint) for n, (field, pos, hint) in enumerate((f, p, h) for f, listed in catalog.ALIASES.items() for p, h in enumerate(listed))]
_ALLOWED = "CASE WHEN length({0}) < 4 THEN 0 WHEN length({0}) < 8 THEN 1 ELSE 2 END"


@query("customer", sql=f"""
, h AS (SELECT * FROM (VALUES {", ".join(f"({n}, '{f}', {p}, '{x}')" for n, f, p, x in _HINTS)}) v(n, field, pos, hint)), b AS (SELECT hint, min({{'pos': pos, 'field': field}}) AS best FROM h GROUP BY 1),
e AS (SELECT c_custkey, hint, CAST(c_custkey // 7 % length(hint) AS INT) AS i FROM customer JOIN h ON n = c_custkey % {len(_HINTS)}),
l AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN ' ' || upper(hint) WHEN 1 THEN substr(hint, 1, i) || substr(hint, i + 2) WHEN 2 THEN substr(hint, 1, i) || 'x' || substr(hint, i + 1) WHEN 3 THEN substr(hint, 1, i) || 'qz' || substr(hint, i + 3)
 WHEN 4 THEN substr(hint, 1, i) || substr(hint, i + 4) END AS label FROM e),
k AS (SELECT DISTINCT lower(trim(label)) AS key FROM l WHERE label IS NOT NULL), d AS (SELECT key, hint, best, levenshtein(key, hint) AS distance FROM k, b),
m AS (SELECT key, min({{'distance': distance, 'pos': best.pos, 'field': best.field, 'hint': hint}}) AS m FROM d WHERE distance <= {_ALLOWED.format("hint")} GROUP BY 1)
SELECT c_custkey, m.field, m.hint, CAST(m.distance AS INT) AS distance FROM l LEFT JOIN m ON key = lower(trim(label))""")
def d8_near_labels(customer: DataFrame) -> DataFrame:
    """A label for each customer: a hint, one with a letter off, with two, with more, or none."""
    spark = customer.sparkSession
    listed = spark.createDataFrame(_HINTS, "n int, field string, pos int, hint string")
    hint, at = F.col("hint"), F.expr("cast(c_custkey div 7 % length(hint) as int)")
    cut = lambda middle, skip: F.concat(F.substring(hint, F.lit(1), at), F.lit(middle), F.substring(hint, at + skip, F.length(hint)))
    turn = F.col("c_custkey") % 6
    label = F.when(turn == 0, F.concat(F.lit(" "), F.upper(hint))).when(turn == 1, cut("", 2)).when(turn == 2, cut("x", 1)).when(turn == 3, cut("qz", 3)).when(turn == 4, cut("", 4))
    labels = customer.select("c_custkey").join(F.broadcast(listed), F.col("c_custkey") % len(_HINTS) == F.col("n")).select("c_custkey", label.alias("label"))
    hints = listed.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hint"))), lambda x: x["hint"]).alias("hints"))
    return schema.match_near_labels(labels, hints).select("c_custkey", "field", "hint", "distance")


# values

_NAME = "nullif(concat_ws(' ', nullif(first, ''), nullif(middle, ''), nullif(last, ''), nullif(suffix, '')), '')"
_BORN = "CASE WHEN dob = '' THEN NULL WHEN dob LIKE '19__-%' THEN substr(dob, 6, 2) || '/' || substr(dob, 9, 2) || '/' || substr(dob, 1, 4) ELSE dob END"
_CSZ = "CASE WHEN city IS NOT NULL AND state IS NOT NULL AND zip IS NOT NULL THEN city || ', ' || state || ' ' || zip ELSE nullif(concat_ws(', ', city, state, zip), '') END"
_YES = "CASE WHEN {0} THEN 'Yes' WHEN NOT {0} THEN 'No' END"
_SHARE = f"CASE WHEN own_pct <> 0 THEN CASE WHEN own_pct = floor(own_pct) THEN CAST(CAST(own_pct AS BIGINT) AS VARCHAR) || '.0%' ELSE CAST(own_pct AS VARCHAR) || '%' END WHEN app_id % 2 = 0 AND contains('someone else', lower({_NAME})) THEN '40.0%' WHEN app_id % 2 = 0 AND contains('the ' || lower(coalesce(first, '') || ' ' || coalesce(middle, '') || ' ' || coalesce(last, '')), lower({_NAME})) THEN '60.0%' END"


@query("applicant", sql=f"SELECT app_id, {_BORN} AS born, {_YES.format('citizen')} AS citizen, {_NAME} AS name, {_CSZ} AS csz, CASE WHEN affiliated > 0 THEN 'Yes' ELSE 'No' END AS other FROM applicant")
def n1_record_values(applicant: DataFrame) -> DataFrame:
    name = V.full_name(F.struct("first", "middle", "last", "suffix"))
    listed = F.when(F.col("affiliated") > 0, F.array_repeat(F.lit(1), F.col("affiliated")))
    return applicant.select("app_id", V.format_date(F.col("dob")).alias("born"), V.yes_no(F.col("citizen"), True).alias("citizen"), name.alias("name"), V.city_state_zip(F.struct("city", "state", "zip")).alias("csz"), V.other_businesses(listed).alias("other"))


@query("lineitem", sql="""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN '' WHEN l_linenumber = 5 THEN CAST(CAST(-floor(l_extendedprice) * 1e15 AS HUGEINT) AS VARCHAR) WHEN l_extendedprice = floor(l_extendedprice) THEN CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR) ELSE regexp_replace(CAST(CAST(l_extendedprice AS DECIMAL(38,6)) AS VARCHAR), '\\.?0+$', '') END AS text,
 CASE WHEN l_linenumber = 2 THEN upper(l_returnflag || 'x') WHEN l_linenumber = 4 THEN 'Off' ELSE l_returnflag || 'x' END AS ruled FROM lineitem""".replace("\\\\", "\\"))
def n7_value_text(lineitem: DataFrame) -> DataFrame:
    """Prices, absent ones, and amounts of 10^18 to 10^20, past a long."""
    large = -F.floor("l_extendedprice").cast("double") * 1e15
    number = F.when(F.col("l_linenumber") == 5, large).when(F.col("l_linenumber") != 3, F.col("l_extendedprice"))
    kind = F.when(F.col("l_linenumber") == 4, "button").otherwise("text")
    rule = F.when(F.col("l_linenumber") == 2, "uppercase")
    return lineitem.select("l_orderkey", "l_linenumber", V.value_text(number, "number").alias("text"), V.transform(F.concat("l_returnflag", F.lit("x")), rule, kind).alias("ruled"))


@query("orders", sql="""SELECT o_orderkey, CAST(round(o_totalprice) AS DOUBLE) AS amount, CAST(o_orderkey % 101 AS DOUBLE) AS share, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, lpad(CAST(o_orderkey % 1000000000 AS VARCHAR), 9, '0')[1:3] || '-' || lpad(CAST(o_orderkey % 1000000000 AS VARCHAR), 9, '0')[4:5] || '-' || lpad(CAST(o_orderkey % 1000000000 AS VARCHAR), 9, '0')[6:9] AS ssn FROM orders""")
def n10_canonical(orders: DataFrame) -> DataFrame:
    written = F.concat(F.lit("$"), F.format_number(F.round("o_totalprice"), 0))
    us = F.date_format("o_orderdate", "M/d/yyyy")
    day = F.when(F.col("o_orderkey") % 2 == 0, us).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    digits = F.lpad((F.col("o_orderkey") % 1000000000).cast("string"), 9, "0")
    return orders.select("o_orderkey", V.money(written).alias("amount"), V.percent(F.concat((F.col("o_orderkey") % 101).cast("string"), F.lit(" %"))).alias("share"), V.iso_date(day).alias("day"), V.dashed_id(digits, (3, 2, 4)).alias("ssn"))


@query("files", sql="SELECT doc_id, to_base64(encode(content)) AS data, replace(regexp_extract(path, '/([^.]+)', 1), '_', ' ') AS title FROM files")
def n11_payload(files: DataFrame) -> DataFrame:
    stem = F.regexp_extract("path", "/([^.]+)", 1)
    one = V.payload(F.col("content").cast("binary"), F.lit("text/plain"), F.lit(1))
    return files.select("doc_id", one["data"].alias("data"), V.title(stem).alias("title"))


# forms


@query("annotation", sql=_FIELDS + " SELECT * FROM f")
def f1_fields(annotation: DataFrame) -> DataFrame:
    return _fields(annotation).withColumn("options", F.array_join("options", "|"))


@query("annotation", "part", sql=_FIELDS + ", a AS (SELECT DISTINCT CAST(floor(p_partkey / 20.0) AS BIGINT) AS form_id FROM part) SELECT a.form_id, coalesce(n, 25) AS fields, n IS NULL AS fallback FROM a LEFT JOIN (SELECT form_id, count(*) AS n FROM f GROUP BY 1) USING (form_id)")
def f6_fallback(annotation: DataFrame, part: DataFrame) -> DataFrame:
    fields = _fields(annotation)
    every = forms.with_fallback(part.select(F.floor(F.col("p_partkey") / 20).alias("form_id")), fields, catalog.common_fields(part.sparkSession))
    return every.groupBy("form_id").agg(F.count("*").alias("fields"), F.bool_or(F.col("field_name") == "Spouse Name").alias("fallback"))


@query("annotation", sql=_FIELDS + f""", s AS (SELECT *, {_SECTION} AS section FROM f),
g AS (SELECT form_id, section, CASE section WHEN 'Personal Information' THEN 0 WHEN 'Business Information' THEN 1 WHEN 'Financial Information' THEN 2 ELSE 3 END AS no, string_agg(field_name, ',' ORDER BY field_name) AS names FROM s GROUP BY ALL),
h AS (SELECT form_id, string_agg(section || '=' || names, '|' ORDER BY no) AS sections FROM g GROUP BY 1)
SELECT form_id, count(*) AS total_fields, count_if(required) AS required_fields, any_value(h.sections) AS sections FROM s JOIN h USING (form_id) GROUP BY 1""")
def f7_structure(annotation: DataFrame) -> DataFrame:
    named = F.transform("sections", lambda x: F.concat(x["section"], F.lit("="), F.array_join(x["field_names"], ",")))
    return forms.form_structure(_fields(annotation)).select("form_id", "total_fields", "required_fields", F.array_join(named, "|").alias("sections"))


@query("annotation", "part", sql=_FIELDS + """, a AS (SELECT DISTINCT CAST(floor(p_partkey / 20.0) AS BIGINT) AS form_id FROM part), st AS (SELECT form_id, count(DISTINCT "T") AS n FROM annotation WHERE form_id % 4 = 0 GROUP BY 1), dy AS (SELECT form_id, count(*) AS n FROM f GROUP BY 1)
SELECT a.form_id, CASE WHEN st.n IS NOT NULL THEN 0 WHEN dy.n IS NOT NULL THEN 1 ELSE 2 END::INT AS source_no, coalesce(st.n, dy.n, 9) AS fields FROM a LEFT JOIN st USING (form_id) LEFT JOIN dy USING (form_id)""")
def f9_resolve(annotation: DataFrame, part: DataFrame) -> DataFrame:
    static = annotation.where("form_id % 4 = 0").groupBy("form_id", F.col("T").alias("pdf_field")).agg(F.max("FT").alias("type")).withColumn("required", F.lit(None).cast("boolean"))
    every = part.select(F.floor(F.col("p_partkey") / 20).alias("form_id"))
    few = forms.with_fallback(every, _fields(annotation).limit(0), catalog.common_fields(part.sparkSession, few=True))
    return forms.resolve_fields(forms.fields_from_mapping(static), _fields(annotation), few).groupBy("form_id", "source_no").agg(F.count("*").alias("fields"))


# mapping

_RULE_SQL = {
    "Name": _NAME, "First Name": "first", "Last Name": "last", "Social Security Number": "ssn", "SSN": "ssn", "Date of Birth": _BORN, "DOB": _BORN, "Mobile Telephone Number": "mobile", "Mobile Phone": "mobile", "Business Phone": "work",
    "Email address": "email", "Email": "email", "Residence Address": "street", "Home Address": "street", "City, State, Zip": _CSZ, "City": "city", "State": "state", "Zip": "zip", "Business Applicant Name": "legal_name", "Business Name": "legal_name",
    catalog.OWN: _SHARE, "Ownership Percentage": _SHARE, "EIN": "ein", "Are you a U.S. Citizen?": _YES.format("citizen"), "US Citizen": _YES.format("citizen"), catalog.OTHER: "CASE WHEN affiliated > 0 THEN 'Yes' ELSE 'No' END",
    "Have you ever declared bankruptcy?": _YES.format("bankrupt"), "Are you a defendant in any lawsuits or legal actions?": _YES.format("lawsuits"), "Are you delinquent on any taxes?": _YES.format("taxes"),
}
_RULED = ", ".join(f"('{n}', {e})" for n, e in _RULE_SQL.items())
_RULES = f", ruled AS (SELECT app_id, t.rule_name, t.value FROM applicant, LATERAL (VALUES {_RULED}) t(rule_name, value) WHERE t.value <> '')"
_COMMON = ", ".join(f"('{n}', {str(r).lower()})" for n, _, r in catalog.COMMON_FIELDS)
_MAPPED = _RULES + f", common AS (SELECT * FROM (VALUES {_COMMON}) c(field_name, required)), mapped AS (SELECT app_id, field_name, value FROM ruled JOIN common ON lower(rule_name) = lower(field_name))"


@query(sql=_RULES + " SELECT * FROM ruled")
def k1_rule_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.rule_values(records(spark, sf_dir))


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every applicant's record mapped to the common form, and its fields."""
    fields = catalog.common_fields(spark).withColumn("form_id", F.lit(1))
    return mapping.map_fields(mapping.rule_maps(records(spark, sf_dir)), fields), fields


@query(sql=_MAPPED + " SELECT * FROM mapped")
def k2_mapped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir)[0].drop("form_id")


_NAMES = ", ".join("'" + n.lower() + "'" for n in _RULE_SQL)


@query("annotation", sql=_FIELDS + f""", u AS (SELECT form_id, field_name FROM f UNION ALL SELECT -1, t.field_name FROM (VALUES {_COMMON}) t(field_name, required)) SELECT form_id, field_name FROM u WHERE lower(field_name) NOT IN ({_NAMES})""")
def k2_unmapped(annotation: DataFrame) -> DataFrame:
    spark = annotation.sparkSession
    fields = _fields(annotation).select("form_id", "field_name").unionByName(catalog.common_fields(spark).select(F.lit(-1).cast("long").alias("form_id"), "field_name"))
    return mapping.unmapped_fields(fields).select("form_id", "field_name")


@query(sql=_MAPPED + """, model AS (SELECT app_id, 'Net Worth' AS field_name, CAST(cents AS VARCHAR) AS value FROM applicant UNION ALL SELECT app_id, 'Name', CASE WHEN app_id % 2 = 0 THEN 'Model Name' ELSE '' END FROM applicant)
SELECT app_id, field_name, CASE WHEN model.value <> '' THEN model.value ELSE mapped.value END AS value, CASE WHEN model.value <> '' THEN 'model' ELSE 'rule' END AS method FROM mapped FULL JOIN model USING (app_id, field_name)""")
def k3_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "applicant")
    model = a.select("app_id", F.lit("Net Worth").alias("field_name"), F.col("cents").cast("string").alias("value")).unionByName(a.select("app_id", F.lit("Name").alias("field_name"), F.when(F.col("app_id") % 2 == 0, "Model Name").otherwise("").alias("value")))
    return mapping.merge_suggestions(_mapped(spark, sf_dir)[0], model.withColumn("form_id", F.lit(1))).drop("form_id")


_APPLIED = """, every AS (SELECT app_id FROM applicant UNION ALL SELECT -app_id FROM applicant WHERE app_id % 10 = 1)"""


def _applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All applicants, and for every tenth an application of which nothing was extracted."""
    ids = table(spark, sf_dir, "applicant").select("app_id")
    return ids.unionByName(ids.where("app_id % 10 = 1").select((-F.col("app_id")).alias("app_id"))).withColumn("error", F.concat(F.lit("code "), F.col("app_id").cast("string")))


@query(sql=_MAPPED + _APPLIED + """ SELECT app_id, count(value) / 25 * 100 AS completion, CASE WHEN count(value) > 0 THEN 0.8::DOUBLE END AS confidence, 'deterministic_fallback' AS method,
 'LLM mapping failed, using deterministic mapping: code ' || app_id AS error FROM every LEFT JOIN mapped USING (app_id) GROUP BY app_id""")
def k4_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled, fields = _mapped(spark, sf_dir)
    return mapping.fallback_result(filled, fields, _applications(spark, sf_dir).withColumn("form_id", F.lit(1))).drop("form_id")


@query(sql=_MAPPED + _APPLIED + """, need AS (SELECT 1 AS form_id, field_name FROM common WHERE required), f AS (SELECT form_id, count(field_name) AS n FROM (VALUES (1), (2)) v(form_id) LEFT JOIN need USING (form_id) GROUP BY 1),
lost AS (SELECT app_id, form_id, field_name FROM every, need WHERE (app_id, field_name) NOT IN (SELECT (app_id, field_name) FROM mapped)),
l AS (SELECT app_id, form_id, count(*) AS n, string_agg(field_name, '|' ORDER BY field_name) AS missing FROM lost GROUP BY ALL)
SELECT app_id, form_id, CASE WHEN f.n = 0 THEN 100 ELSE (1 - coalesce(l.n, 0) / f.n) * 100 END::DOUBLE AS completion, coalesce(missing, '') AS missing FROM every CROSS JOIN f LEFT JOIN l USING (app_id, form_id)""")
def k5_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled, fields = _mapped(spark, sf_dir)
    optional = spark.createDataFrame([(2, "Remarks", False)], "form_id int, field_name string, required boolean")
    both = fields.select("form_id", "field_name", "required").unionByName(optional)
    requests = _applications(spark, sf_dir).withColumn("form_id", F.explode(F.array(F.lit(1), F.lit(2))))
    return mapping.completion(filled, both, requests).select("app_id", "form_id", "completion", F.array_join("missing", "|").alias("missing"))


_REQUESTED = """, asked AS (SELECT app_id, -1 - app_id % 2 AS form_id FROM applicant UNION ALL SELECT app_id, app_id % 7 FROM applicant WHERE app_id % 3 = 0 UNION ALL SELECT app_id, -1 FROM applicant WHERE app_id % 5 = 0),
a AS (SELECT DISTINCT app_id, form_id FROM asked)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app_id, form_id): each applicant asks for one of two large forms, some for the first again, some for a form made from the parts."""
    a = table(spark, sf_dir, "applicant").select("app_id")
    own = a.select("app_id", (-1 - F.col("app_id") % 2).alias("form_id"))
    return own.unionByName(a.where("app_id % 3 = 0").select("app_id", (F.col("app_id") % 7).alias("form_id"))).unionByName(a.where("app_id % 5 = 0").select("app_id", F.lit(-1).cast("long").alias("form_id")))


def _all_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(form_id, field_name, required): the forms of the parts, the common one as -1, and as -2 one of whose fields all but the name are required."""
    common = catalog.common_fields(spark).select("field_name", "required")
    own = _fields(table(spark, sf_dir, "annotation")).select("form_id", "field_name", "required")
    first = common.select(F.lit(-1).cast("long").alias("form_id"), "field_name", "required")
    return own.unionByName(first).unionByName(common.where("field_name <> 'Name'").select(F.lit(-2).cast("long").alias("form_id"), "field_name", F.lit(True).alias("required")))


@query(names=("annotation", "applicant"), sql=_FIELDS + _RULES + _REQUESTED + f""", u AS (SELECT form_id, field_name, required FROM f UNION ALL SELECT -1, t.field_name, t.required FROM (VALUES {_COMMON}) t(field_name, required)
 UNION ALL SELECT -2, t.field_name, true FROM (VALUES {_COMMON}) t(field_name, required) WHERE t.field_name <> 'Name'),
m AS (SELECT a.app_id, a.form_id, u.field_name, u.required, r.value FROM a JOIN u USING (form_id) LEFT JOIN ruled r ON r.app_id = a.app_id AND lower(r.rule_name) = lower(u.field_name)),
g AS (SELECT app_id, form_id, count(value) AS filled, count(*) FILTER (WHERE required) AS need, count(*) FILTER (WHERE required AND value IS NULL) AS lost, string_agg(field_name, '|' ORDER BY field_name) FILTER (WHERE required AND value IS NULL) AS missing FROM m GROUP BY ALL)
SELECT app_id, form_id, coalesce(filled, 0) AS filled, CASE WHEN coalesce(need, 0) = 0 THEN 100 ELSE (1 - lost / need) * 100 END::DOUBLE AS completion, coalesce(missing, '') AS missing FROM a LEFT JOIN g USING (app_id, form_id)""")
def k5_requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is filled and what is missing of the forms that each applicant asked for."""
    fields, requests = _all_forms(spark, sf_dir), _requests(spark, sf_dir)
    filled = mapping.map_fields(mapping.rule_maps(records(spark, sf_dir)), fields, requests)
    n = filled.groupBy("app_id", "form_id").agg(F.count("*").alias("filled"))
    done = mapping.completion(filled, fields, requests).join(n, ["app_id", "form_id"], "left")
    return done.select("app_id", "form_id", F.coalesce("filled", F.lit(0)).alias("filled"), "completion", F.array_join("missing", "|").alias("missing"))


@query("batch", sql="SELECT app_id, arg_max(status, batch_ord) FILTER (WHERE status <> '') AS value, arg_max(batch_ord, batch_ord) FILTER (WHERE status <> '') AS source FROM batch GROUP BY 1 HAVING count_if(status <> '') > 0")
def k6_provenance(batch: DataFrame) -> DataFrame:
    leaves = batch.select("app_id", F.lit("status").alias("field_name"), F.col("batch_ord").alias("ord"), F.col("status").alias("value"), F.col("batch_ord").alias("source"), F.lit(0.9).alias("confidence"))
    return mapping.with_provenance(leaves).select("app_id", "value", "source")


@query("filled", sql="""SELECT app_id, CASE field_name WHEN 'Name' THEN 'applicant' ELSE field_name END AS pdf_field, CASE field_name WHEN 'Name' THEN coalesce(upper(value), '') WHEN 'Email address' THEN coalesce(lower(value), '')
 WHEN 'Citizen' THEN CASE WHEN value IS NULL THEN '' WHEN value = 'true' THEN 'Yes' ELSE 'Off' END WHEN 'Consent' THEN CASE WHEN value = 'Yes' THEN 'Yes' ELSE 'Off' END ELSE coalesce(value, '') END AS value FROM filled""")
def k7_apply_mapping(filled: DataFrame) -> DataFrame:
    rows = [
        (0, "applicant", "Name", "text", "uppercase"), (0, "Citizen", "Citizen", "button", None), (0, "Consent", "Consent", "checkbox", None), (0, "Email address", "Email address", "text", "lowercase"),
        (0, "Business Applicant Name", "Business Applicant Name", "text", None), (0, "total_assets", "total_assets", "text", None),
    ]
    named = filled.sparkSession.createDataFrame(rows, "form_id int, pdf_field string, source_field string, type string, transform string")
    return mapping.apply_mapping(filled, named).drop("form_id")


@query("filled", sql="SELECT app_id, field_name AS pdf_field, value FROM filled WHERE value IS NOT NULL")
def k8_pass_through(filled: DataFrame) -> DataFrame:
    nothing = filled.sparkSession.createDataFrame([], "form_id int, pdf_field string, source_field string, type string, transform string")
    return mapping.apply_mapping(filled, nothing).drop("form_id")


@query("filled", sql="SELECT app_id, count_if(field_name = 'Citizen' AND value = 'false') AS removed, count_if(NOT coalesce(value = 'false', false)) AS kept FROM filled GROUP BY 1")
def k10_false_boxes(filled: DataFrame) -> DataFrame:
    kept, counts = mapping.drop_false_boxes(filled)
    return counts.join(kept.groupBy("app_id").agg(F.count("*").alias("kept")), "app_id").select("app_id", "removed", "kept")


@query("filled", sql="SELECT app_id, field_name, CASE WHEN field_name IN ('Citizen', 'Consent') THEN 'box' ELSE 'text' END AS kind FROM filled WHERE field_name <> 'total_assets'")
def k11_kinds(filled: DataFrame) -> DataFrame:
    kinds = filled.where("field_name <> 'total_assets'").select("form_id", "field_name", F.when(F.col("boolean"), "checkbox").otherwise("text").alias("field_type")).distinct()
    return mapping.split_kinds(filled, kinds).select("app_id", "field_name", "kind")


@query("filled", sql="""
, s AS (SELECT app_id, field_name, CASE WHEN lower(value) IN ('true', 'yes', '1', 'checked', 'on') THEN CASE WHEN field_name = 'Citizen' THEN '/On' ELSE '/Yes' END ELSE '/Off' END AS state FROM filled WHERE boolean)
SELECT * FROM s UNION ALL SELECT app_id, field_name || c.n, state FROM s, (VALUES ('.0'), ('.1')) c(n) WHERE field_name = 'Citizen'""")
def k12_states(filled: DataFrame) -> DataFrame:
    states = F.when(F.col("field_name") == "Citizen", F.array(F.lit("/Off"), F.lit("/On"))).otherwise(F.array(F.lit("/Off")))
    boxes = filled.where("boolean").select("app_id", "form_id", "field_name", mapping.checkbox_state(F.col("value"), states).alias("state"))
    widgets = filled.sparkSession.createDataFrame([(0, "Citizen.0", "Citizen"), (0, "Citizen.1", "Citizen"), (0, "Consent", None)], "form_id int, field_name string, parent string")
    return mapping.propagate_children(boxes, widgets).select("app_id", "field_name", "state")


# reconciliation


@query("lineitem", "orders", sql="""
, p AS (SELECT l_orderkey AS record_id, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS computed FROM lineitem GROUP BY 1)
SELECT o_orderkey AS record_id, coalesce(computed, 0)::DOUBLE AS computed, CASE WHEN o_orderkey % 3 = 0 THEN true ELSE coalesce(computed, 0) = 0 END AS ok FROM orders LEFT JOIN p ON o_orderkey = record_id""")
def v1_totals(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    parts = lineitem.select(F.col("l_orderkey").alias("record_id"), F.lit("assets").alias("section"), F.round(F.col("l_extendedprice") * 100).alias("amount"))
    own = parts.groupBy("record_id").agg(F.sum("amount").alias("sum"))
    stated = orders.select(F.col("o_orderkey").alias("record_id"), F.lit("assets").alias("section")).join(own, "record_id", "left").select("record_id", "section", F.when(F.col("record_id") % 3 == 0, F.coalesce("sum", F.lit(0.0))).otherwise(0.0).alias("total"))
    return reconcile.check_totals(parts, stated).select("record_id", "computed", "ok")


@query("supplier", sql="SELECT s_nationkey AS business_id, CAST(sum(s_suppkey % 60) AS BIGINT) AS total, sum(s_suppkey % 60) = 100 AS complete FROM supplier GROUP BY 1")
def v3_ownership(supplier: DataFrame) -> DataFrame:
    return reconcile.ownership_total(supplier.select(F.col("s_nationkey").alias("business_id"), (F.col("s_suppkey") % 60).alias("percentage")))


@query("customer", "orders", sql="SELECT c_custkey AS business_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0)")
def v4_no_owner(customer: DataFrame, orders: DataFrame) -> DataFrame:
    owners = orders.select(F.col("o_custkey").alias("business_id"), F.when(F.col("o_orderkey") % 9 == 0, 50.0).alias("percentage"))
    return reconcile.missing_ownership(customer.select(F.col("c_custkey").alias("business_id")), owners)


@query("ledger", sql="""
, r AS (SELECT *, 1000 + sum(coalesce(deposit, 0) - coalesce(withdrawal, 0)) OVER (PARTITION BY account ORDER BY date, seq) AS running FROM ledger), b AS (SELECT *, running + CASE WHEN seq % 50 = 0 THEN 7 ELSE 0 END AS balance FROM r),
c AS (SELECT *, coalesce(lag(balance) OVER (PARTITION BY account ORDER BY date, seq), 1000) AS before FROM b)
SELECT account, seq, CAST(running AS DOUBLE) AS running, balance - before = coalesce(deposit, 0) - coalesce(withdrawal, 0) AS ok FROM c""")
def v5_ledger(ledger: DataFrame) -> DataFrame:
    opening = ledger.select("account").distinct().withColumn("opening", F.lit(1000.0))
    cast = ledger.withColumn("deposit", F.col("deposit").cast("double")).withColumn("withdrawal", F.col("withdrawal").cast("double"))
    stated = reconcile.check_ledger(cast.withColumn("balance", F.lit(0.0)), opening).select("account", "date", "seq", "deposit", "withdrawal", (F.col("running") + F.when(F.col("seq") % 50 == 0, 7).otherwise(0)).alias("balance"))
    return reconcile.check_ledger(stated, opening).select("account", "seq", "running", "ok")


@query("ledger", sql="SELECT account, CAST(1000 + sum(coalesce(deposit, 0) - coalesce(withdrawal, 0)) AS DOUBLE) AS ending FROM ledger GROUP BY 1")
def v5_ending(ledger: DataFrame) -> DataFrame:
    cast = ledger.withColumn("deposit", F.col("deposit").cast("double")).withColumn("withdrawal", F.col("withdrawal").cast("double"))
    return reconcile.statement_balance(cast, ledger.select("account").distinct().withColumn("opening", F.lit(1000.0)))


_VALID_PERIODS = """, good AS (SELECT * FROM period WHERE first_day <= last_day), held AS (SELECT l.account, l.seq, l.deposit, l.withdrawal, g.period FROM ledger l LEFT JOIN good g ON g.account = l.account AND l.date BETWEEN g.first_day AND g.last_day)"""


@query("ledger", "period", sql=_VALID_PERIODS + " SELECT account, seq, count(period) AS periods FROM held GROUP BY 1, 2")
def v5_assigned(ledger: DataFrame, period: DataFrame) -> DataFrame:
    """How many statement periods hold each transaction: none in a gap, several in an overlap."""
    return reconcile.in_periods(ledger, period).groupBy("account", "seq").agg(F.count("period").alias("periods"))


@query("ledger", "period", sql=_VALID_PERIODS + """
, t AS (SELECT account, period, sum(coalesce(deposit, 0))::DOUBLE AS deposits, sum(coalesce(withdrawal, 0))::DOUBLE AS withdrawals, count(*) AS transactions FROM held WHERE period IS NOT NULL GROUP BY 1, 2),
r AS (SELECT g.*, coalesce(t.deposits, 0) AS deposits, coalesce(t.withdrawals, 0) AS withdrawals, coalesce(t.transactions, 0) AS transactions, row_number() OVER (PARTITION BY g.account ORDER BY first_day, last_day, g.period) AS i,
 max(last_day) OVER (PARTITION BY g.account ORDER BY first_day, last_day, g.period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM good g LEFT JOIN t ON t.account = g.account AND t.period = g.period),
walk AS (SELECT account, i, beginning AS start, beginning + deposits - withdrawals AS computed, coalesce(ending, beginning + deposits - withdrawals) AS ended, NULL::DOUBLE AS former FROM r WHERE i = 1
 UNION ALL SELECT r.account, r.i, coalesce(r.beginning, w.ended), coalesce(r.beginning, w.ended) + r.deposits - r.withdrawals, coalesce(r.ending, coalesce(r.beginning, w.ended) + r.deposits - r.withdrawals), w.ended FROM walk w JOIN r ON r.account = w.account AND r.i = w.i + 1)
SELECT r.account, r.period, true AS valid, CASE WHEN before IS NOT NULL THEN greatest(date_diff('day', before, first_day) - 1, 0) END AS gap, CASE WHEN before IS NOT NULL THEN greatest(date_diff('day', first_day, least(last_day, before)) + 1, 0) END AS overlap, transactions, start, deposits, withdrawals, computed,
 abs(ending - computed) <= 0.01 AS ok, abs(beginning - former) <= 0.01 AS carried FROM r JOIN walk w ON w.account = r.account AND w.i = r.i
UNION ALL SELECT account, period, false, NULL, NULL, 0, NULL, 0, 0, NULL, NULL, NULL FROM period WHERE NOT coalesce(first_day <= last_day, false)""")
def v5_periods(ledger: DataFrame, period: DataFrame) -> DataFrame:
    """Statement periods with gaps and overlaps, balances carried from one to the next where they aren't stated."""
    return reconcile.check_periods(ledger, period)


_LINE_SUMS = ", l AS (SELECT l_orderkey AS id, " + ", ".join(f"sum(l_quantity) FILTER (WHERE l_linenumber = {n}) AS l{n}" for n in range(1, 8)) + " FROM lineitem GROUP BY 1)"


def _line(target: str, stated: int, computed: str) -> str:
    return f"SELECT id AS record_id, '{{0}}' AS form, '{target}' AS target, l{stated} AS stated, {computed} AS computed, l{stated} = {computed} AS ok FROM l WHERE l{stated} IS NOT NULL AND {{1}}"


def _sum(*signed: str) -> str:
    return " ".join(f"{x[0]} coalesce(l{x[1]}, 0)" for x in signed).removeprefix("+ ")


def _lines(form: str, where: str, *rules: str) -> str:
    return " UNION ALL ".join(r.format(form, where) for r in rules)


def _statement(lineitem: DataFrame, form: str, names: list[str]) -> DataFrame:
    """Lines of one statement for each order: the quantities by line number, under ``names`` in turn; a line that comes again adds to it."""
    named = F.element_at(F.array(*map(F.lit, names)), (F.col("l_linenumber") - 1) % len(names) + 1)
    return lineitem.select(F.col("l_orderkey").alias("record_id"), F.lit(form).alias("form"), named.alias("line"), F.col("l_quantity").alias("value"))


def _dependent(form: str, where: str, rules: dict[str, str]) -> str:
    """SQL of a form's targets in the order of ``rules``, the first three stated in lines 3, 5 and 7: each one's sum, where a target that isn't stated stands for its own sum."""
    stated = dict(zip(rules, ["l3", "l5", "l7", "NULL", "NULL"], strict=False))
    inner = f"(SELECT * FROM l WHERE {where})"
    for t, total in rules.items():
        inner = f"(SELECT *, CAST({total} AS DOUBLE) AS c_{t} FROM {inner})"
        inner = f"(SELECT *, coalesce({stated[t]}, c_{t}) AS v_{t} FROM {inner})"
    return " UNION ALL ".join(f"SELECT id AS record_id, '{form}' AS form, '{t}' AS target, {stated[t]} AS stated, c_{t} AS computed FROM {inner}" for t in rules)


_SCHEDULE_C = {"3": "coalesce(l1, 0) - coalesce(l2, 0)", "5": "v_3 - coalesce(l4, 0)", "7": "v_5 + coalesce(l6, 0)", "28": "0", "31": "v_7 - v_28"}
_FORM_1120 = {"1c": "coalesce(l1, 0) + coalesce(l2, 0)", "3": "v_1c - coalesce(l4, 0)", "11": "v_3 + coalesce(l6, 0)", "27": "0", "30": "v_11 - v_27"}
_INCOME = {"gross_profit": "coalesce(l1, 0) - coalesce(l2, 0)", "operating_income": "v_gross_profit - coalesce(l4, 0)", "net_income": "v_operating_income - coalesce(l6, 0)"}
_TAX_SQL = _dependent("schedule_c", "id % 2 = 0", _SCHEDULE_C) + " UNION ALL " + _dependent("form_1120", "id % 2 = 1", _FORM_1120)
_CHECKED = "SELECT *, abs(stated - computed) <= 0.01 AS ok FROM ({}) WHERE stated IS NOT NULL"


@query("lineitem", sql=_LINE_SUMS + _CHECKED.format(_TAX_SQL))
def v6_tax_lines(lineitem: DataFrame) -> DataFrame:
    own = _statement(lineitem.where("l_orderkey % 2 = 0"), "schedule_c", ["1", "2", "3", "4", "5", "6", "7"])
    firm = _statement(lineitem.where("l_orderkey % 2 = 1"), "form_1120", ["1a", "1b", "1c", "2", "3", "8", "11"])
    return reconcile.check_lines(own.unionByName(firm), catalog.line_rules(lineitem.sparkSession)).select("record_id", "form", "target", "stated", "computed", "ok")


#: Quantities by line number, the targets' own left out on a part of the orders, so that sums depend on sums at every depth.
_LEFT_OUT = ", l AS (SELECT l_orderkey AS id, " + ", ".join(f"sum(l_quantity) FILTER (WHERE l_linenumber = {n}) AS l{n}" for n in range(1, 8)) + " FROM lineitem WHERE NOT (l_linenumber IN (3, 5, 7) AND (l_orderkey // l_linenumber) % 3 = 0) GROUP BY 1)"


def _some_left_out(lineitem: DataFrame) -> DataFrame:
    return lineitem.where(~(F.col("l_linenumber").isin(3, 5, 7) & (F.expr("l_orderkey div l_linenumber") % 3 == 0)))


@query("lineitem", sql=_LEFT_OUT + _TAX_SQL)
def v6_dependent_lines(lineitem: DataFrame) -> DataFrame:
    """Tax forms that leave out some of their sums: what each target comes to, stated or not."""
    some = _some_left_out(lineitem)
    own = _statement(some.where("l_orderkey % 2 = 0"), "schedule_c", ["1", "2", "3", "4", "5", "6", "7"])
    firm = _statement(some.where("l_orderkey % 2 = 1"), "form_1120", ["1a", "1b", "1c", "2", "3", "8", "11"])
    return reconcile.computed_lines(own.unionByName(firm), catalog.line_rules(lineitem.sparkSession))


@query("lineitem", sql=_LEFT_OUT + _CHECKED.format(_dependent("income_statement", "true", _INCOME)))
def v7_dependent_lines(lineitem: DataFrame) -> DataFrame:
    """Income statements that leave out some of their sums, checked line by line."""
    lines = _statement(_some_left_out(lineitem), "income_statement", ["net_revenue", "cogs", "gross_profit", "operating_expenses", "operating_income", "other_expenses", "net_income"])
    return reconcile.check_lines(lines, catalog.line_rules(lineitem.sparkSession)).select("record_id", "form", "target", "stated", "computed", "ok")


@query("debt", sql="SELECT applicant, creditor, count(*) AS debts, CAST(sum(original_amount) AS BIGINT) AS original, CAST(sum(current_balance) AS BIGINT) AS current, CAST(sum(monthly_payment) AS BIGINT) AS monthly, avg(interest_rate) AS average_rate FROM debt GROUP BY ROLLUP (applicant, creditor)")
def v9_debt_summary(debt: DataFrame) -> DataFrame:
    return reconcile.debt_summary(debt)


@query("debt", sql="SELECT applicant, 12 * CAST(sum(monthly_payment) AS BIGINT) / nullif(CAST(applicant % 50 * 1000 AS DOUBLE), 0) AS ratio FROM debt GROUP BY applicant")
def v9_debt_to_income(debt: DataFrame) -> DataFrame:
    incomes = debt.select("applicant").distinct().withColumn("annual_income", (F.col("applicant") % 50 * 1000).cast("double"))
    return reconcile.debt_to_income(debt, incomes)


# evaluation


@query("applicant", sql="""
, e AS (SELECT app_id, 'city' AS field_name, 'text' AS kind, city AS expected, CASE WHEN app_id % 3 = 0 THEN city || 'XYZ' WHEN app_id % 3 = 1 THEN city || 'X' END AS actual FROM applicant
 UNION ALL SELECT app_id, 'cents', 'number', CAST(cents AS VARCHAR), CAST(cents + app_id % 2 AS VARCHAR) FROM applicant)
SELECT app_id, field_name, coalesce(CASE WHEN kind = 'number' THEN expected::DOUBLE = actual::DOUBLE ELSE 1 - levenshtein(expected, actual) / greatest(length(expected), length(actual)) >= 0.8 END, false) AS match FROM e""")
def e1_compare(applicant: DataFrame) -> DataFrame:
    return evaluate.compare(*_expected(applicant)).select("app_id", "field_name", "match")


def _expected(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    edited = F.when(F.col("app_id") % 3 == 0, F.concat("city", F.lit("XYZ"))).when(F.col("app_id") % 3 == 1, F.concat("city", F.lit("X")))
    expected = a.select("app_id", F.lit("city").alias("field_name"), F.lit("text").alias("kind"), F.col("city").alias("expected")).unionByName(a.select("app_id", F.lit("cents").alias("field_name"), F.lit("number").alias("kind"), F.col("cents").cast("string").alias("expected")))
    actual = a.select("app_id", F.lit("city").alias("field_name"), edited.alias("actual")).where("actual is not null").unionByName(a.select("app_id", F.lit("cents").alias("field_name"), (F.col("cents") + F.col("app_id") % 2).cast("string").alias("actual")))
    return expected, actual


@query("lineitem", sql="""SELECT l_orderkey AS app_id, count_if(l_linenumber % 2 = 1) / count(*) AS accuracy, CASE WHEN count_if(l_linenumber % 2 = 1) / count(*) >= 0.9 THEN 'excellent' WHEN count_if(l_linenumber % 2 = 1) / count(*) >= 0.8 THEN 'good' WHEN count_if(l_linenumber % 2 = 1) / count(*) >= 0.6 THEN 'acceptable'
 WHEN count_if(l_linenumber % 2 = 1) / count(*) >= 0.4 THEN 'poor' ELSE 'failing' END AS band FROM lineitem GROUP BY 1""")
def e2_accuracy(lineitem: DataFrame) -> DataFrame:
    return evaluate.accuracy(lineitem.select(F.col("l_orderkey").alias("app_id"), (F.col("l_linenumber") % 2 == 1).alias("match")))


@query("reply", sql="SELECT event_id, CASE WHEN event_id % 13 <= 2 THEN 'fast' WHEN event_id % 13 <= 5 THEN 'acceptable' WHEN event_id % 13 <= 10 THEN 'slow' ELSE 'too slow' END AS band FROM reply")
def e3_latency(reply: DataFrame) -> DataFrame:
    return reply.select("event_id", evaluate.latency_band(F.col("event_id") % 13).alias("band"))


_BAND = "CASE WHEN {0} <= 2 THEN 'fast' WHEN {0} <= 5 THEN 'acceptable' WHEN {0} <= 10 THEN 'slow' ELSE 'too slow' END"


@query("reply", sql=f"""
, r AS (SELECT app_id % 4 AS service, CASE WHEN event_id % 10 < 2 THEN 1 WHEN event_id % 10 < 8 THEN 4 WHEN event_id % 10 < 9 THEN 8 ELSE 12 END AS seconds FROM reply),
q AS (SELECT service, count(*) AS runs, CAST(max(seconds) AS DOUBLE) AS slowest, quantile_disc(seconds, 0.5) AS p50, quantile_disc(seconds, 0.99) AS p99 FROM r GROUP BY 1)
SELECT service, runs, slowest, {_BAND.format("p50")} AS p50_band, {_BAND.format("p99")} AS p99_band FROM q""")
def e3_latency_quantiles(reply: DataFrame) -> DataFrame:
    """Sketches of each service and day, stored, then merged over all days. Values lie so that the asked ranks are far from the next value's, beyond a sketch's error."""
    turn = F.col("event_id") % 10
    seconds = F.when(turn < 2, 1).when(turn < 8, 4).when(turn < 9, 8).otherwise(12)
    runs = reply.select((F.col("app_id") % 4).alias("service"), F.floor(F.col("event_id") / 500).alias("day"), seconds.alias("seconds"))
    stored = saved(evaluate.latency_sketches(runs, "service", "day"))
    return evaluate.latency_quantiles(stored, "service").select("service", "runs", "slowest", "p50_band", "p99_band")


@query("files", sql="SELECT app_id, CAST(sum(pages) * 1500 AS BIGINT) AS tokens, CASE WHEN sum(pages) * 1500 > 20000 THEN 'warn' ELSE 'ok' END AS actual FROM files GROUP BY 1")
def p2_page_tokens(files: DataFrame) -> DataFrame:
    tokens = planning.tokens_by_pages(F.col("pages"))
    return files.groupBy("app_id").agg(F.sum("pages").alias("pages")).select("app_id", tokens.alias("tokens"), planning.risk_band(tokens, "actual").alias("actual"))


def p9_text_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of each document as a grey picture of 16 columns; the last row is filled up with zeros."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw")).withColumn("h", F.ceil(F.octet_length("raw") / 16).cast("int"))
    picture = F.struct(F.col("doc_id").cast("string").alias("origin"), F.col("h").alias("height"), F.lit(16).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), F.expr("rpad(raw, h * 16, X'00')").alias("data"))
    return planning.text_heavy(rows.select(picture.alias("image")))


QUERIES["p9_text_heavy"] = p9_text_heavy


@query("conversations", sql="SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END AS answer, role || ' form' AS title FROM conversations")
def n2_answers(conversations: DataFrame) -> DataFrame:
    said = F.element_at(F.array(F.lit("TRUE"), F.lit("n"), F.lit("maybe"), F.lit("2")), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    return conversations.select("conv_id", "turn", V.yes_no(said).alias("answer"), V.title(F.concat("role", F.lit("_form"))).alias("title"))


@query("annotation", sql=""", m AS (SELECT form_id, "T" AS field_name, max("FT") AS type FROM annotation GROUP BY ALL)
SELECT form_id, field_name, CASE WHEN type LIKE '%tn%' THEN 'checkbox' ELSE 'text' END AS field_type, false AS required FROM m""")
def f8_static_fields(annotation: DataFrame) -> DataFrame:
    static = annotation.groupBy("form_id", F.col("T").alias("pdf_field")).agg(F.max("FT").alias("type"))
    static = static.withColumn("type", F.when(F.col("type").contains("tn"), "PDF Checkbox").otherwise("Text")).withColumn("required", F.lit(None).cast("boolean"))
    return forms.fields_from_mapping(static).select("form_id", "field_name", "field_type", "required")


@query("orders", sql="SELECT o_custkey AS record_id, CAST(sum(o_orderkey) - sum(o_orderkey % 7) AS BIGINT) AS net_worth FROM orders GROUP BY 1")
def v2_net_worth(orders: DataFrame) -> DataFrame:
    sums = orders.groupBy(F.col("o_custkey").alias("record_id")).agg(F.sum("o_orderkey").alias("assets"), F.sum(F.col("o_orderkey") % 7).alias("liabilities"))
    return sums.select("record_id", reconcile.net_worth(F.col("assets"), F.col("liabilities")).alias("net_worth"))


@query("lineitem", sql=_LINE_SUMS + _CHECKED.format(_dependent("income_statement", "true", _INCOME)))
def v7_income_statement(lineitem: DataFrame) -> DataFrame:
    lines = _statement(lineitem, "income_statement", ["net_revenue", "cogs", "gross_profit", "operating_expenses", "operating_income", "other_expenses", "net_income"])
    return reconcile.check_lines(lines, catalog.line_rules(lineitem.sparkSession)).select("record_id", "form", "target", "stated", "computed", "ok")


_THIRDS = ", l AS (SELECT l_orderkey AS id, " + ", ".join(f"sum(l_quantity) FILTER (WHERE (l_linenumber - 1) % 3 = {n - 1}) AS l{n}" for n in (1, 2, 3)) + " FROM lineitem GROUP BY 1)"


@query("lineitem", sql=_THIRDS + _lines("balance_sheet", "id % 2 = 0", _line("total_assets", 3, _sum("+1", "+2"))) + " UNION ALL " + _lines("cash_flow", "id % 2 = 1", _line("ending_cash", 3, _sum("+1", "+2"))))
def v8_balance(lineitem: DataFrame) -> DataFrame:
    sheets = _statement(lineitem.where("l_orderkey % 2 = 0"), "balance_sheet", ["total_liabilities", "equity", "total_assets"])
    flows = _statement(lineitem.where("l_orderkey % 2 = 1"), "cash_flow", ["beginning_cash", "net_change", "ending_cash"])
    return reconcile.check_lines(sheets.unionByName(flows), catalog.line_rules(lineitem.sparkSession)).select("record_id", "form", "target", "stated", "computed", "ok")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicants' records mapped to the common form, with the share of its fields that is filled."""
    filled, fields = _mapped(spark, sf_dir)
    return mapping.fallback_result(filled, fields, table(spark, sf_dir, "applicant").select("app_id", F.lit(1).alias("form_id"), F.lit("no model").alias("error")))


def scored_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorer surface over whole documents: a model that raises on some of them leaves failure rows for those, and answers for the rest of their batch."""

    def model(batch):  # noqa: ANN001, ANN202
        if (batch["doc_id"] % 97 == 3).any():
            raise ValueError("no answer")
        return batch.assign(reply=["{" + f'"chars": {len(t or "")}' + "}" for t in batch["content"]])

    scored = replies.score(table(spark, sf_dir, "files").select("doc_id", "content"), model, "doc_id long, reply string, ok boolean, error string")
    told = replies.parse_reply(scored.select("doc_id", "reply", "ok", F.col("error").alias("failure")))
    return told.select("doc_id", "ok", F.col("failure").alias("error"), replies.get_path(F.col("payload"), "$.chars", "bigint").alias("chars"))


QUERIES["x1_scorer"] = scored_replies
ORACLE["x1_scorer"] = "SELECT doc_id, doc_id % 97 <> 3 AS ok, CASE WHEN doc_id % 97 = 3 THEN 'ValueError: no answer' END AS error, CASE WHEN doc_id % 97 <> 3 THEN coalesce(length(text), 0) END AS chars FROM documents"
