"""The given tables in the shapes of the pipeline, as SQL that Spark and DuckDB both read. ``{name}`` stands for a table or another view."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.session import ship

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
VIEWS = {
    "files": """
        SELECT doc_id, CAST(floor(doc_id / 20.0) AS BIGINT) AS app_id, doc_id AS ord, text AS content, n_chars AS length, doc_id % 13 AS pages, CAST(doc_id % 9 AS DOUBLE) AS seconds,
            source || '/' || CASE doc_id % 6 WHEN 0 THEN 'PFS' WHEN 1 THEN 'debt_schedule' WHEN 2 THEN 'sba_form' WHEN 3 THEN 'tax' WHEN 4 THEN 'Return' ELSE 'note' END
            || '_' || CAST(doc_id AS STRING) || CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.PNG' WHEN 3 THEN '.txt' ELSE '.pdf' END AS path
        FROM {documents}""",
    "registry": """
        SELECT CASE WHEN doc_id % 2 = 0 THEN f.content ELSE f.content || ' (draft)' END AS content, 'file-' || CAST(doc_id % 400 AS STRING) AS file_id, f.path AS name, f.path, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE f.length END AS size,
            'text/plain' AS mime_type, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(1000000 + doc_id * 1000 AS DOUBLE) END AS uploaded_at
        FROM {files} AS f""",
    "applicant": """
        SELECT c_custkey AS app_id,
            CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '' ELSE 'Given' || CAST(c_custkey % 89 AS STRING) END AS first,
            CASE WHEN c_custkey % 3 = 0 THEN 'M' END AS middle, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_name END AS last,
            CASE WHEN c_custkey % 17 = 0 THEN 'Jr' ELSE '' END AS suffix, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE lpad(CAST(c_custkey AS STRING), 9, '0') END AS ssn,
            CASE c_custkey % 4 WHEN 0 THEN '19' || CAST(60 + c_custkey % 40 AS STRING) || '-02-30' WHEN 1 THEN '03/04/1970' WHEN 2 THEN '' ELSE 'May 1980' END AS dob,
            CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE '555-' || CAST(c_custkey AS STRING) END AS mobile, '556-' || CAST(c_custkey AS STRING) AS work,
            CASE WHEN c_custkey % 10 = 3 THEN 'no mail' ELSE 'c' || CAST(c_custkey AS STRING) || '@example.com' END AS email,
            CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_custkey % 500 AS STRING) || ' Main St' END AS street,
            n_name AS city, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE substr(n_name, 1, 2) END AS state, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE lpad(CAST(c_custkey % 99999 AS STRING), 5, '0') END AS zip,
            CASE WHEN c_custkey % 19 = 0 THEN '' ELSE c_mktsegment || ' LLC' END AS legal_name, '12-' || lpad(CAST(c_custkey AS STRING), CASE WHEN c_custkey % 12 = 0 THEN 6 ELSE 7 END, '0') AS ein,
            CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 100 AS DOUBLE) WHEN c_custkey % 4 = 1 THEN CAST(12.5 AS DOUBLE) END AS own_pct,
            CASE WHEN c_custkey % 3 = 0 THEN true WHEN c_custkey % 3 = 1 THEN false END AS citizen, CAST(c_custkey % 4 AS INT) AS affiliated,
            c_custkey % 5 = 1 AS bankrupt, c_custkey % 6 = 2 AS lawsuits, CASE WHEN c_custkey % 7 = 3 THEN NULL ELSE c_custkey % 7 = 1 END AS taxes,
            CASE c_custkey % 5 WHEN 0 THEN 'LLC' WHEN 1 THEN 'Corporation' WHEN 2 THEN 'Corp' WHEN 3 THEN '' ELSE 'Partnership' END AS entity_type,
            CAST(round(c_acctbal * 100) AS BIGINT) AS cents
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "reply": """
        SELECT event_id, user_id AS app_id, event_id AS batch_ord, event_type,
            CASE event_id % 7 WHEN 0 THEN 'Here: ```json' || props || '``` done' WHEN 1 THEN '```' || props || '```' WHEN 2 THEN '```json' || props WHEN 3 THEN props
                WHEN 4 THEN '[1]' WHEN 5 THEN substr(props, 1, 4) ELSE '```json {"a": 1}```' END AS reply,
            CASE event_id % 9 WHEN 0 THEN 'over 2000 pixels' WHEN 1 THEN 'Rate limited' WHEN 2 THEN 'code 429' WHEN 3 THEN 'code 413 rate' WHEN 4 THEN 'read Timeout' WHEN 5 THEN 'too large' WHEN 6 THEN 'odd' END AS error,
            event_id % 5 = 0 AS failed, event_id % 3 AS files, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 1000 END AS input_tokens, event_id % 100 AS output_tokens, CAST(event_id % 3 AS DOUBLE) AS seconds
        FROM {events}""",
    "batch": """
        SELECT o_custkey AS app_id, o_orderkey AS batch_ord, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END AS status,
            CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey END AS x, o_orderkey % 3 = 0 AS flag, o_orderkey % 6 < 4 AS has_inner, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END AS inner_text
        FROM {orders}""",
    "annotation": """
        SELECT CAST(floor(p_partkey / 20.0) AS BIGINT) AS form_id, CAST(p_partkey % 7 AS INT) AS page, p_partkey AS ord,
            CASE WHEN floor(p_partkey / 20.0) % 10 = 9 THEN NULL WHEN p_partkey % 6 = 0 THEN '/Btn' WHEN p_partkey % 6 = 1 THEN 'Ch' WHEN p_partkey % 6 = 2 THEN '/Sig' WHEN p_partkey % 6 < 5 THEN '/Tx' END AS "FT",
            CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_brand || CASE p_partkey % 5 WHEN 0 THEN ' Date' WHEN 1 THEN ' real estate' WHEN 2 THEN ' company' WHEN 3 THEN ' loan' ELSE ' misc' END END AS "T",
            p_size % 4 AS "Ff", p_type
        FROM {part}""",
    "ledger": """
        SELECT o_custkey AS account, CAST(o_orderdate AS DATE) AS date, o_orderkey AS seq, CASE WHEN o_orderstatus = 'O' THEN CAST(round(o_totalprice) AS BIGINT) END AS deposit,
            CASE WHEN o_orderstatus <> 'O' THEN CAST(round(o_totalprice) AS BIGINT) END AS withdrawal
        FROM {orders}""",
    "period": """
        SELECT account, no AS period, make_date(CAST(floor(no / 4.0) AS INT), CAST(no % 4 * 3 + 1 AS INT), 1) AS first_day,
            CASE WHEN no % 23 = 0 THEN NULL ELSE make_date(CAST(floor(no / 4.0) AS INT), CAST(no % 4 * 3 + 3 AS INT), CASE WHEN account % 3 = 0 THEN 20 ELSE 28 END) END AS last_day,
            CASE WHEN (account + no) % 3 = 0 THEN CAST(deposits AS DOUBLE) END AS beginning, CASE WHEN (account + no) % 4 = 0 THEN CAST(deposits - withdrawals AS DOUBLE) END AS ending
        FROM (SELECT account, no, sum(coalesce(deposit, 0)) AS deposits, sum(coalesce(withdrawal, 0)) AS withdrawals
            FROM (SELECT account, year(date) * 4 + quarter(date) - 1 AS no, deposit, withdrawal FROM {ledger}
                UNION ALL SELECT account, year(date) * 4 + quarter(date) AS no, 0, 0 FROM {ledger} WHERE account % 2 = 0) AS l GROUP BY account, no) AS s
        UNION ALL SELECT account, -seq AS period, date AS first_day, date + 40 AS last_day, NULL AS beginning, CAST(deposit AS DOUBLE) AS ending FROM {ledger} WHERE seq % 9 = 0""",
    "debt": """
        SELECT CAST(floor(l_orderkey / 40.0) AS BIGINT) AS applicant, l_suppkey AS creditor, CAST(round(l_extendedprice) AS BIGINT) AS original_amount, CAST(floor(l_extendedprice / 2) AS BIGINT) AS current_balance,
            CAST(floor(l_extendedprice / 100) AS BIGINT) AS monthly_payment, CAST(round(l_tax * 100) AS BIGINT) AS interest_rate
        FROM {lineitem}""",
    "sheet": """
        SELECT l_orderkey AS doc_id, CAST(l_suppkey % 8 AS INT) AS sheet_idx, l_returnflag AS sheet_name, l_linenumber - 1 AS "row", 0 AS "col", CAST(l_partkey AS STRING) AS value
        FROM {lineitem}""",
    "filled": """
        SELECT app_id, 0 AS form_id, field_name, value, boolean FROM (
            SELECT app_id, 'Name' AS field_name, last AS value, false AS boolean FROM {applicant}
            UNION ALL SELECT app_id, 'Email address', email, false FROM {applicant}
            UNION ALL SELECT app_id, 'Business Applicant Name', legal_name, false FROM {applicant}
            UNION ALL SELECT app_id, 'total_assets', CAST(cents AS STRING), false FROM {applicant}
            UNION ALL SELECT app_id, 'Citizen', CASE WHEN citizen THEN 'true' WHEN NOT citizen THEN 'false' END, true FROM {applicant}
            UNION ALL SELECT app_id, 'Consent', CASE WHEN bankrupt THEN 'Yes' ELSE '/Off' END, true FROM {applicant})""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view by name."""
    if name in TABLES:
        return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    text = re.sub(r'"(FT|T|Ff|row|col)"', r"`\1`", VIEWS[name].replace('{"a": 1}', '{{"a": 1}}'))
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", VIEWS[name]))})


def ctes(*names: str) -> str:
    """``WITH`` and the views that the named ones need, for DuckDB."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in TABLES and name not in order:
            for n in re.findall(r"\{(\w+)\}", VIEWS[name]):
                add(n)
            order.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n])})" for n in order) + " "


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app_id, record): applicants as records of the extraction contract; every second one has two owners, one of them the applicant."""
    a = table(spark, sf_dir, "applicant")
    name = F.struct("first", "middle", "last", "suffix")
    owners = F.array(F.struct(F.lit("someone else").alias("name"), F.lit(40.0).alias("percentage")), F.struct(F.upper(F.concat(F.lit("the "), F.coalesce("first", F.lit("")), F.lit(" "), F.coalesce("middle", F.lit("")), F.lit(" "), F.coalesce("last", F.lit("")))).alias("name"), F.lit(60.0).alias("percentage")))
    person = F.struct(name.alias("name"), "ssn", "dob", F.struct(F.col("mobile"), F.col("work").alias("business")).alias("phones"), "email", F.struct(F.col("citizen").alias("is_us_citizen")).alias("citizenship"), F.col("own_pct").alias("ownership_percentage"))
    firm = F.struct("legal_name", "ein", F.when(F.col("app_id") % 2 == 0, owners).alias("ownership"))
    asked = F.struct(F.col("bankrupt").alias("has_declared_bankruptcy"), F.col("lawsuits").alias("pending_lawsuits"), F.col("taxes").alias("delinquent_on_taxes"))
    return a.select(
        "app_id", F.struct(
            F.struct(person.alias("primary_applicant")).alias("personal"), F.struct(F.struct("street", "city", "state", "zip").alias("current_residence")).alias("addresses"),
            F.struct(firm.alias("primary_business"), F.when(F.col("affiliated") > 0, F.array_repeat(F.lit("x"), F.col("affiliated"))).alias("affiliated_businesses")).alias("business"), asked.alias("checkboxes_and_questions"),
        ).alias("record"),
    )
