"""Model replies: scoring surface, fences, parsing, failures, usage, presence."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerleaf.functions.values import first_of, truthy_json

FENCE = "```"


def score(requests: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``model`` applied to Arrow batches of ``requests``. ``schema`` holds the model's columns, ok and error: a request that raises becomes a failure row.

    What raises is given to the model again in tenths, down to single requests, so what fails doesn't depend on how requests are batched, and
    those near a failure still share calls; a request of a batch of ten thousand is asked five times at most. A failure row keeps the columns
    of ``requests`` that ``schema`` names; the rest is null.
    """
    wanted = [f.name for f in StructType.fromDDL(schema)]

    def scored(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            yield model(b).assign(ok=True, error=None)[wanted]
        except Exception as e:  # the reply's failure is data
            if len(b) > 1:
                step = -(-len(b) // 10)
                for at in range(0, len(b), step):
                    yield from scored(b.iloc[at : at + step])
                return
            failed = pd.DataFrame({c: b[c] if c in b else pd.Series([None] * len(b), index=b.index, dtype=object) for c in wanted})
            yield failed.assign(ok=False, error=f"{type(e).__name__}: {e}")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            alike: dict[tuple, list[pd.DataFrame]] = {}  # only frames of the same types go out together, as others would change values
            for part in scored(b):
                alike.setdefault(tuple(part.dtypes), []).append(part)
            for found in alike.values():
                yield pd.concat(found, ignore_index=True) if len(found) > 1 else found[0]

    return requests.mapInPandas(each, schema)


def strip_fence(text: Column, variant: str = "extractor") -> Column:
    """The part of a reply inside its fence, trimmed.

    ``extractor``: after a json fence up to the next fence, if there is one; else the second part of a text cut at fences, without a
    leading ``json``; else the text. ``filler``: only a text that starts with a fence is cut.
    """
    parts = F.split(text, FENCE)
    second = F.get(parts, F.lit(1))
    bare = F.when(second.startswith("json"), F.substring(second, F.lit(5), F.length(second))).otherwise(second)
    if variant == "filler":
        return F.trim(F.when(text.startswith(FENCE), bare).otherwise(text), F.lit(" \t\r\n"))
    start = F.instr(text, FENCE + "json")
    rest = F.substring(text, start + 7, F.length(text))
    stop = F.instr(rest, FENCE)
    inside = F.when(stop > 0, F.substring(rest, F.lit(1), stop - 1)).otherwise(text)
    return F.trim(F.when(start > 0, inside).when(F.size(parts) > 1, bare).otherwise(text), F.lit(" \t\r\n"))


def parse_reply(replies: DataFrame, text: str = "reply") -> DataFrame:
    """``replies`` with payload (VARIANT), failed, error: anything but a JSON object fails and keeps its text as raw_text."""
    parsed = F.try_parse_json(strip_fence(F.col(text)))
    fine = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return replies.withColumn("payload", F.when(fine, parsed)).withColumn("failed", ~fine).withColumn("error", F.when(~fine, F.concat(F.lit("JSON parse error: "), F.coalesce(F.substring(text, 1, 100), F.lit(""))))).withColumn("raw_text", F.when(~fine, F.col(text)))


def error_class(error: Column, route: str = "images") -> Column:
    """size, rate, payload, timeout or other; the files route looks for payload before rate. Null for a null error."""
    low = F.lower(error)
    size = (error.contains("2000 pixels") | error.contains("2000px"), "size")
    rate = (low.contains("rate") | error.contains("429"), "rate")
    payload = (error.contains("413") | (error.contains("too large") if route == "files" else F.lit(False)), "payload")
    timeout = (low.contains("timeout"), "timeout")
    order = [payload, rate, timeout] if route == "files" else [size, rate, payload, timeout]
    return F.when(error.isNotNull(), first_of(order, "other"))


def usage(replies: DataFrame, key: str = "app_id") -> DataFrame:
    """(``key``, total_tokens, tokens_per_second) of input_tokens, output_tokens and seconds."""
    tokens = F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)))
    return replies.groupBy(key).agg(tokens.alias("total_tokens"), (tokens / F.nullif(F.sum("seconds"), F.lit(0))).alias("tokens_per_second"))


def run_metadata(files: DataFrame, key: str = "app_id") -> DataFrame:
    """(``key``, documents, images, mb, docs_per_second, failed) of files (pages, length, seconds); without pages a run has failed."""
    images, seconds = F.sum(F.coalesce("pages", F.lit(0))), F.sum("seconds")
    return files.groupBy(key).agg(
        F.count("*").alias("documents"), images.alias("images"), (F.sum("length") / (1 << 20)).alias("mb"), (F.count("*") / F.nullif(seconds, F.lit(0))).alias("docs_per_second"), (images == 0).alias("failed"),
    )


def top_level(df: DataFrame, payload: str = "payload") -> DataFrame:
    """A row for each top-level key of a VARIANT object: the other columns, key, value (JSON text)."""
    keep = ", ".join(f"`{c}`" for c in df.columns if c != payload)
    return df.sparkSession.sql(f"SELECT {keep}, t.key AS key, to_json(t.value) AS value FROM {{df}}, LATERAL variant_explode(`{payload}`) AS t", df=df)


def drop_control_keys(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The top-level keys that don't start with an underscore, as rows."""
    return top_level(df, payload).where(~F.startswith("key", F.lit("_")))


def batch_outcome(batches: DataFrame, key: str = "app_id") -> DataFrame:
    """(``key``, total_batches, successful_batches, failed_all, files) of batches (failed, files)."""
    good = F.count_if(~F.col("failed"))
    return batches.groupBy(key).agg(F.count("*").alias("total_batches"), good.alias("successful_batches"), (good == 0).alias("failed_all"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))


def to_contract(df: DataFrame, schema: str, payload: str = "payload") -> DataFrame:
    """``df`` with record, the payload as the contract's struct; a leaf of a wrong type is null."""
    return df.withColumn("record", F.from_json(F.to_json(payload), schema))


def get_path(payload: Column, path: str, kind: str = "string") -> Column:
    """Value at ``path`` ($.a.b) of a VARIANT; null from the first missing key on."""
    return F.try_variant_get(payload, path, kind)


def count_data_points(leaves: DataFrame, key: str = "app_id") -> DataFrame:
    """(``key``, data_points): truthy leaves of which no key on the way starts with an underscore; ``leaves`` has path and value."""
    hidden = F.exists("path", lambda k: k.startswith("_"))
    return leaves.groupBy(key).agg(F.count_if(truthy_json(F.col("value")) & ~hidden).alias("data_points"))


#: The paths that a complete extraction holds.
PRESENCE = [
    "$.personal.primary_applicant.name", "$.personal.primary_applicant.ssn", "$.personal.primary_applicant.ownership_percentage",
    "$.business.primary_business.legal_name", "$.business.primary_business.ein", "$.business.primary_business.annual_revenue",
    "$.financials.assets.total_assets", "$.financials.liabilities.total_liabilities", "$.financials.net_worth",
]


def presence_score(payload: Column, paths: list[str] | None = None) -> Column:
    """How many of the paths lead to a truthy value."""
    points = [F.when(truthy_json(F.to_json(F.try_variant_get(payload, p, "variant"))), 1).otherwise(0) for p in paths or PRESENCE]
    return reduce(lambda a, b: a + b, points)


def application_row(documents: DataFrame, key: str = "app_id") -> DataFrame:
    """(``key``, total_assets, total_liabilities, net_worth, average_confidence): totals of 0 are null, without documents the confidence is 0."""
    out = documents.groupBy(key).agg(*[F.nullif(F.max(c), F.lit(0)).alias(c) for c in ("total_assets", "total_liabilities", "net_worth")], F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"))
    return out
