"""Scalar semantics of form values: columns in, columns out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean yes, no, a pressed button, a checked box.
YES, NO = ("yes", "y", "true", "1"), ("no", "n", "false", "0")
PRESSED = ("true", "yes", "1", "checked")
CHECKED = (*PRESSED, "on")
#: Media types by extension.
MIME = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "txt": "text/plain",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xls": "application/vnd.ms-excel",
}


def truthy(value: Column, kind: str) -> Column:
    """False for null, false, 0, '', and empty lists; ``kind`` is text, number, boolean, list or object."""
    test = {"text": value != "", "number": value != 0, "boolean": value, "list": F.size(value) > 0, "object": value.isNotNull()}[kind]
    return F.coalesce(test, F.lit(False))


def truthy_json(text: Column) -> Column:
    """The same for a value in JSON text."""
    empty = text.isin("null", "false", '""', "[]", "{}")
    zero = F.coalesce(text.try_cast("double") == 0, F.lit(False))
    return text.isNotNull() & ~empty & ~zero


def format_date(text: Column) -> Column:
    """ISO dates as MM/DD/YYYY, by position and without a validity check; '' and null give null, other forms stay."""
    slash, dash = F.split(text, "/"), F.split(text, "-")
    iso = F.concat_ws("/", F.get(dash, F.lit(1)), F.get(dash, F.lit(2)), F.get(dash, F.lit(0)))
    return F.when(text == "", None).when(F.size(slash) == 3, text).when(~text.contains("/") & (F.size(dash) == 3) & (F.length(F.get(dash, F.lit(0))) == 4), iso).otherwise(text)


def yes_no(value: Column, boolean: bool = False) -> Column:
    """Yes or No for booleans and for the texts that mean them; null for anything else."""
    if boolean:
        return F.when(value, "Yes").when(~value, "No")
    low = F.lower(value)
    return F.when(low.isin(*YES), "Yes").when(low.isin(*NO), "No")


def full_name(name: Column) -> Column:
    """Non-empty parts of name<first, middle, last, suffix>; null if there are none."""
    return F.nullif(F.concat_ws(" ", *[F.nullif(name[p], F.lit("")) for p in ("first", "middle", "last", "suffix")]), F.lit(""))


def street(address: Column) -> Column:
    return address["street"]


def city_state_zip(address: Column) -> Column:
    """``City, ST ZIP`` when all are there, else what is there, comma-joined; null if nothing is. A null part counts as absent."""
    city, state, code = address["city"], address["state"], address["zip"]
    every = city.isNotNull() & state.isNotNull() & code.isNotNull()
    return F.when(every, F.concat(city, F.lit(", "), state, F.lit(" "), code)).otherwise(F.nullif(F.concat_ws(", ", city, state, code), F.lit("")))


#: A limb of a large whole number, and the power of two by which it is made up.
_LIMB, _STEP = 10**9, 29


def whole_text(x: Column) -> Column:
    """All digits of a finite double that is a whole number, of any size.

    Up to 2^62 it is cast. Beyond, it is a first part below 2^62 times a power of two, and _STEP bits for each power less (all exact); the
    digits are made up from the top in limbs of nine.
    """
    size = F.abs(x)
    steps = F.greatest(F.lit(0), F.ceil((F.log2(size) - 60) / _STEP).cast("int"))
    power = lambda n: F.pow(F.lit(2.0), n * _STEP)
    first = F.floor(size / power(steps))
    limbs = F.array(first % _LIMB, _div(first, _LIMB) % _LIMB, _div(_div(first, _LIMB), _LIMB))
    start = F.struct(limbs.alias("limbs"), (size - first.cast("double") * power(steps)).alias("rest"))

    def step(known: Column, n: Column) -> Column:
        part = F.floor(known["rest"] / power(n))
        carried = F.aggregate(
            known["limbs"], F.struct(F.array().cast("array<bigint>").alias("out"), part.alias("carry")),
            lambda c, limb: F.struct(F.array_append(c["out"], (limb * (1 << _STEP) + c["carry"]) % _LIMB).alias("out"), _div(limb * (1 << _STEP) + c["carry"], _LIMB).alias("carry")),
            lambda c: F.array_append(c["out"], c["carry"]),
        )
        return F.struct(carried.alias("limbs"), (known["rest"] - part.cast("double") * power(n)).alias("rest"))

    made = F.aggregate(F.reverse(F.sequence(F.lit(0), steps - 1)), start, step, lambda k: k["limbs"])
    digits = F.ltrim(F.array_join(F.reverse(F.transform(made, lambda limb: F.lpad(limb.cast("string"), 9, "0"))), ""), F.lit("0"))
    large = F.concat(F.when(x < 0, "-").otherwise(""), digits)
    return F.when(size < float(1 << 62), x.cast("bigint").cast("string")).otherwise(large)


def _div(a: Column, b: int) -> Column:
    """Whole division of a non-negative bigint; the quotient is below 2^33, so the double nearest to it is rounded right."""
    return F.rint((a - a % b) / F.lit(b)).cast("bigint")


def number_text(x: Column) -> Column:
    """A double as text: whole numbers without a point, others with the fewest digits that tell them apart, below 0.0001 with an exponent."""
    shortest = x.cast("string")
    plain = F.regexp_replace(shortest.try_cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
    # 5.0E-7 is written 5e-07
    part, power = F.split_part(shortest, F.lit("E-"), F.lit(1)), F.split_part(shortest, F.lit("E-"), F.lit(2))
    small = F.concat(F.regexp_replace(part, r"\.0$", ""), F.lit("e-"), F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power))
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.when(odd.isNotNull(), odd).when(x == F.rint(x), whole_text(x)).when((F.abs(x) < 1e-4) & shortest.contains("E-"), small).otherwise(plain)


def percent_text(x: Column) -> Column:
    """A double as percentage; whole numbers keep one place, as in ``50.0%``."""
    return F.concat(F.when(x == F.rint(x), F.concat(number_text(x), F.lit(".0"))).otherwise(number_text(x)), F.lit("%"))


def ownership_pct(own: Column, owners: Column, name: Column) -> Column:
    """The applicant's own share if truthy, else that of the first owner whose name contains the applicant's and who has one."""
    named = F.filter(owners, lambda o: F.contains(F.lower(o["name"]), F.lower(name)) & o["percentage"].isNotNull() & (o["name"] != ""))
    return F.coalesce(F.when(truthy(own, "number"), percent_text(own)), percent_text(F.get(named, F.lit(0))["percentage"]))


def other_businesses(affiliated: Column) -> Column:
    """Yes for a non-empty list, else No; never null."""
    return F.when(truthy(affiliated, "list"), "Yes").otherwise("No")


def value_text(value: Column, kind: str) -> Column:
    """Text of a value for a form: null is '', booleans Yes or No, whole numbers without decimals."""
    text = {"boolean": yes_no(value, True), "number": number_text(value), "text": value.cast("string")}[kind]
    return F.coalesce(text, F.lit(""))


def transform(text: Column, rule: Column, field_type: Column) -> Column:
    """A field's value by its type and rule: buttons become Yes or Off, upper and lower case are applied; null is ''."""
    pressed = F.when(F.lower(text).isin(*PRESSED), "Yes").otherwise("Off")
    cased = F.when(rule == "uppercase", F.upper(text)).when(rule == "lowercase", F.lower(text)).otherwise(text)
    return F.when(text.isNull(), "").when(field_type.isin("button", "checkbox"), pressed).otherwise(cased)


def title(stem: Column, dashes: bool = False) -> Column:
    """A form's title from its file stem: underscores, and dashes if asked, become spaces."""
    return F.translate(stem, "_-", "  ") if dashes else F.replace(stem, F.lit("_"), F.lit(" "))


def money(text: Column) -> Column:
    """``$1,500,000`` as 1500000; null where it is no number."""
    return F.regexp_replace(F.trim(text), r"[$,]", "").try_cast("double")


def percent(text: Column) -> Column:
    """``75%`` as 75, between 0 and 100 as written."""
    return F.regexp_replace(F.trim(text), r"\s*%$", "").try_cast("double")


def iso_date(text: Column) -> Column:
    """Dates in ISO, US and long US form as YYYY-MM-DD; null where no form fits."""
    forms = [F.try_to_date(F.trim(text), f) for f in ("yyyy-MM-dd", "M/d/yyyy", "MMMM d, yyyy")]
    return F.date_format(F.coalesce(*forms), "yyyy-MM-dd")


def dashed_id(text: Column, cuts: tuple[int, ...]) -> Column:
    """Digits regrouped with dashes, (3, 2, 4) for a social security number, (2, 7) for an employer's; null if their count differs."""
    digits = F.regexp_replace(text, r"\D", "")
    starts = [sum(cuts[:i]) + 1 for i in range(len(cuts))]
    return F.when(F.length(digits) == sum(cuts), F.concat_ws("-", *[F.substring(digits, s, n) for s, n in zip(starts, cuts, strict=True)]))


def base64_text(content: Column) -> Column:
    """Base64 without the line ends that Spark puts in."""
    return F.regexp_replace(F.base64(content), r"[\r\n]", "")


def payload(content: Column, media_type: Column, page: Column) -> Column:
    return F.struct(base64_text(content).alias("data"), media_type.alias("media_type"), page.alias("page_number"))


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot; '' without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def mime_type(ext: Column) -> Column:
    """Media type of an extension, with or without its dot."""
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.element_at(known, F.ltrim(F.lower(ext), F.lit("."))), F.lit("application/octet-stream"))


def cache_key(path: Column, mtime: Column, size: Column) -> Column:
    return F.md5(F.concat_ws("_", path, mtime.cast("string"), size.cast("string")).cast("binary"))


def first_of(rules: list[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first rule whose condition holds."""
    return reduce(lambda rest, rule: F.when(rule[0], F.lit(rule[1])).otherwise(rest), reversed(rules), F.lit(default))
