"""Typed literals: canonical text, and units."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.functions import jsontext

#: Dimension of each unit, and its factor to the dimension's base unit.
UNITS = {
    "m": ("length", "1"), "km": ("length", "1000"), "cm": ("length", "0.01"), "mm": ("length", "0.001"),
    "kg": ("mass", "1"), "g": ("mass", "0.001"), "t": ("mass", "1000"), "s": ("time", "1"), "min": ("time", "60"), "h": ("time", "3600"),
}


#: What a token of each datatype looks like.
INTEGER, NUMBER = r"^[+-]?(?:0|[1-9]\d*)$", r"^[+-]?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?$"
DATE, INSTANT = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"
DURATION = r"^P(?=\d|T\d)(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?$"
MOST_CHARS = 4096
#: Larger exponents, of texts of as many digits, give null.
MOST_EXPONENT = 10_000


@F.pandas_udf(StringType())
def _canonical_json(tokens: pd.Series) -> pd.Series:
    """Sorted keys, no blanks; null for what is not strict JSON or repeats a key."""

    def one(token: str | None) -> str | None:
        try:
            return json.dumps(jsontext.strict(token), ensure_ascii=False, allow_nan=False, separators=(",", ":"), sort_keys=True)
        except (TypeError, ValueError, RecursionError):
            return None

    return tokens.map(one)


@F.pandas_udf(StringType())
def _composed(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: t and unicodedata.normalize("NFC", t))


def number_text(token: Column) -> Column:
    """A decimal token without a sign plus, an exponent, leading or trailing zeros, digit for digit; the point is shifted as text.

    Null for what is no number and for exponents beyond ``MOST_EXPONENT`` either way. Zero is ``0`` whatever its sign and exponent.
    """
    group = lambda k: F.regexp_extract(token, r"^[+-]?(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?$", k)
    digits = F.concat(group(1), group(2))
    shift = F.when(group(3) == "", F.lit(0)).otherwise(group(3).try_cast("int"))
    point, size = F.length(group(1)) + shift, F.length(digits)
    placed = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size)))
        .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1, size)))
    )
    placed = F.regexp_replace(placed, r"^0+(?=\d)", "")
    short = F.when(placed.contains("."), F.regexp_replace(F.regexp_replace(placed, "0+$", ""), r"\.$", "")).otherwise(placed)
    value = F.when(digits.rlike("^0*$"), "0").otherwise(F.concat(F.when(token.startswith("-"), "-").otherwise(""), short))
    return F.when(token.rlike(NUMBER) & (F.abs(shift) <= MOST_EXPONENT), value)


def canonical(raw: Column, datatype: Column) -> Column:
    """The canonical text of ``raw`` under its datatype; null if it is not a token of that type, is empty or too long, or has blanks at an edge.

    A FLOAT must be finite as a double; its text keeps all digits. Other datatypes, and nulls, give null.
    """
    instant = F.try_to_timestamp(F.when(raw.rlike(INSTANT), raw))
    part = F.date_format(instant, "SSSSSS")
    when = F.concat(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part == "000000", "").otherwise(F.concat(F.lit("."), part)), F.lit("Z"))
    value = (
        F.when(datatype == "STRING", F.when(raw.rlike(r"[^\x00-\x7f]"), _composed(F.when(datatype == "STRING", raw))).otherwise(raw))
        .when(datatype == "INTEGER", F.when(raw.rlike(INTEGER), number_text(raw)))
        .when((datatype == "DECIMAL") | ((datatype == "FLOAT") & (F.abs(raw.try_cast("double")) < float("inf"))), number_text(raw))
        .when(datatype == "BOOLEAN", F.when(F.lower(raw).isin("true", "false"), F.lower(raw)))
        .when(datatype == "DATE", F.when(raw.rlike(DATE) & F.try_to_date(raw, "yyyy-MM-dd").isNotNull(), raw))
        .when(datatype == "DATETIME", when)
        .when(datatype == "DURATION", F.when(raw.rlike(DURATION), raw))
        .when(datatype == "URI", F.when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~raw.rlike(r"(?U)\s"), raw))
        .when(datatype == "JSON", _canonical_json(F.when(datatype == "JSON", raw)))
    )
    return F.when(F.length(raw).between(1, MOST_CHARS) & ~raw.rlike(r"(?U)^\s|\s$"), value)


def to_base_unit(rows: DataFrame, value: str, unit: str) -> DataFrame:
    """``rows`` with ``dimension`` and ``base_value`` (decimal, without binary rounding); null for an unknown unit."""
    table = rows.sparkSession.createDataFrame([(u, d, f) for u, (d, f) in UNITS.items()], "u_unit string, dimension string, factor string")
    joined = rows.join(F.broadcast(table), F.col(unit) == F.col("u_unit"), "left").drop("u_unit")  # a few units
    exact = F.col(value).cast("decimal(24,8)") * F.col("factor").cast("decimal(10,4)")
    return joined.withColumn("base_value", exact).drop("factor")
