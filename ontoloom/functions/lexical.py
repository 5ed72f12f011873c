"""Lexical forms of XML Schema types as native column expressions.

``is_valid`` tells whether a text is in the form of a type; ``canonical`` maps every
spelling of one value to the same text (null if it cannot be read).  No Python code runs
per row: both compile to regular expressions and casts inside whole-stage code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DECIMAL = r"[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)"
_ZONE = r"(?:Z|[+-](?:0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?"

#: The lexical form of each kind of literal, as a regular expression.
FORMS = {
    "boolean": r"true|false|1|0",
    "integer": r"[+-]?[0-9]++",
    "int": r"[+-]?[0-9]++",
    "nonNegativeInteger": r"[+]?[0-9]++|-0++",
    "decimal": _DECIMAL,
    "double": rf"{_DECIMAL}(?:[eE][+-]?[0-9]++)?|NaN|-?INF",
    "float": rf"{_DECIMAL}(?:[eE][+-]?[0-9]++)?|NaN|-?INF",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "dateTime": rf"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]++)?{_ZONE}",
}
LANGUAGE_TAG = r"@[A-Za-z]{2,8}+(?:-[A-Za-z0-9]{1,8}+)*+"


def matches(value: Column, form: str) -> Column:
    """Whole-text match; unlike ``$``, ``\\z`` does not look past a line break at the end."""
    return value.rlike(rf"\A(?:{form})\z")


def _day(value: Column) -> Column:
    return F.substr(value, F.lit(1), F.lit(10)).try_cast("date")


def is_valid(kind: Column, value: Column) -> Column:
    """Is ``value`` in the form of ``kind`` (a name of ``FORMS``, else a free text)?  Null values are not."""
    case = None
    for name, form in FORMS.items():
        ok = matches(value, form)
        if name == "int":
            ok = ok & value.try_cast("int").isNotNull()
        elif name in ("date", "dateTime"):
            ok = ok & _day(value).isNotNull()
        case = F.when(kind == name, ok) if case is None else case.when(kind == name, ok)
    return F.coalesce(case.otherwise(value.isNotNull()), F.lit(False))


def _decimal_text(value: Column) -> Column:
    body = F.regexp_replace(value, r"\A[+-]", "")
    whole = F.regexp_extract(body, r"\A0*+([0-9]*+)", 1)
    part = F.rtrim(F.regexp_extract(body, r"\.([0-9]*+)", 1), F.lit("0"))
    sign = F.when(value.startswith("-") & ((whole != "") | (part != "")), "-").otherwise("")
    return F.concat(sign, F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))


def _instant_text(value: Column) -> Column:
    zone = F.regexp_extract(value, r"(Z|[+-][0-9]{2}:[0-9]{2})\z", 1)
    second = F.concat(F.substr(value, F.lit(1), F.lit(19)), F.when(zone == "", "Z").otherwise(zone)).try_cast("timestamp")
    part = F.rtrim(F.regexp_extract(value, r"T[0-9:]{8}\.([0-9]++)", 1), F.lit("0"))
    return F.concat(F.unix_seconds(second).cast("string"), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))


def canonical(column_type: Column, value: Column) -> Column:
    """One text for all spellings of a value, read as ``column_type``; null if it cannot be read.

    The types are those of a wide table: bigint, decimal, double, boolean, date, timestamp
    (seconds since 1970 UTC, with any fraction) and string (as stored).  Other types give null.
    """

    def form(kind: str, text: Column) -> Column:
        return F.when(matches(value, FORMS[kind]), text)

    return (
        F.when(column_type == "string", value)
        .when(column_type == "bigint", form("integer", value.try_cast("bigint").cast("string")))
        .when(column_type == "decimal", form("decimal", _decimal_text(value)))
        .when(column_type == "double", form("double", (value.try_cast("double") + F.lit(0.0)).cast("string")))
        .when(column_type == "boolean", form("boolean", F.when(value.isin("true", "1"), "true").otherwise("false")))
        .when(column_type == "date", form("date", F.when(_day(value).isNotNull(), value)))
        .when(column_type == "timestamp", form("dateTime", F.when(_day(value).isNotNull(), _instant_text(value))))
    )
