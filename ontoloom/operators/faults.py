"""Rows that fail to parse: structural checks, and one cast per distinct value.

Structure (quoting, number of fields) is checked per line by possessive patterns, which run
in constant stack and linear time, and the split lines are written once.  One pass over the
rows makes the distinct (type, value) pairs; each distinct type and then each distinct value
of a type that has a form is checked once.  The invalid ones make a written dictionary with
reasons, whose true size is known when it is joined back: the planner broadcasts it while it
is small, so that the rows are not shuffled at all.  Free texts and nulls never enter the
pairs or the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.iri import BLANKS, XSD, read_iris
from ontoloom.functions.lexical import FORMS, LANGUAGE_TAG, is_valid, matches
from ontoloom.sources.scratch import Scratch

FIELDS = ["subject", "predicate", "literal_value", "literal_type"]
_QUOTED = r'"(?:[^"]++|"")*+"'
_FIELD = rf'(?:{_QUOTED}|[^",]*+)'


def split_lines(lines: DataFrame, line_id: str = "line_id", line: str = "line") -> DataFrame:
    """(row_id, fault, n_fields, subject, predicate, literal_value, literal_type) of comma-separated lines.

    ``fault`` is 'quoting', 'columns' or null; the fields, as text, are null unless it is null.
    An empty or null line has one empty field and so the fault 'columns'; line breaks inside
    quotes belong to the field.
    """
    text = F.coalesce(F.col(f"`{line}`"), F.lit(""))
    whole = lines.select(F.col(f"`{line_id}`").alias("row_id"), text.alias("text")).withColumn("quoted_well", matches(F.col("text"), rf"{_FIELD}(?:,{_FIELD})*+"))
    parts = F.when(F.col("quoted_well"), F.regexp_extract_all(F.concat(F.lit(","), "text"), F.lit(rf",({_FIELD})"), F.lit(1)))
    counted = whole.withColumn("parts", parts).withColumn("n_fields", F.size("parts"))
    fault = F.when(~F.col("quoted_well"), "quoting").when(F.col("n_fields") != len(FIELDS), "columns")

    def field(n: int):
        raw = F.get("parts", n)
        inner = F.replace(F.substr(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))
        return F.when(fault.isNull(), F.when(raw.startswith('"'), inner).otherwise(raw))

    return counted.select("row_id", fault.alias("fault"), "n_fields", *[field(n).alias(name) for n, name in enumerate(FIELDS)])


def type_kinds(types: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(raw, kind) for each row of ``types`` (raw), texts of types as they are written.

    ``kind`` is a name of ``FORMS``, 'text' for what may hold anything, or 'unknown'.
    """
    term = read_iris(types, "raw", prefixes, "term")
    local = F.when(F.col("term").startswith(XSD), F.substr("term", F.lit(len(XSD) + 1)))
    kind = F.when(local.isin(*FORMS), local).when((F.col("term") == "") | (local == "string") | matches(F.col("term"), LANGUAGE_TAG), "text").otherwise("unknown")
    return term.select("raw", kind.alias("kind"))


def _formless(raw: Column) -> Column:
    """Is this text of a type, however it is read, surely none of a type with a form?

    What a text reads as ends as the text does, unless that ends with the colon of a prefix.
    """
    text = F.btrim(raw, F.lit(BLANKS))
    return (text == "") | text.startswith("@") & ~text.contains(":") | text.endswith("string") | text.endswith("string>")


def classify(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``rows`` with ``reason``: the first fault of each row, or null.

    ``rows`` needs literal_value, literal_type and a ``fault`` found before (null if none); all its
    columns are kept.  The reason is that fault, else 'type' (a literal_type that is no known
    type; null and blank ones mean string), else 'value' (a null value, or one not in the form of
    its type).  ``rows`` is read several times, by columns: pass a scan or a written table.
    """
    scratch = Scratch(rows.sparkSession, "faults")
    raw, value = F.col("literal_type"), F.col("literal_value")
    sound = F.col("fault").isNull() & raw.isNotNull()
    formed = sound & value.isNotNull() & ~_formless(raw)
    pairs = scratch.save(rows.where(sound).select(raw.alias("raw"), F.when(formed, value).alias("value")).distinct(), "pairs")
    kinds = scratch.save(type_kinds(pairs.select("raw").distinct(), prefixes), "kinds")
    checked = pairs.where("value is not null").join(kinds.where(F.col("kind").isin(*FORMS)), "raw").where(~is_valid(F.col("kind"), F.col("value")))
    invalid = scratch.save(checked.select(F.col("raw").alias("__raw"), F.col("value").alias("__value"), F.lit("value").alias("__why")), "invalid")
    scratch.drop("pairs")
    unknown = kinds.where("kind = 'unknown'").select(F.col("raw").alias("__type"), F.lit("type").alias("__unknown"))

    def typed(part: DataFrame) -> DataFrame:
        return part.join(unknown, raw == F.col("__type"), "left")

    looked = typed(rows.where(formed)).join(invalid, (raw == F.col("__raw")) & (value == F.col("__value")), "left")
    known = looked.withColumn("reason", F.coalesce("__unknown", "__why")).drop("__type", "__unknown", "__raw", "__value", "__why")
    plain = typed(rows.where(~F.coalesce(formed, F.lit(False))))
    found = F.coalesce("fault", "__unknown", F.when(value.isNull(), "value"))
    return plain.withColumn("reason", found).drop("__type", "__unknown").unionByName(known)


def records(properties: DataFrame, lines: DataFrame) -> DataFrame:
    """(origin, row_id, fault, subject, predicate, literal_value, literal_type, subject_text, predicate_text) of stored rows and lines.

    A subject or predicate of a line that is no 64-bit integer is null, and its text is kept in
    ``subject_text`` or ``predicate_text``, which are null otherwise.  The split lines are written once.
    """
    split = Scratch(lines.sparkSession, "lines").save(split_lines(lines), "split")
    number = {c: F.when(matches(F.col(c), r"[+-]?[0-9]++"), F.col(c).try_cast("bigint")) for c in FIELDS[:2]}
    ids = [number[c].alias(c) for c in FIELDS[:2]]
    texts = [F.when(number[c].isNull(), F.col(c)).alias(f"{c}_text") for c in FIELDS[:2]]
    none = F.lit(None).cast("string")
    stored = properties.select(F.lit("node_properties").alias("origin"), "row_id", none.alias("fault"), *FIELDS, *[none.alias(f"{c}_text") for c in FIELDS[:2]])
    return stored.unionByName(split.select(F.lit("property_lines").alias("origin"), "row_id", "fault", *ids, *FIELDS[2:], *texts))
