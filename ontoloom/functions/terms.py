"""RDF terms as Spark columns, and their values as filters see them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontoloom.sparql.algebra import XSD, Blank, Iri, Literal

#: The cell of a generic solution: kind is iri, blank or literal.
TERM = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "value", "datatype", "lang")])

#: The numeric datatypes; all are evaluated as 64-bit floats.
NUMERIC = [XSD + n for n in ("integer", "decimal", "float", "double", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte")]
_NUMBER = r"\A(?:[+-]?(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?|(?i:[+-]?(?:inf|infinity|nan)))\z"


def make(kind: str, value: Column, datatype: Column | None = None, lang: Column | None = None) -> Column:
    """A term column; null where the value is null."""
    none = F.lit(None).cast("string")
    whole = F.struct(F.lit(kind).alias("kind"), value.alias("value"), (none if datatype is None else datatype).alias("datatype"), (none if lang is None else lang).alias("lang"))
    return F.when(value.isNotNull(), whole)


def of(term) -> Column:
    """The column of a constant term."""
    if isinstance(term, Iri):
        return make("iri", F.lit(term.value))
    if isinstance(term, Blank):
        return make("blank", F.lit(term.label))
    return make("literal", F.lit(term.value), F.lit(term.datatype), F.lit(term.lang))


def number(text: Column) -> Column:
    """A text as a double, null if it is none; blanks and type suffixes are not numbers."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def number_text(x: Column) -> Column:
    """The shortest decimal text of a double, without exponent and without a trailing ``.0``."""
    plain = x.cast("string")
    wide = F.regexp_replace(x.try_cast("decimal(38,12)").cast("string"), r"\.?0+\z", "")
    return F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).when(plain.contains("E") & wide.isNotNull() & (F.abs(x) >= 1e-6), wide).otherwise(F.regexp_replace(plain, r"\.0\z", ""))


@dataclass
class Value:
    """The value of an expression: one column per type, and which of them holds.

    ``tag`` is a letter where the type is known when the query is planned (b, n, s, i for an IRI, k
    for a blank node), else a column of such letters.  A value is null (an error or unbound) where
    its column, or the tag column, is null.
    """

    tag: str | Column
    b: Column | None = None
    n: Column | None = None
    s: Column | None = None
    term: Column | None = None  # the term column, for a variable
    constant: str | None = None  # the text, of a constant
    native: tuple | None = None  # (shape, columns) that the text is made from

    def slot(self, tag: str) -> Column:
        c = {"b": self.b, "n": self.n}.get(tag, self.s)
        return F.lit(None).cast({"b": "boolean", "n": "double"}.get(tag, "string")) if c is None else c

    def tags(self) -> Column:
        return F.when(self.slot(self.tag).isNotNull(), F.lit(self.tag)) if isinstance(self.tag, str) else self.tag

    def pick(self, choices: dict[str, Column], kind: str) -> Column:
        """The choice of the value's type, null for types without one."""
        if isinstance(self.tag, str):
            return choices.get(self.tag, F.lit(None).cast(kind))
        case = None
        for tag, c in choices.items():
            case = F.when(self.tag == tag, c) if case is None else case.when(self.tag == tag, c)
        return case

    def truth(self) -> Column:
        """Exactly true; anything else, errors too, is false."""
        return F.coalesce(self.pick({"b": self.slot("b")}, "boolean"), F.lit(False))

    def as_number(self) -> Column:
        return self.pick({"n": self.slot("n"), "s": number(self.slot("s")), "b": self.slot("b").cast("double")}, "double")

    def as_text(self) -> Column:
        return self.pick({"s": self.slot("s"), "i": self.slot("s"), "n": number_text(self.slot("n")), "b": self.slot("b").cast("string")}, "string")


def value_of_term(t: Column) -> Value:
    """The value of a generic term column."""
    datatype, text = t["datatype"], t["value"]
    num = F.when(datatype.isin(NUMERIC), number(text))
    tag = F.when(t["kind"] == "iri", "i").when(t["kind"] == "blank", "k").when(t["kind"] == "literal", F.when(datatype == XSD + "boolean", "b").when(num.isNotNull(), "n").otherwise("s"))
    return Value(tag, b=text.isin("true", "1"), n=num, s=text, term=t)


def value_of_constant(term) -> Value:
    if isinstance(term, Iri):
        return Value("i", s=F.lit(term.value), constant=term.value)
    assert isinstance(term, Literal)
    if term.datatype == XSD + "boolean":
        return Value("b", b=F.lit(term.value in ("true", "1")))
    if term.datatype in NUMERIC:
        try:
            return Value("n", n=F.lit(float(term.value)))
        except ValueError:
            pass
    return Value("s", s=F.lit(term.value), constant=term.value)


def make_kind(kind: str, value: str) -> Column:
    """A term column of IRIs and blank nodes, whose kind is a column."""
    none = F.lit(None).cast("string")
    return F.when(F.col(value).isNotNull(), F.struct(F.col(kind).alias("kind"), F.col(value).alias("value"), none.alias("datatype"), none.alias("lang")))
