"""How a variable is held in columns, known when a query is planned.

A generic term is a struct.  Where a source knows more, fewer bytes do: an IRI made from a
template is held as its key columns (so joins and constants compare keys, which reach the
scan), a typed literal as its native column, a node of a dictionary as its id, which is decoded
only if a filter, another source or the result needs its text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.functions import terms
from ontoloom.functions.terms import Value
from ontoloom.sparql.algebra import XSD

#: The datatype that a Spark type is read as.
DATATYPES = {"string": "string", "boolean": "boolean", "tinyint": "byte", "smallint": "short", "int": "int", "bigint": "integer", "float": "float", "double": "double", "date": "date", "timestamp_ntz": "dateTime", "timestamp": "dateTime"}


def lexical(c: Column, kind: str) -> Column:
    """The text of a native column; timestamps as fixed-width ISO 8601, so that text order is time order."""
    if kind.startswith("timestamp"):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return terms.number_text(c) if kind in ("double", "float") else c.cast("string")


def escaped(c: Column, kind: str) -> Column:
    """The text of a key as a segment of an IRI: what is not a letter, digit or one of ``-_.*`` of a string is percent-encoded."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")) if kind == "string" else lexical(c, kind)


def unescaped(text: str, kind: str) -> str | None:
    """The key of a segment, or None if ``escaped`` makes no such segment."""
    if kind != "string":
        return text
    try:
        key = unquote(text, errors="strict")
    except UnicodeDecodeError:
        return None
    return key if quote(key, safe="*").replace("~", "%7E") == text else None


def key_test(c: Column, kind: str, text: str) -> Column:
    """Is the column's text exactly this?  The native comparison comes first, as scans can use it."""
    if kind == "string":
        return c == text
    return (c == F.lit(text).try_cast(kind)) & (lexical(c, kind) == text)


@dataclass(frozen=True)
class Generic:
    """A term struct."""

    width = 1

    def term(self, parts: list[Column]) -> Column:
        return parts[0]

    def value(self, parts: list[Column]) -> Value:
        return terms.value_of_term(parts[0])

    def native(self, parts: list[Column]) -> Column:
        return parts[0]["value"]


@dataclass(frozen=True)
class Template:
    """An IRI of fixed segments around key columns; equal templates compare by their keys."""

    segments: tuple[str, ...]
    kinds: tuple[str, ...] = field(compare=False)

    @property
    def width(self) -> int:
        return len(self.segments) - 1

    def native(self, parts: list[Column]) -> Column:
        pieces: list[Column] = []
        for segment, part, kind in zip(self.segments, parts, self.kinds):
            pieces += [F.lit(segment), escaped(part, kind)]
        return F.concat(*pieces, F.lit(self.segments[-1]))

    def term(self, parts: list[Column]) -> Column:
        return terms.make("iri", self.native(parts))

    def value(self, parts: list[Column]) -> Value:
        return Value("i", s=self.native(parts), term=self.term(parts), native=(self, parts))

    def invert(self, iri: str) -> list[str] | None:
        """The key texts of an IRI, or None if it is not of the template."""
        m = re.fullmatch("([^/]*)".join(map(re.escape, self.segments)), iri)
        keys = [unescaped(text, kind) for text, kind in zip(m.groups(), self.kinds)] if m else [None]
        return None if None in keys else keys

    def equals(self, parts: list[Column], iri: str) -> Column:
        """Is the IRI made from these keys?  Null if a key is."""
        keys = self.invert(iri)
        if keys is None:
            return F.when(parts[0].isNotNull(), False)
        return reduce(lambda a, b: a & b, map(key_test, parts, self.kinds, keys))


@dataclass(frozen=True)
class Typed:
    """A literal of one datatype, as a native column."""

    kind: str
    width = 1

    @property
    def datatype(self) -> str:
        return XSD + DATATYPES.get(self.kind.partition("(")[0], "decimal" if self.kind.startswith("decimal") else "string")

    def native(self, parts: list[Column]) -> Column:
        return parts[0]

    def term(self, parts: list[Column]) -> Column:
        return terms.make("literal", lexical(parts[0], self.kind), F.lit(self.datatype))

    def value(self, parts: list[Column]) -> Value:
        c = parts[0]
        if self.kind == "boolean":
            return Value("b", b=c, term=self.term(parts))
        if self.datatype in terms.NUMERIC:
            return Value("n", n=c.cast("double"), term=self.term(parts))
        return Value("s", s=lexical(c, self.kind), term=self.term(parts), native=(self, parts))


@dataclass(frozen=True)
class Node:
    """An id of a dictionary (id, kind, value)."""

    dictionary: DataFrame = field(compare=False)
    name: str = "objects"
    width = 1


def column(key: str, i: int) -> str:
    return f"{key}__{i}"


@dataclass
class Solutions:
    """A bag of solutions: a DataFrame, and the shape of each variable or blank node in it.

    ``maybe`` names those that can be unbound (null) in a row; all others are bound in every row.
    """

    df: DataFrame
    shapes: dict[str, object]
    maybe: frozenset[str] = frozenset()

    def with_df(self, df: DataFrame) -> Solutions:
        return Solutions(df, self.shapes, self.maybe)

    def parts(self, key: str) -> list[Column]:
        return [F.col(column(key, i)) for i in range(self.shapes[key].width)]

    def columns(self, keys) -> list[str]:
        return [column(k, i) for k in keys for i in range(self.shapes[k].width)]

    def only(self, keys) -> Solutions:
        keys = [k for k in keys if k in self.shapes]
        return Solutions(self.df.select(*self.columns(keys)), {k: self.shapes[k] for k in keys}, self.maybe & set(keys))

    def generic(self, keys) -> Solutions:
        """With these variables as term structs."""
        df, shapes = self.df, dict(self.shapes)
        for key in keys:
            shape = shapes.get(key)
            if shape is None or isinstance(shape, Generic):
                continue
            if isinstance(shape, Node):
                names = shape.dictionary.select(F.col("id").alias("__id"), terms.make_kind("kind", "value").alias("__term"))
                df = df.join(names, F.col(column(key, 0)) == F.col("__id"), "left").withColumn(column(key, 0), F.col("__term")).drop("__id", "__term")
            else:
                term = shape.term(self.parts(key))
                df = df.withColumn("__term", term).drop(*self.columns([key])).withColumnRenamed("__term", column(key, 0))
            shapes[key] = Generic()
        return Solutions(df, shapes, self.maybe)

    def decoded(self, keys) -> Solutions:
        """With the dictionary ids among these variables as term structs."""
        return self.generic([k for k in keys if isinstance(self.shapes.get(k), Node)])

    def renamed(self, keys, prefix: str) -> Solutions:
        """With a prefix before the columns of these variables, which are then known by the prefixed names."""
        shapes = {(prefix + k if k in keys else k): s for k, s in self.shapes.items()}
        df = self.df.withColumnsRenamed({c: prefix + c for c in self.columns([k for k in self.shapes if k in keys])})
        return Solutions(df, shapes, frozenset(prefix + k if k in keys else k for k in self.maybe))

    def renamed_to(self, names: dict[str, str]) -> Solutions:
        """With other names for some variables."""
        renamed = {column(old, i): column(new, i) for old, new in names.items() for i in range(self.shapes[old].width)}
        return Solutions(self.df.withColumnsRenamed(renamed), {names.get(k, k): s for k, s in self.shapes.items()}, frozenset(names.get(k, k) for k in self.maybe))

    def value(self, key: str) -> Value | None:
        return self.shapes[key].value(self.parts(key)) if key in self.shapes else None

    def bound(self, key: str) -> Column:
        return F.col(column(key, 0)).isNotNull()
