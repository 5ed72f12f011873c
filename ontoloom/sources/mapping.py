"""Ordinary tables as virtual triples.

A table has a subject template over its key columns and a predicate per column: a column that
refers to another table makes IRIs, any other typed literals.  Patterns of one subject over one
table become a single scan (each predicate has one value per subject, so no self-join is
needed), constant IRIs are turned back into keys, and all of it reaches the file scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontoloom.sources.triples import check
from ontoloom.sparql import algebra as A
from ontoloom.sparql.shapes import Generic, Solutions, Template, Typed, column, key_test


@dataclass
class TableMap:
    """``load`` gives the table, whenever a query reads it.

    ``links``: column -> start of the IRI it makes; columns not named in ``skip`` and ``links`` are literals.
    The keys must be unique and not null; arrays, maps, structs and binaries have no triples.
    """

    schema: T.StructType
    load: Callable[[], DataFrame]
    base: str  # of the subjects, as http://host/name/
    keys: list[str]
    links: dict[str, str] = field(default_factory=dict)
    skip: tuple[str, ...] = ()
    predicate_base: str = "http://tables.example/ns#"

    def __post_init__(self):
        self.kinds = {f.name: f.dataType.simpleString() for f in self.schema}
        self.subject = template(self.base, [self.kinds[k] for k in self.keys])
        self.predicates = {self.predicate_base + c: c for c, kind in self.kinds.items() if c not in self.skip and not kind.startswith(("array", "map", "struct", "binary"))}

    def shape(self, c: str):
        return template(self.links[c], [self.kinds[c]]) if c in self.links else Typed(self.kinds[c])


def template(base: str, kinds: list[str]) -> Template:
    return Template((base, *["/"] * (len(kinds) - 1), ""), tuple(kinds))


def apart(a: Template | None, b: Template) -> bool:
    """Can no IRI be of both templates?  Sure if neither base begins the other."""
    return a is not None and not a.segments[0].startswith(b.segments[0]) and not b.segments[0].startswith(a.segments[0])


class MappedSource:
    def __init__(self, maps: list[TableMap]):
        self.maps = maps

    def tables(self, pattern: A.Triple, known: dict[str, Template] | None = None, node: bool = False) -> list[tuple[TableMap, str]]:
        """(map, column) of every way to answer a pattern; ``known``: templates that variables are bound to elsewhere; ``node``: the object is no literal."""
        out = []
        for m in self.maps:
            if A.is_open(pattern.s) and apart((known or {}).get(A.key(pattern.s)), m.subject):
                continue
            if isinstance(pattern.s, A.Iri) and m.subject.invert(pattern.s.value) is None:
                continue
            for predicate, c in m.predicates.items():
                if isinstance(pattern.p, A.Iri) and predicate != pattern.p.value:
                    continue
                if c in m.links and isinstance(pattern.o, A.Literal) or c not in m.links and isinstance(pattern.o, A.Iri):
                    continue
                if c not in m.links and node or c in m.links and A.is_open(pattern.o) and apart((known or {}).get(A.key(pattern.o)), m.shape(c)):
                    continue
                if isinstance(pattern.o, A.Iri) and m.shape(c).invert(pattern.o.value) is None:
                    continue
                out.append((m, c))
        return out

    def prepare(self, patterns: list[A.Triple]) -> None:
        pass

    def scan(self, pattern: A.Triple, node: bool = False, known: dict[str, Template] | None = None, bag: bool = False) -> list[Solutions]:
        """A branch for each table; a variable predicate reads a table once for all of its columns."""
        check(pattern)
        by_table: dict[int, list[tuple[TableMap, str]]] = {}
        for m, c in self.tables(pattern, known, node):
            by_table.setdefault(id(m), []).append((m, c))
        return [self._spread(own[0][0], pattern, [c for _, c in own]) if len(own) > 1 else self._star(own[0][0], [(pattern, own[0][1])]) for own in by_table.values()]

    def _spread(self, m: TableMap, pattern: A.Triple, names: list[str]) -> Solutions:
        """One scan whose columns become rows of (predicate, object)."""
        df = m.load()
        o = pattern.o
        cells = []
        for c in names:
            shape, value = m.shape(c), F.col(c)
            here = value.isNotNull()
            if isinstance(o, A.Literal):
                here = key_test(value, m.kinds[c], o.value)
            elif isinstance(o, A.Iri):
                here = shape.equals([value], o.value)
            cells.append(F.when(here, F.struct(F.lit(c).alias("p"), shape.term([value]).alias("o"))))
        if not A.is_open(o):  # a condition that the scan can use
            df = df.where(reduce(lambda a, b: a | b, [key_test(F.col(c), m.kinds[c], o.value) if isinstance(o, A.Literal) else m.shape(c).equals([F.col(c)], o.value) for c in names]))
        slots = []
        if isinstance(pattern.s, A.Iri):
            for k, text in zip(m.keys, m.subject.invert(pattern.s.value)):
                df = df.where(key_test(F.col(k), m.kinds[k], text))
        else:
            slots.append((pattern.s, [F.col(f"__k{n}") for n in range(len(m.keys))], m.subject))
        rows = df.select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(m.keys)], F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("__cell"))
        if isinstance(pattern.p, A.Var):
            slots.append((pattern.p, [F.col("__cell.p")], Template((m.predicate_base, ""), ("string",))))
        if A.is_open(o):
            slots.append((o, [F.col("__cell.o")], Generic()))
        shapes, columns = {}, []
        for term, parts, shape in slots:
            key = A.key(term)
            if key in shapes:  # one variable in two places: the same term in both
                first, one = shapes[key]
                rows = rows.where(one.term(first) == shape.term(parts))
            else:
                shapes[key] = parts, shape
        for key, (parts, _) in shapes.items():
            columns += [c.alias(column(key, i)) for i, c in enumerate(parts)]
        return Solutions(rows.select(*columns), {key: shape for key, (_, shape) in shapes.items()})

    def star(self, patterns: list[A.Triple]) -> list[tuple[list[A.Triple], Solutions]]:
        """Patterns that can be answered together, each group with its single scan."""
        groups: dict[tuple, list[tuple[A.Triple, str]]] = {}
        for p in patterns:
            check(p)
            found = self.tables(p)
            if len(found) == 1 and isinstance(p.p, A.Iri):
                groups.setdefault((p.s, id(found[0][0])), []).append((p, found[0][1]))
        by_id = {id(m): m for m in self.maps}
        return [([p for p, _ in own], self._star(by_id[k], own)) for (_, k), own in groups.items()]

    def _star(self, m: TableMap, own: list[tuple[A.Triple, str]]) -> Solutions:
        df, columns, shapes = m.load(), [], {}
        subject = own[0][0].s
        if isinstance(subject, A.Iri):
            for k, text in zip(m.keys, m.subject.invert(subject.value)):
                df = df.where(key_test(F.col(k), m.kinds[k], text))
        else:
            key = A.key(subject)
            shapes[key] = m.subject
            columns += [(column(key, i), F.col(k)) for i, k in enumerate(m.keys)]
        for pattern, c in own:
            if isinstance(pattern.p, A.Var):
                key = A.key(pattern.p)
                iri = Template((m.predicate_base, ""), ("string",))
                if key in shapes:
                    df = df.where(F.lit(False))
                else:
                    shapes[key] = iri
                    columns.append((column(key, 0), F.lit(c)))
            shape, value = m.shape(c), F.col(c)
            if isinstance(pattern.o, A.Literal):
                df = df.where(key_test(value, m.kinds[c], pattern.o.value))
            elif isinstance(pattern.o, A.Iri):
                df = df.where(key_test(value, m.kinds[c], shape.invert(pattern.o.value)[0]))
            else:
                key = A.key(pattern.o)
                df = df.where(value.isNotNull())
                if key in shapes:
                    have = dict(columns)
                    one, two = shapes[key], shape
                    first = [have[column(key, i)] for i in range(one.width)]
                    df = df.where(first[0] == value if one == two and one.width == 1 else one.term(first) == two.term([value]))
                else:
                    shapes[key] = shape
                    columns.append((column(key, 0), value))
        return Solutions(df.select(*[c.alias(n) for n, c in columns]), shapes)
