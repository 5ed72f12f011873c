"""Results of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ontoloom.sparql import algebra as A
from ontoloom.sparql.shapes import Solutions


def to_term(row):
    """A term struct of a collected row as a constant; None if unbound."""
    if row is None:
        return None
    return {"iri": lambda: A.Iri(row.value), "blank": lambda: A.Blank(row.value), "literal": lambda: A.Literal(row.value, row.datatype, row.lang)}[row.kind]()


@dataclass
class SolutionSet:
    """Result of SELECT: ``vars`` in order, and a bag of rows that is computed on demand."""

    vars: list[str]
    solutions: Solutions
    plan_bindings: Callable[[], Solutions]

    @property
    def bindings(self) -> Solutions:
        """All variables of the pattern, projected or not."""
        return self.plan_bindings()

    def _keys(self) -> list[str]:
        return [A.key(A.Var(v)) for v in self.vars if A.key(A.Var(v)) in self.solutions.shapes]

    @property
    def df(self) -> DataFrame:
        """A term struct (kind, value, datatype, lang) per variable."""
        keys = self._keys()
        done = self.solutions.generic(keys)
        return done.df.select(*[done.parts(k)[0].alias(k[2:]) for k in keys])

    @property
    def values(self) -> DataFrame:
        """A plain column per variable: IRIs as texts, literals in their native type where it is known."""
        keys = self._keys()
        done = self.solutions.decoded(keys)
        return done.df.select(*[done.shapes[k].native(done.parts(k)).alias(k[2:]) for k in keys])

    @property
    def all_bindings(self) -> DataFrame:
        """As ``df``, with the variables that are not projected too."""
        done = self.bindings
        keys = [k for k in done.shapes if k.startswith("v_") and "___" not in k]
        done = done.generic(keys)
        return done.df.select(*[done.parts(k)[0].alias(k[2:]) for k in keys])

    def show(self, n: int = 20) -> str:
        """The first ``n`` rows as a text table, a cell per variable; unbound ones are empty."""
        lines = ["\t".join(f"?{v}" for v in self.vars)]
        for row in self.df.limit(n).collect():
            lines.append("\t".join("" if v not in row or row[v] is None else str(to_term(row[v])) for v in self.vars))
        return "\n".join(lines)

    def rows(self) -> Iterator[dict]:
        """Rows as dicts of bound terms, fetched partition by partition."""
        for row in self.df.toLocalIterator():
            yield {k: to_term(v) for k, v in row.asDict(recursive=False).items() if v is not None}


@dataclass
class Graph:
    """Result of CONSTRUCT and DESCRIBE: distinct triples (s term, p text, o term)."""

    df: DataFrame

    def triples(self) -> Iterator[A.Triple]:
        for row in self.df.toLocalIterator():
            yield A.Triple(to_term(row.s), A.Iri(row.p), to_term(row.o))
