"""Joins of solutions: on equal terms, or on compatible ones where a variable can be unbound.

An unbound variable goes with any term.  Such a join is not one on equal keys, and as a condition
``l = r or l is null or r is null`` it would compare all rows with all rows.  So each side is split by
which of its doubtful variables are unbound; between two parts it is known which variables are bound
on both sides, and the join is on these.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import chain, combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ontoloom.functions.terms import Value
from ontoloom.sparql.shapes import Solutions

#: Most parts that a join is split into; one with more is a single join on the variables that are always bound.
MOST_PARTS = 16

Test = Callable[[Callable[[str], Value | None]], Column]


def alike(a: Solutions, b: Solutions, keys) -> tuple[Solutions, Solutions]:
    """Both sides with the same shape for each of these variables."""
    different = [k for k in keys if a.shapes[k] != b.shapes[k]]
    return a.generic(different), b.generic(different)


def join(a: Solutions, b: Solutions, how: str = "inner", test: Test | None = None) -> Solutions:
    """``how``: inner, left, left_semi or left_anti.  ``test`` is a further condition over the variables of both."""
    shared = [k for k in a.shapes if k in b.shapes]
    a, b = alike(a, b, shared)
    soft = [k for k in shared if k in a.maybe or k in b.maybe]
    if not soft:
        return _matched(a, b, shared, how, test)
    hard = [k for k in shared if k not in soft]
    if how == "left":
        found, rest = join(a, b, "inner", test), join(a, b, "left_anti", test)
        return union(found, rest)
    left, right = _parts(a, soft), _parts(b, soft)
    if len(left) * len(right) > MOST_PARTS or how == "left_semi" and len(right) > 1:
        return _matched(a, b, hard, how, test, soft)
    out = []
    for unbound, part in left:
        for other, with_part in right:
            on = [k for k in shared if k not in unbound and k not in other]
            found = _matched(part, with_part, on, how, test, filled=unbound)
            if how == "inner":
                out.append(found)
            else:
                part = found
        if how != "inner":
            out.append(part)
    whole = reduce(union, out)
    return Solutions(whole.df, whole.shapes, _maybe(a, b, how))


def minus(a: Solutions, b: Solutions) -> Solutions:
    """Solutions of ``a`` that are compatible with none of ``b`` with which they share a bound variable."""
    shared = [k for k in a.shapes if k in b.shapes]
    if not shared:
        return a
    a, b = alike(a, b, shared)
    soft = [k for k in shared if k in a.maybe or k in b.maybe]
    out = []
    for unbound, part in _parts(a, soft):
        for other, with_part in _parts(b, soft):
            on = [k for k in shared if k not in unbound and k not in other]
            if on:
                part = _matched(part, with_part, on, "left_anti", None)
        out.append(part)
    return Solutions(reduce(union, out).df, a.shapes, a.maybe)


def _parts(side: Solutions, soft: list[str]) -> list[tuple[tuple[str, ...], Solutions]]:
    """The rows of a side, apart by which of the doubtful variables are unbound."""
    own = [k for k in soft if k in side.maybe]
    subsets = chain.from_iterable(combinations(own, n) for n in range(len(own) + 1))
    return [(unbound, side.with_df(reduce(lambda df, k: df.where(F.col(side.columns([k])[0]).isNull() if k in unbound else F.col(side.columns([k])[0]).isNotNull()), own, side.df))) for unbound in subsets]


def _maybe(a: Solutions, b: Solutions, how: str) -> frozenset[str]:
    if how in ("left_semi", "left_anti"):
        return a.maybe
    if how == "left":
        return a.maybe | (set(b.shapes) - set(a.shapes))
    return frozenset(k for k in (*a.shapes, *b.shapes) if (k not in a.shapes or k in a.maybe) and (k not in b.shapes or k in b.maybe))


def _matched(a: Solutions, b: Solutions, on: list[str], how: str, test: Test | None, soft: list[str] = (), filled=()) -> Solutions:
    """A join on equal terms for ``on`` and compatible ones for ``soft``; the ``filled`` variables are taken from ``b``."""
    shared = [k for k in b.shapes if k in a.shapes]
    shapes = a.shapes if how in ("left_semi", "left_anti") else {**b.shapes, **a.shapes}
    maybe = _maybe(a, b, how)
    if test is None and not soft and len(on) == len(shared):
        if on:
            other = b.only(on) if how in ("left_semi", "left_anti") else b
            return Solutions(a.df.join(other.df, a.columns(on), how), shapes, maybe)
        return Solutions(a.df.crossJoin(b.df) if how == "inner" else a.df.join(b.df, F.lit(True), how), shapes, maybe)
    other = b.renamed(shared, "__")
    taken = {*filled, *soft}

    def pick(k: str) -> list[Column]:
        mine, theirs = a.parts(k), other.parts("__" + k)
        return theirs if k in filled else [F.coalesce(x, y) for x, y in zip(mine, theirs)]

    def value(key: str) -> Value | None:
        if key in taken:
            return a.shapes[key].value(pick(key))
        return a.value(key) if key in a.shapes else other.value(key)

    conditions = [x == y for k in on for x, y in zip(a.parts(k), other.parts("__" + k))]
    for k in soft:
        same = reduce(lambda p, q: p & q, [x == y for x, y in zip(a.parts(k), other.parts("__" + k))])
        conditions.append(same | a.parts(k)[0].isNull() | other.parts("__" + k)[0].isNull())
    if test is not None:
        conditions.append(test(value))
    if not conditions and how in ("left_semi", "left_anti"):  # any row will do
        other = other.with_df(other.df.limit(1))
    df = a.df.join(other.df, reduce(lambda p, q: p & q, conditions) if conditions else F.lit(True), how)
    if how in ("inner", "left"):
        df = df.withColumns({c: x for k in taken for c, x in zip(a.columns([k]), pick(k))}) if taken else df
        df = df.drop(*other.columns(["__" + k for k in shared]))
    return Solutions(df, shapes, maybe)


def union(a: Solutions, b: Solutions) -> Solutions:
    """A bag union; a variable that one side lacks is unbound there."""
    a, b = alike(a, b, [k for k in a.shapes if k in b.shapes])
    shapes = {**a.shapes, **b.shapes}
    sides = []
    for own in (a, b):
        other = b if own is a else a
        kinds = dict(other.df.dtypes)
        missing = [c for k in shapes if k not in own.shapes for c in other.columns([k])]
        sides.append(own.df.select(*own.columns(own.shapes), *[F.lit(None).cast(kinds[c]).alias(c) for c in missing]))
    return Solutions(sides[0].unionByName(sides[1]), shapes, a.maybe | b.maybe | (set(a.shapes) ^ set(b.shapes)))
