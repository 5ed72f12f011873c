"""Algebra to DataFrames.

A basic graph pattern becomes units: the patterns of one subject over one mapped table together,
every other pattern alone.  Units are joined greedily, those with most constants first and
never by a cross product while a connected one is left; a unit without new variables is a
semi-join.  Variables that can be unbound join by compatibility, split into equi-joins (see
``joins``).  Physical strategies are left to Catalyst and adaptive execution.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.errors import SparqlError
from ontoloom.functions import terms
from ontoloom.functions.terms import TERM, Value
from ontoloom.sources.mapping import MappedSource
from ontoloom.sparql import algebra as A
from ontoloom.sparql.correlation import exists_in, lifted, replaced, scope
from ontoloom.sparql.expressions import Compiler
from ontoloom.sparql.joins import alike, join, minus, union
from ontoloom.sparql.paths import closure
from ontoloom.sparql.shapes import Generic, Solutions, Template, Typed, column


@dataclass
class Unit:
    patterns: list[A.Triple]
    solutions: Solutions
    #: Makes the same with repeated rows, where these cost less and do not matter.
    bag: Callable[[], Solutions] | None = None

    @property
    def constants(self) -> int:
        return sum(not A.is_open(t) for p in self.patterns for t in (p.s, p.o))

    @property
    def keys(self) -> set[str]:
        return set(self.solutions.shapes)


class Planner:
    def __init__(self, spark: SparkSession, sources: list, strict: bool = False):
        self.spark, self.sources, self.strict = spark, sources, strict
        self.fresh = itertools.count()
        #: Templates of variables that what is being planned is joined with; only tables of these can answer for them.
        self.known: dict[str, Template] = {}

    def plan(self, node, known: dict[str, Template] | None = None) -> Solutions:
        """``known``: what is known of the variables from outside, if not what was known before."""
        before = self.known
        self.known = before if known is None else known
        try:
            return getattr(self, "_" + type(node).__name__.lower())(node)
        finally:
            self.known = before

    @staticmethod
    def _templates(done: Solutions) -> dict[str, Template]:
        return {k: s for k, s in done.shapes.items() if isinstance(s, Template) and k not in done.maybe}

    # patterns
    def _bgp(self, node: A.Bgp) -> Solutions:
        if not node.patterns:
            return Solutions(self.spark.range(1).select(), {})
        left = self._units(node.patterns)
        left.sort(key=lambda u: -u.constants)
        first = next((u for u in left if u.keys), left[0])
        left.remove(first)
        done = self._exists(Solutions(self.spark.range(1).select(), {}), first) if not first.keys else first.solutions
        while left:
            bound = set(done.shapes)
            unit = min(left, key=lambda u: (bool(u.keys) and not u.keys & bound, bool(u.keys - bound), -u.constants))
            left.remove(unit)
            if not unit.keys:
                done = self._exists(done, unit)
            elif unit.keys <= bound:
                done = join(done, unit.bag() if unit.bag else unit.solutions, "left_semi")
            else:
                done = join(done, unit.solutions)
        return done

    def _units(self, patterns: list[A.Triple]) -> list[Unit]:
        units: list[Unit] = []
        mapped = len(self.sources) == 1 and isinstance(self.sources[0], MappedSource)
        if mapped:
            merged = self.sources[0].star(patterns)
            units = [Unit(own, solutions) for own, solutions in merged]
        taken = {id(p) for u in units for p in u.patterns}
        known = self.known | {k: s for u in units for k, s in u.solutions.shapes.items() if isinstance(s, Template)}
        subjects = {A.key(p.s) for p in patterns if A.is_open(p.s)}
        for source in self.sources:
            source.prepare(patterns)
        for p in patterns:
            if id(p) not in taken:
                keys = [A.key(t) for t in (p.s, p.p, p.o) if A.is_open(t)]
                # what is a subject elsewhere is no literal here
                node = A.is_open(p.o) and A.key(p.o) in subjects

                def scanned(bag: bool = True, p=p, keys=keys, node=node) -> Solutions:
                    return self._union_all([b for s in self.sources for b in s.scan(p, node, known, bag)], keys)

                units.append(Unit([p], scanned(False), scanned))
        return units

    def _union_all(self, branches: list[Solutions], keys: list[str]) -> Solutions:
        keys = list(dict.fromkeys(keys))
        if not branches:
            schema = ", ".join(f"`{column(k, 0)}` {TERM.simpleString()}" for k in keys) or "x int"
            empty = self.spark.createDataFrame([], schema)
            return Solutions(empty if keys else empty.select(), {k: Generic() for k in keys})
        return reduce(union, branches)

    @staticmethod
    def _exists(done: Solutions, unit: Unit) -> Solutions:
        """A pattern without variables keeps all rows or none; its side is at most one row."""
        one = unit.solutions.df.limit(1).select(F.lit(1).alias("__one"))
        return done.with_df(done.df.crossJoin(F.broadcast(one)).drop("__one"))

    def _join(self, node: A.Join) -> Solutions:
        left = self.plan(node.left)
        return join(left, self._closure(node.right, left) if isinstance(node.right, A.Closure) else self.plan(node.right, self.known | self._templates(left)))

    def _closure(self, node: A.Closure, near: Solutions | None = None) -> Solutions:
        """``near``: solutions that the pairs are joined with, whose terms are all that can be linked to themselves."""
        a, b = A.key(node.a), A.key(node.b)
        nodes = None
        if node.zero and A.is_open(node.s) and A.is_open(node.o):
            bound = [A.key(t) for t in (node.s, node.o) if near is not None and A.key(t) in near.shapes and A.key(t) not in near.maybe]
            if bound:
                nodes = near.only(bound[:1]).renamed_to({bound[0]: "v_node"})
            else:
                s, p, o = (A.Var(f"__any{n}") for n in range(3))
                every = self.plan(A.Bgp([A.Triple(s, p, o)]), {})
                nodes = union(*(every.only([A.key(t)]).renamed_to({A.key(t): "v_node"}) for t in (s, o)))
        return closure(self.spark, self.plan(node.step, {}).only([a, b]).renamed_to({a: "v_from", b: "v_to"}), node, nodes)

    def _leftjoin(self, node: A.LeftJoin) -> Solutions:
        left = self.plan(node.left)
        # of the optional part, only what can match the left counts; what is known from further out must not decide whether it matches
        right = self.plan(node.right, self._templates(left))
        if node.expr is None:
            return join(left, right, "left")
        parts = conjuncts(node.expr)
        own = [p for p in parts if exists_in(p)]
        if own:  # a subquery is no join condition, but one about the optional part alone is a filter of it
            if {A.key(A.Var(v)) for p in own for v in scope(p)} & set(left.shapes) - set(right.shapes):
                raise SparqlError("EXISTS in OPTIONAL can only use variables of the optional part")
            right = self._where(right, own)
            parts = [p for p in parts if not exists_in(p)]
        return self._conditional(left, right, parts, "left")

    def _conditional(self, left: Solutions, right: Solutions, parts: list, how: str) -> Solutions:
        """A join whose rows must also pass these conditions over the variables of both sides."""
        used = [A.key(A.Var(v)) for p in parts for v in A.expr_vars(p)]
        left, right = left.decoded(used), right.decoded([k for k in used if k not in left.shapes or k in left.maybe])

        def test(value) -> Column:
            compiler = Compiler(lambda name: value(A.key(A.Var(name))), self.strict)
            return reduce(lambda a, b: a & b, [truth(compiler.compile(p)) for p in parts])

        return join(left, right, how, test if parts else None)

    def _union(self, node: A.Union) -> Solutions:
        return union(self.plan(node.left), self.plan(node.right))

    def _minus(self, node: A.Minus) -> Solutions:
        return minus(self.plan(node.left), self.plan(node.right, {}))

    def _values(self, node: A.Values) -> Solutions:
        keys = [A.key(A.Var(v)) for v in node.vars]
        rows = [tuple(None if t is None else _row(t) for t in row) for row in node.rows]
        df = self.spark.createDataFrame(rows, ", ".join(f"`{column(k, 0)}` {TERM.simpleString()}" for k in keys))
        maybe = frozenset(k for n, k in enumerate(keys) if any(row[n] is None for row in rows))
        return Solutions(df, {k: Generic() for k in keys}, maybe)

    # expressions
    def _filter(self, node: A.Filter) -> Solutions:
        return self._where(self.plan(node.inner), conjuncts(node.expr))

    def _where(self, done: Solutions, parts: list) -> Solutions:
        for part in parts:
            negative = isinstance(part, A.Call) and part.name == "!" and isinstance(part.args[0], A.Call) and part.args[0].name == "EXISTS"
            if negative or isinstance(part, A.Call) and part.name == "EXISTS":
                branches = self._branches((part.args[0] if negative else part).args[0], done)
                if negative or len(branches) == 1:
                    for inner, conditions in branches:
                        done = self._subquery(done, inner, conditions, negative)
                    continue
            done, compiler, extra = self._ready(done, part)
            done = done.with_df(done.df.where(truth(compiler.compile(part))).drop(*extra))
            if isinstance(part, A.Call) and part.name == "BOUND":
                done = Solutions(done.df, done.shapes, done.maybe - {A.key(part.args[0])})
        return done

    def _branches(self, pattern, done: Solutions) -> list[tuple[Solutions, list]]:
        """The alternatives of an EXISTS pattern, each with the conditions that use variables of ``done``."""
        outer = {k[2:] for k in done.shapes if k.startswith("v_")}
        return [(self.plan(p, self._templates(done)), conditions) for p, conditions in lifted(pattern, outer)]

    def _subquery(self, done: Solutions, inner: Solutions, conditions: list, negative: bool) -> Solutions:
        if conditions or set(inner.shapes) & set(done.shapes):
            return self._conditional(done, inner, conditions, "left_anti" if negative else "left_semi")
        one = inner.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("__some"))
        return done.with_df(done.df.crossJoin(F.broadcast(one)).where(F.col("__some") != F.lit(negative)).drop("__some"))

    def _ready(self, done: Solutions, expr) -> tuple[Solutions, Compiler, list[str]]:
        """``done`` with all that an expression reads, its compiler, and columns that are of no use after it."""
        found: dict[int, list] = {}
        for call in exists_in(expr):
            branches = []
            for inner, conditions in self._branches(call.args[0], done):
                used = [A.key(A.Var(v)) for p in conditions for v in A.expr_vars(p)]
                done, inner = alike(done.decoded(used), inner.decoded(used), [k for k in inner.shapes if k in done.shapes])
                branches.append((inner, conditions))
            found[id(call.args[0])] = branches
        done = done.decoded([A.key(A.Var(v)) for v in A.expr_vars(expr)])
        for branches in found.values():  # a later pattern may have changed how a variable is held
            branches[:] = [(alike(done, inner, [k for k in inner.shapes if k in done.shapes])[1], conditions) for inner, conditions in branches]

        # outer references go by names that no part of a subquery has
        outer = {c: f"__out{next(self.fresh)}_{c}" for c in done.df.columns} if found else {}
        if outer:
            done = done.with_df(done.df.select("*", *[F.col(c).alias(name) for c, name in outer.items()]))

        def exists(pattern) -> Column:
            return reduce(lambda a, b: a | b, [self._exists_column(done, inner, conditions, outer) for inner, conditions in found[id(pattern)]])

        return done, Compiler(lambda name: done.value(A.key(A.Var(name))), self.strict, exists), list(outer.values())

    def _exists_column(self, done: Solutions, inner: Solutions, conditions: list, outer: dict[str, str]) -> Column:
        """Has ``inner`` a row that goes with the row of ``done``?  A correlated subquery, which Catalyst makes a join."""

        def of_row(k: str) -> list[Column]:
            return [F.col(outer[c]).outer() for c in done.columns([k])]

        def value(name: str) -> Value | None:
            k = A.key(A.Var(name))
            return inner.value(k) or (done.shapes[k].value(of_row(k)) if k in done.shapes else None)

        tests = []
        for k in (k for k in inner.shapes if k in done.shapes):
            same = reduce(lambda a, b: a & b, [x == y for x, y in zip(inner.parts(k), of_row(k))])
            if k in inner.maybe | done.maybe:
                same = same | inner.parts(k)[0].isNull() | of_row(k)[0].isNull()
            tests.append(same)
        compiler = Compiler(value, self.strict)
        tests += [truth(compiler.compile(p)) for p in conditions]
        return (inner.df.where(reduce(lambda a, b: a & b, tests)) if tests else inner.df.limit(1)).exists()

    def _extend(self, node: A.Extend) -> Solutions:
        done = self.plan(node.inner)
        key = A.key(A.Var(node.var))
        if key in done.shapes:
            raise SparqlError(f"?{node.var} is bound already")
        if isinstance(node.expr, A.Var):
            source = A.key(node.expr)
            if source not in done.shapes:
                return Solutions(done.df.withColumn(column(key, 0), F.lit(None).cast(TERM)), {**done.shapes, key: Generic()}, done.maybe | {key})
            copies = {column(key, i): c for i, c in enumerate(done.parts(source))}
            return Solutions(done.df.withColumns(copies), {**done.shapes, key: done.shapes[source]}, done.maybe | ({key} if source in done.maybe else set()))
        return self._bound(done, key, node.expr)

    def _bound(self, done: Solutions, key: str, expr) -> Solutions:
        """``done`` with a variable for the value of an expression."""
        calls = exists_in(expr)
        if calls:  # a subquery cannot be a column, so the rows that have a match and those that have none go apart
            parts = [(yes, self._where(done, [calls[0] if yes else A.Call("!", (calls[0],))])) for yes in (True, False)]
            return union(*(self._bound(part, key, replaced(expr, calls[0], A.Literal(str(yes).lower(), A.XSD + "boolean"))) for yes, part in parts))
        done = done.decoded([A.key(A.Var(v)) for v in A.expr_vars(expr)])
        c, shape = typed(self._compiler(done).compile(expr))
        certain = isinstance(expr, (A.Iri, A.Literal))
        return Solutions(done.df.withColumn(column(key, 0), c), {**done.shapes, key: shape}, done.maybe | (set() if certain else {key}))

    def _compiler(self, done: Solutions) -> Compiler:
        return Compiler(lambda name: done.value(A.key(A.Var(name))), self.strict)

    def _group(self, node: A.Group) -> Solutions:
        done = self.plan(node.inner)
        done = done.decoded([A.key(A.Var(v)) for _, a in node.aggregates if a.arg is not None and a.name != "COUNT" for v in A.expr_vars(a.arg)])
        keys = [A.key(A.Var(k)) for k in node.keys if A.key(A.Var(k)) in done.shapes]
        shapes = {k: done.shapes[k] for k in keys}
        aggregates = []
        for name, a in node.aggregates:
            c, shape = self._aggregate(done, a)
            shapes[A.key(A.Var(name))] = shape
            aggregates.append(c.alias(column(A.key(A.Var(name)), 0)))
        grouped = done.df.groupBy(*done.columns(keys))
        maybe = (done.maybe & set(keys)) | {A.key(A.Var(name)) for name, a in node.aggregates if a.name in ("MIN", "MAX", "SAMPLE")}
        return Solutions(grouped.agg(*aggregates) if aggregates else grouped.agg(F.count(F.lit(1)).alias("__n")).drop("__n"), shapes, maybe)

    def _aggregate(self, done: Solutions, a: A.Aggregate) -> tuple[Column, object]:
        if a.arg is None:
            rows = F.struct(*[F.col(c) for c in done.df.columns]) if done.df.columns else F.lit(1)
            return (F.count_distinct(rows) if a.distinct else F.count(F.lit(1))), Typed("bigint")
        if a.name == "COUNT" and isinstance(a.arg, A.Var):
            key = A.key(a.arg)
            if key not in done.shapes:
                return F.sum(F.lit(0)).cast("bigint"), Typed("bigint")
            parts = done.parts(key)
            return (F.count_distinct(*parts) if a.distinct else F.count(parts[0])), Typed("bigint")
        value = self._compiler(done).compile(a.arg)
        number, text = value.as_number(), value.as_text()
        if a.name in ("SUM", "AVG"):
            f = {"SUM": F.sum_distinct if a.distinct else F.sum, "AVG": F.avg}[a.name]
            c = F.sum_distinct(number) / F.count_distinct(number) if a.distinct and a.name == "AVG" else f(number)
            return F.coalesce(c, F.lit(0.0)), Typed("double")
        if a.name == "COUNT":
            return (F.count_distinct(text) if a.distinct else F.count(value.tags())), Typed("bigint")
        if a.name == "GROUP_CONCAT":
            parts = F.collect_set(text) if a.distinct else F.collect_list(text)
            return F.array_join(F.array_sort(parts), a.separator), Typed("string")
        if a.name == "SAMPLE":
            c, shape = typed(value)
            return F.min(c), shape
        f = F.min if a.name == "MIN" else F.max
        if isinstance(value.tag, str):
            c, shape = typed(value)
            return f(c), shape
        # numbers before texts, each by its own order
        return f(F.struct(value.slot("n").isNull().alias("t"), value.slot("n").alias("n"), value.slot("s").alias("s"), value.term.alias("term") if value.term is not None else typed(value)[0].alias("term")))["term"], Generic()

    # modifiers
    def _project(self, node: A.Project) -> Solutions:
        keys = [A.key(A.Var(v)) for v in node.vars]
        return self.plan(node.inner, {k: s for k, s in self.known.items() if k in keys}).only(keys)

    def _distinct(self, node: A.Distinct) -> Solutions:
        done = self.plan(node.inner)
        return done.with_df(done.df.distinct())

    def _orderby(self, node: A.OrderBy) -> Solutions:
        done = self.plan(node.inner)
        for expr, _ in node.keys:
            done = done.decoded([A.key(A.Var(v)) for v in A.expr_vars(expr)])
        keys = []
        for expr, up in node.keys:
            v = self._compiler(done).compile(expr)
            if isinstance(v.tag, str):
                parts = [v.slot(v.tag)]
            else:
                rank = F.when(v.tag.isNull(), 0).when(v.tag == "k", 1).when(v.tag == "i", 2).otherwise(3)
                parts = [rank, F.when(v.tag == "n", v.slot("n")), F.when(v.tag == "b", v.slot("b")), v.slot("s")]
            keys += [p.asc_nulls_first() if up else p.desc_nulls_last() for p in parts]
        return done.with_df(done.df.orderBy(*keys))

    def _slice(self, node: A.Slice) -> Solutions:
        done = self.plan(node.inner, {})
        df = done.df.offset(node.offset) if node.offset else done.df
        return done.with_df(df if node.limit is None else df.limit(node.limit))

    # graphs
    def construct(self, template: list[A.Triple], pattern) -> DataFrame:
        """The triples (s, p, o) of a template, each once; p is an IRI text."""
        done = self.plan(pattern)
        used = {A.key(t) for triple in template for t in (triple.s, triple.p, triple.o) if isinstance(t, A.Var)}
        fresh = any(isinstance(t, A.Blank) for triple in template for t in (triple.s, triple.o))
        if not fresh:
            done = done.only([k for k in done.shapes if k in used])
        done = done.generic([k for k in done.shapes if k in used])
        row = None
        if fresh:  # labels that a repeated task makes again: a hash of the row, and its number among equal rows
            # equal rows are counted, which combines on the map side, and numbered from their count
            names = done.df.columns
            counted = done.df.groupBy(*names).agg(F.count(F.lit(1)).alias("__count"))
            hashed = counted.withColumn("__hash", F.xxhash64(*[F.col(c) for c in names]) if names else F.lit(0).cast("bigint"))
            done = done.with_df(hashed.where("__count > 0").withColumn("__n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__count")))).drop("__count"))
            row = F.concat(F.lit("b"), F.hex("__hash"), F.lit("_"), F.col("__n").cast("string"), F.lit("_"))
        out = []
        for triple in template:
            s, p, o = (self._slot(done, t, row) for t in (triple.s, triple.p, triple.o))
            if s is None or p is None or o is None or isinstance(triple.s, (A.Literal, A.Triple)):
                continue
            rows = done.df.select(s.alias("s"), p.alias("p"), o.alias("o")).where("s.kind in ('iri', 'blank') and p.kind = 'iri' and o is not null")
            out.append(rows.select("s", F.col("p.value").alias("p"), "o"))
        if not out:
            return self.spark.createDataFrame([], f"s {TERM.simpleString()}, p string, o {TERM.simpleString()}")
        return reduce(DataFrame.unionByName, out).distinct()

    @staticmethod
    def _slot(done: Solutions, term, row: Column | None) -> Column | None:
        if isinstance(term, A.Triple):
            return None
        if isinstance(term, A.Var):
            return done.parts(A.key(term))[0] if A.key(term) in done.shapes else None
        return terms.make("blank", F.concat(row, F.lit(term.label))) if isinstance(term, A.Blank) else terms.of(term)


def _row(term) -> tuple:
    return ("iri", term.value, None, None) if isinstance(term, A.Iri) else ("literal", term.value, term.datatype, term.lang)


def conjuncts(expr) -> list:
    return [c for a in expr.args for c in conjuncts(a)] if isinstance(expr, A.Call) and expr.name == "&&" else [expr]


def truth(value: Value) -> Column:
    """A condition; a null one drops the row as false does, and the bare comparison can reach the scan."""
    return value.slot("b") if value.tag == "b" else value.truth()


def typed(value: Value) -> tuple[Column, object]:
    """A computed value as a column and its shape."""
    if isinstance(value.tag, str) and value.tag in "bns":
        return value.slot(value.tag), Typed({"b": "boolean", "n": "double", "s": "string"}[value.tag])
    if isinstance(value.tag, str):
        return terms.make("iri" if value.tag == "i" else "blank", value.slot("s")), Generic()
    if value.term is not None:
        return value.term, Generic()
    parts = {"b": terms.make("literal", value.slot("b").cast("string"), F.lit(A.XSD + "boolean")), "n": terms.make("literal", terms.number_text(value.slot("n")), F.lit(A.XSD + "double")), "s": terms.make("literal", value.slot("s"), F.lit(A.XSD + "string")), "i": terms.make("iri", value.slot("s"))}
    return F.coalesce(*[F.when(value.tags() == t, c) for t, c in parts.items()]), Generic()
