"""Pairs of terms that are linked by one or more steps.

From a constant the reached terms are collected front by front, each round joining only the
terms found last.  Between variables the pairs are doubled: pairs of up to k steps joined with
each other make those of up to 2k, so the rounds are logarithmic in the longest way; pairs that
were joined before are not joined again.  Every round is a written table (see ``Scratch``), so lineage stays one round long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions import terms
from ontoloom.sources.scratch import Scratch
from ontoloom.sparql import algebra as A
from ontoloom.sparql.joins import union
from ontoloom.sparql.shapes import Generic, Node, Solutions, Template, Typed, column, key_test

FROM, TO = "v_from", "v_to"


def closure(spark: SparkSession, steps: Solutions, node: A.Closure, nodes: Solutions | None) -> Solutions:
    """The solutions of a path between the terms of ``node``; ``steps`` has its single steps (v_from, v_to).

    ``nodes`` (v_node) are the terms that a path between two variables links to themselves if it may be empty.
    """
    if steps.shapes[FROM] != steps.shapes[TO]:
        steps = steps.generic([FROM, TO])
    steps = steps.with_df(steps.df.distinct())
    ends = [not A.is_open(t) for t in (node.s, node.o)]
    if node.once:
        found = steps
    else:
        scratch = Scratch(spark, "path")
        steps = steps.with_df(scratch.save(steps.df, "steps"))
        if ends[0]:
            found = _reached(steps, node.s, FROM, TO, scratch)
        elif ends[1]:
            found = _reached(steps, node.o, TO, FROM, scratch)
        else:
            found = _doubled(steps, scratch)
    for term, end in ((node.s, FROM), (node.o, TO)):
        if not A.is_open(term) and end in found.shapes:
            found = _at(found, end, term)
    if node.zero:
        found = _with_empty(spark, found, node, nodes)
    if not any(ends) and A.key(node.s) == A.key(node.o):
        same = reduce(lambda a, b: a & b, [x == y for x, y in zip(found.parts(FROM), found.parts(TO))])
        return found.with_df(found.df.where(same)).only([FROM]).renamed_to({FROM: A.key(node.s)})
    names = {end: A.key(t) for t, end in ((node.s, FROM), (node.o, TO)) if A.is_open(t)}
    out = found.only(list(names))
    out = out.with_df(out.df.distinct() if names else out.df.limit(1))
    return out.renamed_to(names)


def _with_empty(spark: SparkSession, found: Solutions, node: A.Closure, nodes: Solutions | None) -> Solutions:
    """With the ways of no step."""
    constants = [t for t in (node.s, node.o) if not A.is_open(t)]
    if nodes is not None:
        c, shape = nodes.parts("v_node"), nodes.shapes["v_node"]
        columns = [x.alias(column(end, i)) for end in (FROM, TO) for i, x in enumerate(c)]
        return union(found, Solutions(nodes.df.select(*columns).distinct(), {FROM: shape, TO: shape}))
    if len(constants) == 2 and constants[0] != constants[1]:
        return found
    one = terms.of(constants[0])
    keys = [k for k, t in ((FROM, node.s), (TO, node.o)) if A.is_open(t)] or list(found.shapes)
    itself = Solutions(spark.range(1).select(*[one.alias(column(k, 0)) for k in keys]), {k: Generic() for k in keys})
    return union(found.only(keys), itself)


def _at(found: Solutions, end: str, term) -> Solutions:
    """The rows whose end is this constant."""
    shape, parts = found.shapes[end], found.parts(end)
    if isinstance(shape, Node):
        known = shape.dictionary.where((F.col("kind") == "iri") & (F.col("value") == str(term))).select(F.col("id").alias("__id"))
        return found.with_df(found.df.join(known if isinstance(term, A.Iri) else known.limit(0), parts[0] == F.col("__id"), "left_semi"))
    if isinstance(shape, Template):
        test = shape.equals(parts, term.value) if isinstance(term, A.Iri) else F.lit(False)
    elif isinstance(shape, Typed):
        test = key_test(parts[0], shape.kind, term.value) if isinstance(term, A.Literal) else F.lit(False)
    else:
        test = (parts[0]["kind"] == ("iri" if isinstance(term, A.Iri) else "literal")) & (parts[0]["value"] == term.value)
    return found.with_df(found.df.where(test))


def _saved(scratch: Scratch, df: DataFrame, name: str) -> tuple[DataFrame, int]:
    seen = Observation()
    saved = scratch.save(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return saved, seen.get["n"]


def _reached(steps: Solutions, term, near: str, far: str, scratch: Scratch) -> Solutions:
    """(far): the terms that a constant reaches."""
    ends = steps.columns([far])
    number = 0
    front, n = _saved(scratch, _at(steps, near, term).df.select(*ends).distinct(), "reached/round=0")
    while n:
        number += 1
        known = scratch.read("reached", front.schema)
        here = front.withColumnsRenamed(dict(zip(ends, steps.columns([near]))))
        further = steps.df.join(here, steps.columns([near]), "left_semi").select(*ends).distinct()
        front, n = _saved(scratch, further.join(known, ends, "left_anti"), f"reached/round={number}")
    return Solutions(scratch.read("reached", front.schema), {far: steps.shapes[far]})


def _doubled(steps: Solutions, scratch: Scratch) -> Solutions:
    """All pairs; a round joins only what has a part that the last round found, and writes only what is new."""
    a, b = steps.columns([FROM]), steps.columns([TO])

    def joined(first: DataFrame, then: DataFrame) -> DataFrame:
        onward = then.select(*[F.col(c).alias(f"__{c}") for c in (*a, *b)])
        meet = reduce(lambda p, q: p & q, [F.col(y) == F.col(f"__{x}") for x, y in zip(a, b)])
        return first.join(onward, meet).select(*a, *[F.col(f"__{c}").alias(c) for c in b])

    number = 0
    new, n = _saved(scratch, steps.df, "pairs/round=0")
    known = new
    while n:
        number += 1
        longer = joined(new, known) if number == 1 else joined(new, known).unionByName(joined(known, new))
        new, n = _saved(scratch, longer.distinct().join(known, [*a, *b], "left_anti"), f"pairs/round={number}")
        known = scratch.read("pairs", steps.df.schema)
    return steps.with_df(known)
