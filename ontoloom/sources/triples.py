"""Triple sources: stored triples with inline terms, and dictionary-encoded tables.

``scan`` answers one pattern with branches, each a ``Solutions``; the planner unions them.
Patterns with an IRI object, or whose object variable is a subject elsewhere (``node``), never read
the literals, patterns with a literal object never the relations.  ``bag``: repeated rows do not
matter.  ``prepare`` is told the patterns of a query that are not scanned yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.errors import SparqlError
from ontoloom.functions import terms
from ontoloom.functions.iri import XSD, read_iris
from ontoloom.sparql import algebra as A
from ontoloom.sparql.shapes import Generic, Node, Solutions, column

RELATIONS = "s_kind string, s string, p string, o_kind string, o string"
PROPERTIES = "s_kind string, s string, p string, value string, datatype string, lang string"

#: Folders that the predicates of a stored table are spread over.
BUCKETS = 64


def bucket(predicate: Column) -> Column:
    """The folder of a predicate; of a constant it is a constant, so only that folder is read."""
    return F.pmod(F.xxhash64(predicate), F.lit(BUCKETS)).cast("int")


def check(pattern: A.Triple) -> None:
    if isinstance(pattern.s, (A.Literal, A.Triple)):
        raise SparqlError("a literal or quoted triple cannot be a subject")
    if isinstance(pattern.o, A.Triple):
        raise SparqlError("quoted triples cannot be queried")
    if not isinstance(pattern.p, (A.Iri, A.Var)):
        raise SparqlError("a predicate is an IRI or a variable")


def bind(df: DataFrame, slots: list[tuple[object, Column, object]]) -> Solutions:
    """A branch from (variable, column, shape) triples; a variable in two slots makes them equal."""
    first: dict[str, tuple[Column, object]] = {}
    for term, value, shape in slots:
        key = A.key(term)
        if key in first:
            df = df.where(first[key][0] == value)
        else:
            first[key] = value, shape
    return Solutions(df.select(*[value.alias(column(key, 0)) for key, (value, _) in first.items()]), {key: shape for key, (_, shape) in first.items()})


class InlineSource:
    """Relations (``RELATIONS``) and properties (``PROPERTIES``) whose terms are stored as texts."""

    def __init__(self, relations: DataFrame, properties: DataFrame):
        self.relations, self.properties = relations, properties

    def prepare(self, patterns: list[A.Triple]) -> None:
        pass

    def scan(self, pattern: A.Triple, node: bool = False, known: dict | None = None, bag: bool = False) -> list[Solutions]:
        check(pattern)
        out = []
        if not isinstance(pattern.o, A.Literal):
            out.append(self._branch(self.relations, pattern, terms.make_kind("o_kind", "o"), lambda o: (F.col("o_kind") == "iri") & (F.col("o") == o.value)))
        if not isinstance(pattern.o, A.Iri) and not node:
            literal = terms.make("literal", F.col("value"), F.col("datatype"), F.col("lang"))
            branch = self._branch(self.properties, pattern, literal, lambda o: F.col("value") == o.value)
            # one lexical form may be stored under several datatypes; it is one match
            out.append(branch.with_df(branch.df.distinct()) if isinstance(pattern.o, A.Literal) and not bag else branch)
        return out

    @staticmethod
    def _branch(df: DataFrame, pattern: A.Triple, o: Column, test) -> Solutions:
        slots = []
        if isinstance(pattern.p, A.Iri):
            df = df.where(F.col("p") == pattern.p.value)
            if "bucket" in df.columns:
                df = df.where(F.col("bucket") == bucket(F.lit(pattern.p.value)))
        if isinstance(pattern.s, A.Iri):
            df = df.where((F.col("s_kind") == "iri") & (F.col("s") == pattern.s.value))
        else:
            slots.append((pattern.s, terms.make_kind("s_kind", "s"), Generic()))
        if isinstance(pattern.p, A.Var):
            slots.append((pattern.p, terms.make("iri", F.col("p")), Generic()))
        if A.is_open(pattern.o):
            slots.append((pattern.o, o, Generic()))
        else:
            df = df.where(test(pattern.o))
        return bind(df, slots)


class EncodedSource:
    """Dictionary-encoded tables: relations and properties of ids, nodes (id, kind, value), predicates (id, iri).

    Predicate IRIs and literal types may be written in several ways (see ``read_iris``).  Nodes stay
    ids until their text is needed.  Repeated statements count once.  The ids of a constant predicate
    are looked up once per store, up to ``MOST_IDS``, and become a filter of the scan.
    """

    #: Most ids of one predicate IRI that are a filter; more are joined.
    MOST_IDS = 1000

    def __init__(self, relations: DataFrame, properties: DataFrame, nodes: DataFrame, predicates: DataFrame, prefixes: DataFrame | dict[str, str]):
        self.relations, self.properties, self.prefixes = relations, properties, prefixes
        self.nodes = nodes.select("id", "kind", "value")
        self.predicates = read_iris(predicates, "iri", prefixes, "term").select(F.col("id").alias("__p"), "term")
        self._ids: dict[str, list[int] | None] = {}

    def prepare(self, patterns: list[A.Triple]) -> None:
        new = {p.p.value for p in patterns if isinstance(p.p, A.Iri)} - set(self._ids)
        if not new:
            return
        found: dict[str, list[int]] = {iri: [] for iri in new}
        # the ids of all new ones together are at most so many; else each is joined
        rows = self.predicates.where(F.col("term").isin(*new) & F.col("__p").isNotNull()).distinct().limit(self.MOST_IDS + 1).collect()
        for row in rows:
            found[row.term].append(row["__p"])
        self._ids |= found if len(rows) <= self.MOST_IDS else dict.fromkeys(new)

    def scan(self, pattern: A.Triple, node: bool = False, known: dict | None = None, bag: bool = False) -> list[Solutions]:
        check(pattern)
        out = []
        if not isinstance(pattern.o, A.Literal):
            rows = self._named(self.relations.select("subject", "predicate", "object"), pattern)
            if isinstance(pattern.o, A.Iri):
                rows = self._node(rows, "object", pattern.o)
            out.append(self._bind(rows, pattern, F.col("object"), Node(self.nodes), bag))
        if not isinstance(pattern.o, A.Iri) and not node:
            rows = self._named(self.properties.select("subject", "predicate", "literal_value", "literal_type").where("literal_value is not null"), pattern)
            if isinstance(pattern.o, A.Literal):
                rows = rows.where(F.col("literal_value") == pattern.o.value)
                out.append(self._bind(rows, pattern, None, None, bag))
            else:
                typed, literal = self.literals(rows)
                out.append(self._bind(typed, pattern, literal, Generic(), bag))
        return out

    def literals(self, rows: DataFrame) -> tuple[DataFrame, Column]:
        """Property rows, and the term column of their literals."""
        raw = F.coalesce("literal_type", F.lit(""))
        # read once per distinct type: the expression is long, and the join side short
        read = read_iris(rows.select(raw.alias("__raw")).distinct(), "__raw", self.prefixes, "__type")
        typed = rows.withColumn("__raw", raw).join(read, "__raw")
        tag = F.when(F.col("__type").startswith("@"), F.substr("__type", F.lit(2)))
        datatype = F.when(tag.isNotNull(), A.RDF + "langString").when(F.col("__type") == "", XSD + "string").otherwise(F.col("__type"))
        return typed, terms.make("literal", F.col("literal_value"), datatype, tag)

    def _named(self, rows: DataFrame, pattern: A.Triple) -> DataFrame:
        self.prepare([pattern])
        ids = self._ids[pattern.p.value] if isinstance(pattern.p, A.Iri) else None
        if ids is not None:
            rows = rows.where(F.col("predicate").isin(*ids) if ids else F.lit(False))
        elif isinstance(pattern.p, A.Iri):
            rows = rows.join(self.predicates.where(F.col("term") == pattern.p.value), F.col("predicate") == F.col("__p"), "left_semi")
        else:
            rows = rows.join(self.predicates, F.col("predicate") == F.col("__p"))
        return self._node(rows, "subject", pattern.s) if isinstance(pattern.s, A.Iri) else rows

    def _node(self, rows: DataFrame, name: str, iri: A.Iri) -> DataFrame:
        known = self.nodes.where((F.col("kind") == "iri") & (F.col("value") == iri.value)).select(F.col("id").alias("__n"))
        return rows.join(known, F.col(name) == F.col("__n"), "left_semi")

    def _bind(self, rows: DataFrame, pattern: A.Triple, o: Column | None, shape, bag: bool) -> Solutions:
        slots = []
        if A.is_open(pattern.s):
            slots.append((pattern.s, F.col("subject"), Node(self.nodes)))
        if isinstance(pattern.p, A.Var):
            slots.append((pattern.p, terms.make("iri", F.col("term")), Generic()))
        if A.is_open(pattern.o):
            slots.append((pattern.o, o, shape))
        if len({A.key(t) for t, *_ in slots}) < len(slots) and len({type(s) for _, _, s in slots}) > 1:
            return self._mixed(rows, slots)
        found = bind(rows, slots)
        return found if bag else found.with_df(found.df.distinct())

    def _mixed(self, rows: DataFrame, slots) -> Solutions:
        """A variable in slots of different shapes: both become terms."""
        named = [(A.Var(f"__slot{n}"), c, s) for n, (_, c, s) in enumerate(slots)]
        all_terms = bind(rows, named)
        all_terms = all_terms.generic(list(all_terms.shapes))
        return bind(all_terms.df.distinct(), [(t, F.col(column(f"v___slot{n}", 0)), Generic()) for n, (t, *_) in enumerate(slots)])
