"""Queries and the id API over dictionary-encoded tables that exist already."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.errors import DataError, SparqlError
from ontoloom.functions import terms
from ontoloom.functions.iri import prefix_map
from ontoloom.sources.triples import EncodedSource
from ontoloom.sparql import algebra as A
from ontoloom.sparql.lexer import tokens
from ontoloom.sparql.result import Graph
from ontoloom.store import ElementType, Engine


class EncodedStore(Engine):
    """Read-only; ids are those of the tables."""

    def __init__(self, spark: SparkSession, relations: DataFrame, properties: DataFrame, nodes: DataFrame, predicates: DataFrame, prefixes: DataFrame, strict: bool = False):
        known = prefix_map(prefixes)
        self.source = EncodedSource(relations, properties, nodes, predicates, prefixes if known is None else known)
        super().__init__(spark, [self.source], known, strict)
        self._more_prefixes = prefixes if known is None else None

    def prefixes_of(self, text: str) -> dict[str, str]:
        """Of a table too large for a map, just those that the text uses."""
        if self._more_prefixes is None:
            return self.prefixes
        used = {t.text.partition(":")[0] for t in tokens(text, SparqlError) if t.kind == "curie"}
        rows = self._more_prefixes.where(F.col("prefix").isin(*used) & F.col("namespace").isNotNull())
        return {r.prefix: r.namespace for r in rows.groupBy("prefix").agg(F.min("namespace").alias("namespace")).collect()}

    def get_id_from_iri(self, iri: str, element: ElementType = ElementType.OBJECT) -> int | None:
        """The smallest id of a node, or of a predicate however its IRI is written."""
        if element is ElementType.PREDICATE:
            found = self.source.predicates.where(F.col("term") == iri).select(F.col("__p").alias("id"))
        else:
            found = self.source.nodes.where(F.col("value") == iri).select("id")
        return found.agg(F.min("id").alias("id")).head().id

    def _graph(self, relations: DataFrame, properties: DataFrame) -> Graph:
        src = self.source
        p = src.predicates
        s = src.nodes.select(F.col("id").alias("__s"), terms.make_kind("kind", "value").alias("s"))
        o = src.nodes.select(F.col("id").alias("__o"), terms.make_kind("kind", "value").alias("o"))
        one = relations.select("subject", "predicate", "object").join(p, F.col("predicate") == F.col("__p")).join(s, F.col("subject") == F.col("__s")).join(o, F.col("object") == F.col("__o"))
        typed, literal = src.literals(properties.where("literal_value is not null"))
        two = typed.join(p, F.col("predicate") == F.col("__p")).join(s, F.col("subject") == F.col("__s")).select("s", F.col("term").alias("p"), literal.alias("o"))
        return Graph(one.select("s", F.col("term").alias("p"), "o").unionByName(two).distinct())

    def describe_object_by_id(self, number: int) -> Graph:
        """The distinct triples from and to a node."""
        if self.source.nodes.where(F.col("id") == number).isEmpty():
            raise DataError(f"no object has the id {number}")
        r, q = self.source.relations, self.source.properties
        return self._graph(r.where((F.col("subject") == number) | (F.col("object") == number)), q.where(F.col("subject") == number))

    def describe_predicate_by_id(self, number: int) -> Graph:
        """The distinct triples of this predicate id."""
        r, q = self.source.relations, self.source.properties
        return self._graph(r.where(F.col("predicate") == number), q.where(F.col("predicate") == number))

    def get_relation_subject_list(self, predicate: str, obj: str) -> DataFrame:
        """(subject, subject_id, object_id) of the relations with this predicate and object IRI."""
        src = self.source
        rows = src._named(src.relations.select("subject", "predicate", "object"), A.Triple(A.Var("s"), A.Iri(predicate), A.Iri(obj)))
        rows = src._node(rows, "object", A.Iri(obj)).select("subject", "object").distinct()
        return rows.join(src.nodes, F.col("subject") == F.col("id")).select(F.col("value").alias("subject"), F.col("subject").alias("subject_id"), F.col("object").alias("object_id"))
