"""The triple store: set-semantics tables in a folder, SPARQL over them, ids and descriptions."""

from __future__ import annotations

import json
import logging
import os
import re
from collections.abc import Iterable, Iterator
from enum import Enum
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.errors import DataError, SparqlError, StoreError
from ontoloom.functions import terms
from ontoloom.sources import rdfxml, statements
from ontoloom.sources.scratch import Scratch
from ontoloom.sources.triples import InlineSource, bucket
from ontoloom.sparql import algebra as A
from ontoloom.sparql.parser import in_scope, parse
from ontoloom.sparql.planner import Planner
from ontoloom.sparql.result import Graph, SolutionSet, to_term

log = logging.getLogger(__name__)

#: Stored tables and their key columns, which are all of their columns.
TABLES = {
    "relations": ["s_kind", "s", "p", "o_kind", "o"],
    "properties": ["s_kind", "s", "p", "value", "datatype", "lang"],
    "annotations": ["s_kind", "s", "p", "quoted"],
    "quoted": ["quoted", "s_kind", "s", "p", "o_kind", "o", "datatype", "lang"],
}
#: The schemes that need no prefix when an IRI is written by itself.
SCHEMES = ("http://", "https://", "urn:", "ftp://")


class ElementType(Enum):
    OBJECT = "object"
    PREDICATE = "predicate"


def node_id(kind, value):
    """The id of a node: a hash of what it is, so it needs no counter and no lock."""
    return F.xxhash64(kind, value)


class Engine:
    """SPARQL over any sources; a store is one of them."""

    def __init__(self, spark: SparkSession, sources: list, prefixes: dict[str, str] | None = None, strict: bool = False):
        self.spark, self._sources, self.prefixes, self.strict = spark, sources, dict(prefixes or {}), strict

    def sources(self) -> list:
        return self._sources

    def prefixes_of(self, text: str) -> dict[str, str]:
        """The prefixes that a query may use without declaring them."""
        return self.prefixes

    def query(self, text: str) -> SolutionSet | Graph | bool:
        """SELECT gives a SolutionSet, CONSTRUCT and DESCRIBE a Graph, ASK a bool."""
        query = parse(text, self.prefixes_of(text))
        planner = Planner(self.spark, self.sources(), self.strict)
        if query.form == "construct":
            return Graph(planner.construct(query.template, query.pattern))
        if query.form == "ask":
            return not planner.plan(query.pattern).df.limit(1).isEmpty()
        if query.form == "describe":
            return Graph(self._describe(planner, query))
        node, inner = query.pattern, query.pattern
        while isinstance(inner, (A.Distinct, A.Slice, A.OrderBy)):
            inner = inner.inner
        body = inner.inner if isinstance(inner, A.Project) else inner
        return SolutionSet(query.vars, planner.plan(node), lambda: planner.plan(body))

    def _describe(self, planner: Planner, query: A.Query) -> DataFrame:
        parts = []
        for term in query.described or [A.Var(v) for v in in_scope(query.pattern)]:
            if isinstance(term, A.Var) and query.pattern is None:
                raise SparqlError("DESCRIBE of a variable needs a WHERE")
            s, p, o = A.Var("__s"), A.Var("__p"), A.Var("__o")
            for pattern in (A.Triple(term, p, o), A.Triple(s, p, term)):
                body = A.Bgp([pattern])
                if isinstance(term, A.Var):
                    body = A.Join(A.Distinct(A.Project(query.pattern, [term.name])), body)
                parts.append(planner.construct([pattern], body))
        return reduce(DataFrame.unionByName, parts).distinct()


class TripleStore(Engine):
    """Triples under ``path``, or in the session's shared scratch folder if there is none.

    Inserts have set semantics and are appended with an anti-join against what is stored.  Tables
    are spread over folders by predicate, so a constant predicate reads one of them; a folder's rows
    are written by as many tasks as their size asks for.  ``compact`` merges the files of many
    inserts.  One writer at a time.  ``assert_quoted``: quoting a triple also asserts it.
    """

    #: Most prefixes that a store registers; they are held by the driver.
    MOST_PREFIXES = 10_000

    def __init__(self, spark: SparkSession, path: str | None = None, strict: bool = False, assert_quoted: bool = False):
        super().__init__(spark, [], strict=strict)
        self.path, self.assert_quoted = (path or Scratch(spark, "store").root).rstrip("/"), assert_quoted
        jvm = spark.sparkContext._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.migrate()
        self._prefixes_from_disk()

    @classmethod
    def new_from_env(cls, spark: SparkSession, variable: str = "ONTOLOOM_STORE") -> TripleStore:
        """The store in the folder that an environment variable names."""
        if variable not in os.environ:
            raise StoreError(f"{variable} is not set")
        return cls(spark, os.environ[variable])

    # tables
    def migrate(self) -> None:
        """Make the folders of tables that do not exist yet; one whose ``compact`` was cut off gets its old rows back."""
        for name in TABLES:
            whole, old = self._hadoop(name), self._hadoop(f"{name}.old")
            if self._fs.exists(old) and not self._fs.exists(whole):
                self._fs.rename(old, whole)
            self._fs.mkdirs(whole)

    def compact(self) -> None:
        """Merge the files that inserts have left; the triples stay as they are.  It is a write: nothing else may write meanwhile."""
        for name in TABLES:
            whole, old, new = (self._hadoop(name + end) for end in ("", ".old", ".new"))
            for left in (old, new):
                self._fs.delete(left, True)
            if self._fs.getContentSummary(whole).getFileCount() == 0:
                continue
            self._write(self.table(name), f"{name}.new")
            self._fs.rename(whole, old)
            if self._fs.exists(whole):
                raise StoreError(f"{name} was written while it was compacted")
            self._fs.rename(new, whole)
            self._fs.delete(old, True)

    def _write(self, rows: DataFrame, name: str) -> None:
        """Append rows to their folders; a predicate with most rows is split between tasks by size."""
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "p", "s").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def reset_db(self) -> None:
        """Remove all triples and prefixes."""
        self._fs.delete(self._root, True)
        self.prefixes = {}
        self.migrate()

    def _hadoop(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        schema = ", ".join(f"{c} string" for c in TABLES[name]) + ", bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def sources(self) -> list:
        return [InlineSource(self.table("relations"), self.table("properties"))]

    def _append(self, name: str, rows: DataFrame) -> None:
        keys = TABLES[name]
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        if not touched:
            return
        # only the folders that the new rows go to are read, at most ``BUCKETS`` of them
        stored = self.table(name).where(F.col("bucket").isin(touched)).select([F.col(k).alias(f"__{k}") for k in keys])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        new = rows.select(*keys, "bucket").distinct().join(stored, same, "left_anti")
        self._write(new, name)

    # inserts
    def insert_triple(self, triple: A.Triple) -> None:
        self.insert_triples([triple])

    def insert_triples(self, triples: Iterable[A.Triple]) -> None:
        self.insert_statements(self.spark.createDataFrame(list(statements.rows(triples)), statements.STATEMENT))

    def insert_statements(self, rows: DataFrame) -> None:
        """Insert rows of the schema ``statements.STATEMENT``, and register the prefixes among them.

        Of several namespaces of a prefix the last (by text) counts; more than ``MOST_PREFIXES``
        prefixes raise StoreError before anything is inserted.
        """
        # parsed once: the branches below each read it
        scratch = Scratch(self.spark, "insert")
        rows = scratch.save(rows.withColumn("bucket", bucket(F.col("p"))), "rows")
        self._register(rows.where("s_kind = 'prefix'"))
        rows = rows.where("s_kind != 'prefix'")
        rows = rows if not self.assert_quoted else rows.unionByName(rows.where("not asserted").withColumn("asserted", F.lit(True)))
        told = rows.where("asserted")
        self._append("relations", told.where("o_kind in ('iri', 'blank')"))
        self._append("properties", told.where("o_kind = 'literal'").withColumnRenamed("o", "value"))
        self._append("annotations", told.where("o_kind = 'triple'").withColumnRenamed("o", "quoted"))
        quoted = rows.where("not asserted")
        o = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).when(F.col("o_kind") == "blank", F.concat(F.lit("_:"), "o")).when(F.col("o_kind") == "triple", F.col("o"))
        text = F.col("o")
        for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        literal = F.concat(F.lit('"'), text, F.lit('"'), F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).otherwise(F.concat(F.lit("^^<"), "datatype", F.lit(">"))))
        s = F.when(F.col("s_kind") == "iri", F.concat(F.lit("<"), "s", F.lit(">"))).otherwise(F.concat(F.lit("_:"), "s"))
        self._append("quoted", quoted.withColumn("quoted", F.concat(F.lit("<<( "), s, F.lit(" <"), "p", F.lit("> "), F.coalesce(o, literal), F.lit(" )>>"))))
        scratch.drop("rows")

    def import_turtle_data(self, text: str) -> None:
        self.insert_statements(statements.from_text(self.spark, text, "turtle"))

    def import_turtle_file(self, path: str) -> None:
        """A file, or all files of a folder or pattern, in parallel."""
        self.insert_statements(statements.from_files(self.spark, path, "turtle"))

    def import_ntriples_data(self, text: str) -> None:
        self.insert_statements(statements.from_text(self.spark, text, "ntriples"))

    def import_ntriples_file(self, path: str) -> None:
        """A file, or all files of a folder or pattern; large files are split between tasks."""
        self.insert_statements(statements.from_files(self.spark, path, "ntriples"))

    def import_rdfxml_data(self, text: str) -> None:
        self.insert_statements(statements.from_text(self.spark, text, "rdfxml"))

    def import_rdfxml_file(self, path: str) -> None:
        self.insert_statements(statements.from_files(self.spark, path, "rdfxml"))

    def _register(self, declared: DataFrame) -> None:
        found = declared.groupBy("p").agg(F.max("o").alias("o")).limit(self.MOST_PREFIXES + 1).collect()
        if len(found) + len(self.prefixes) > self.MOST_PREFIXES and len(set(self.prefixes) | {r.p for r in found}) > self.MOST_PREFIXES:
            raise StoreError(f"more than {self.MOST_PREFIXES} prefixes")
        if found:
            merged = {**self.prefixes, **{r.p: r.o for r in sorted(found)}}
            prefix_of = {namespace: prefix for prefix, namespace in merged.items()}
            self.prefixes = {prefix: namespace for namespace, prefix in prefix_of.items()}
            self._prefixes_to_disk()

    # prefixes
    def add_prefix(self, namespace: str, prefix: str) -> None:
        """One prefix per namespace and one namespace per prefix; the last given wins."""
        self._set_prefix(namespace, prefix)
        self._prefixes_to_disk()

    def _set_prefix(self, namespace: str, prefix: str) -> None:
        self.prefixes = {p: n for p, n in self.prefixes.items() if n != namespace}
        self.prefixes[prefix] = namespace

    def _prefixes_to_disk(self) -> None:
        out = self._fs.create(self._hadoop("prefixes.json"), True)
        out.write(bytearray(json.dumps(self.prefixes).encode()))
        out.close()

    def _prefixes_from_disk(self) -> None:
        if self._fs.exists(self._hadoop("prefixes.json")):
            text = self.spark.read.text(f"{self.path}/prefixes.json", wholetext=True)
            self.prefixes = json.loads(text.head().value)

    def get_all_prefixes(self) -> dict[str, str]:
        """prefix -> namespace."""
        return dict(self.prefixes)

    def get_short_iri(self, iri: str) -> str:
        """With the prefix of the longest namespace that begins it; unchanged without one or without a rest."""
        return shorten(iri, self.prefixes)

    def normalize_iri(self, iri: str) -> str:
        """``<...>`` bare, an absolute IRI as it is, prefix:local in full; else DataError."""
        if iri.startswith("<") and iri.endswith(">"):
            return iri[1:-1]
        if iri.startswith(SCHEMES):
            return iri
        prefix, colon, local = iri.partition(":")
        if colon and prefix in self.prefixes:
            return self.prefixes[prefix] + local
        if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri):
            return iri
        raise DataError(f"{iri!r} is no IRI")

    # ids
    def nodes(self) -> DataFrame:
        """(id, kind, value) of every node that is a subject or an object."""
        r, q = self.table("relations"), self.table("properties")
        ends = r.select("s_kind", "s").union(r.select("o_kind", "o")).union(q.select("s_kind", "s")).toDF("kind", "value")
        return ends.distinct().select(node_id("kind", "value").alias("id"), "kind", "value")

    def predicates(self) -> DataFrame:
        """(id, iri) of every predicate."""
        used = self.table("relations").select("p").union(self.table("properties").select("p")).distinct()
        return used.select(F.xxhash64("p").alias("id"), F.col("p").alias("iri"))

    def get_id_from_iri(self, iri: str, element: ElementType = ElementType.OBJECT) -> int | None:
        """The id of a stored node or predicate, by its full IRI."""
        if element is ElementType.PREDICATE:
            r, q = self.table("relations"), self.table("properties")
            found = r.where(F.col("p") == iri).select(F.xxhash64("p").alias("id")).union(q.where(F.col("p") == iri).select(F.xxhash64("p")))
        else:
            r, q = self.table("relations"), self.table("properties")
            found = r.where(F.col("s") == iri).select("s_kind", "s").union(r.where(F.col("o") == iri).select("o_kind", "o")).union(q.where(F.col("s") == iri).select("s_kind", "s")).toDF("kind", "value").select(node_id("kind", "value").alias("id"))
        row = found.limit(1).head()
        return row.id if row else None

    def _triples(self, relations: DataFrame, properties: DataFrame) -> DataFrame:
        s = terms.make_kind("s_kind", "s").alias("s")
        one = relations.select(s, "p", terms.make_kind("o_kind", "o").alias("o"))
        return one.unionByName(properties.select(s, "p", terms.make("literal", F.col("value"), F.col("datatype"), F.col("lang")).alias("o")))

    def describe_object_by_id(self, number: int) -> Graph:
        """Relations from it, relations to it (a self-loop in both), and its properties."""
        node = self.nodes().where(F.col("id") == number).limit(1).head()
        if node is None:
            raise DataError(f"no object has the id {number}")
        r, q = self.table("relations"), self.table("properties")
        out = r.where((F.col("s_kind") == node.kind) & (F.col("s") == node.value))
        to = r.where((F.col("o_kind") == node.kind) & (F.col("o") == node.value))
        return Graph(self._triples(out.unionByName(to), q.where((F.col("s_kind") == node.kind) & (F.col("s") == node.value))))

    def describe_predicate_by_id(self, number: int) -> Graph:
        """All its relations and properties."""
        row = self.predicates().where(F.col("id") == number).limit(1).head()
        if row is None:
            raise DataError(f"no predicate has the id {number}")
        at = (F.col("p") == row.iri) & (F.col("bucket") == bucket(F.lit(row.iri)))
        return Graph(self._triples(self.table("relations").where(at), self.table("properties").where(at)))

    def get_relation_subject_list(self, predicate: str, obj: str) -> DataFrame:
        """(subject, subject_id, object_id) of the relations with this predicate and object IRI."""
        p, o = self.normalize_iri(predicate), self.normalize_iri(obj)
        rows = self.table("relations").where((F.col("p") == p) & (F.col("bucket") == bucket(F.lit(p))) & (F.col("o_kind") == "iri") & (F.col("o") == o))
        return rows.select(F.col("s").alias("subject"), node_id("s_kind", "s").alias("subject_id"), node_id("o_kind", "o").alias("object_id"))

    # export
    def export_as_rdfxml(self, graph: Graph | Iterable[A.Triple]) -> str:
        """A graph as one document; for large ones see ``write_rdfxml``."""
        triples = graph.triples() if isinstance(graph, Graph) else graph
        return rdfxml.document(sorted(triples, key=statements.term_text))

    @staticmethod
    def write_rdfxml(graph: Graph, path: str) -> None:
        """A folder of text files, each a whole document."""
        graph.df.mapInArrow(_documents, "value string").write.text(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from types import SimpleNamespace

    def lines(found: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["value"])

    yield lines([rdfxml.HEAD])
    for batch in batches:
        s, p, o = ([None if t is None else SimpleNamespace(**t) if isinstance(t, dict) else t for t in batch.column(n).to_pylist()] for n in ("s", "p", "o"))
        yield lines([rdfxml.description(A.Triple(to_term(a), A.Iri(b), to_term(c))) for a, b, c in zip(s, p, o)])
    yield lines([rdfxml.FOOT])


def shorten(iri: str, prefixes: dict[str, str]) -> str:
    best = max((n for n in prefixes.values() if iri.startswith(n)), key=len, default=None)
    if best is None or len(best) == len(iri):
        return iri
    return next(p for p, n in prefixes.items() if n == best) + ":" + iri[len(best) :]


def shorten_column(iri, prefixes: dict[str, str]):
    """``shorten`` as a column expression, longest namespace first."""
    out = None
    for prefix, namespace in sorted(prefixes.items(), key=lambda x: -len(x[1])):
        short = F.concat(F.lit(prefix + ":"), F.substr(iri, F.lit(len(namespace) + 1)))
        test = iri.startswith(namespace)
        whole = F.when(F.length(iri) == len(namespace), iri).otherwise(short)
        out = F.when(test, whole) if out is None else out.when(test, whole)
    return iri if out is None else out.otherwise(iri)
