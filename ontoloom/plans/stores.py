"""Queries over triple stores that are loaded from the encoded graph tables.

Each loads, writes and reads whole tables through ``TripleStore``; the SQL states what the tables hold.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions.iri import prefix_map, read_iris
from ontoloom.plans.bulk import table
from ontoloom.plans.bulk_sql import read
from ontoloom.plans.graph import encoded
from ontoloom.sources.scratch import Scratch
from ontoloom.sources.statements import COLUMNS
from ontoloom.sources.turtle import parse_turtle
from ontoloom.sparql import algebra as A
from ontoloom.store import ElementType, TripleStore

_stores: dict[tuple[str, str], TripleStore] = {}
_NS = "http://quarry.example/ns#"
#: A document with quoted triples in the ways that Turtle has for them.
QUOTED = """@prefix ex: <http://example.org/> .
<< ex:a ex:knows ex:b >> ex:certainty 0.9 ; ex:assertedBy ex:c .
ex:x ex:says <<( ex:a ex:says "hello \\"you\\""@en )>> .
ex:y ex:says <<( ex:a ex:knows ex:b )>> , <<( ex:y ex:says <<( ex:a ex:knows ex:b )>> )>> .
ex:a ex:knows ex:d .
"""


def rows_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of the encoded tables, with the scopes of blank nodes left as they are."""
    prefixes = prefix_map(table(spark, sf_dir, "prefixes"))
    nodes = table(spark, sf_dir, "objects").unionByName(table(spark, sf_dir, "core_objects"))
    predicates = read_iris(table(spark, sf_dir, "predicates"), "iri", prefixes, "p").select(F.col("id").alias("__p"), "p")
    s = nodes.select(F.col("id").alias("__s"), F.col("kind").alias("s_kind"), F.col("value").alias("s"))
    o = nodes.select(F.col("id").alias("__o"), F.col("kind").alias("o_kind"), F.col("value").alias("o"))
    none = F.lit(None).cast("string")
    relations = table(spark, sf_dir, "relations").select("subject", "predicate", "object")
    one = relations.join(predicates, F.col("predicate") == F.col("__p")).join(s, F.col("subject") == F.col("__s")).join(o, F.col("object") == F.col("__o"))
    typed, literal = encoded(spark, sf_dir).source.literals(table(spark, sf_dir, "node_properties").where("literal_value is not null"))
    two = typed.withColumn("__literal", literal).join(predicates, F.col("predicate") == F.col("__p")).join(s, F.col("subject") == F.col("__s"))
    terms = [F.lit("literal").alias("o_kind"), F.col("__literal.value").alias("o"), F.col("__literal.datatype").alias("datatype"), F.col("__literal.lang").alias("lang")]
    both = one.select("s_kind", "s", "p", "o_kind", "o", none.alias("datatype"), none.alias("lang")).unionByName(two.select("s_kind", "s", "p", *terms))
    return both.withColumn("asserted", F.lit(True))


def loaded(spark: SparkSession, sf_dir: str) -> TripleStore:
    """The store of a data folder, loaded once per application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stores:
        store = TripleStore(spark)
        for prefix, namespace in prefix_map(table(spark, sf_dir, "prefixes")).items():
            store.add_prefix(namespace, prefix)
        store.insert_statements(rows_of_tables(spark, sf_dir))
        _stores[key] = store
    return _stores[key]


def _plain(kind: str, value: str):
    """A node's text, without the scope that the labels of a document get."""
    return F.when(F.col(kind) == "blank", F.regexp_replace(value, r"\A[fd][0-9A-Fa-f]+_", "")).otherwise(F.col(value)).alias(value)


def _relations(store: TripleStore) -> DataFrame:
    return store.table("relations").select(_plain("s_kind", "s"), "p", _plain("o_kind", "o"))


def _properties(store: TripleStore) -> DataFrame:
    return store.table("properties").select(_plain("s_kind", "s"), "p", "value", "datatype", F.lower("lang").alias("lang"))


def store_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations of the store after all is inserted a second time and the files are merged: a set."""
    store = TripleStore(spark)
    for _ in range(2):
        store.insert_statements(rows_of_tables(spark, sf_dir))
    store.compact()
    return _relations(store)


def store_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _properties(loaded(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, value): the statements as lines of N-Triples."""

    def node(kind: str, value: str):
        return F.when(F.col(kind) == "iri", F.concat(F.lit("<"), value, F.lit(">"))).otherwise(F.concat(F.lit("_:"), F.regexp_replace(value, r"\A_:", "")))

    text = F.col("o")
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    # a tag that no document could hold is written as a type of its own
    well = F.col("lang").rlike(r"\A[A-Za-z]+(?:-[A-Za-z0-9]+)*\z")
    datatype = F.when(F.col("lang").isNotNull(), F.concat(F.lit("urn:tag:"), "lang")).otherwise(F.col("datatype"))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.when(well, F.concat(F.lit("@"), "lang")).otherwise(F.concat(F.lit("^^<"), F.regexp_replace(datatype, "[<> ]", "_"), F.lit(">"))))
    o = F.when(F.col("o_kind") == "literal", literal).otherwise(node("o_kind", "o"))
    return rows_of_tables(spark, sf_dir).select("s", F.concat(node("s_kind", "s"), F.lit(" <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))


def store_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations of a store that reads the tables as files of N-Triples."""
    folder = f"{Scratch(spark, 'ntriples').root}/lines"
    _lines(spark, sf_dir).select("value").write.text(folder)
    store = TripleStore(spark)
    store.import_ntriples_file(folder)
    return _whole(store)


def store_turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``store_ntriples``, from Turtle documents, each with the statements of some subjects."""
    folder = f"{Scratch(spark, 'turtle').root}/documents"
    lines = _lines(spark, sf_dir).where("value is not null").select("s", F.regexp_replace("value", rf"<\Q{_NS}\E([A-Za-z]+)>", "qy:$1").alias("value"))
    # a partition is a document, its first line has the prefix before it
    documents = lines.repartitionById(64, F.pmod(F.xxhash64("s"), F.lit(64)).cast("int")).select("value")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    documents.select(F.when(first, F.concat(F.lit(f"@prefix qy: <{_NS}> .\n"), "value")).otherwise(F.col("value")).alias("value")).write.option("compression", "gzip").text(folder)
    store = TripleStore(spark)
    store.import_turtle_file(folder)
    return _whole(store)


def _whole(store: TripleStore) -> DataFrame:
    """All distinct texts of the store's triples; labels are those of many documents, so they are left out."""
    r, q = store.table("relations"), store.table("properties")
    s = F.when(F.col("s_kind") == "iri", F.col("s")).otherwise("_")
    one = r.select(s.alias("s"), "p", F.when(F.col("o_kind") == "iri", F.col("o")).otherwise("_").alias("o"))
    return one.union(q.select(s.alias("s"), "p", "value")).distinct()


def store_rdfxml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's graph of a few predicates, written as RDF/XML and read by another store."""
    store = loaded(spark, sf_dir)
    graph = store.query("CONSTRUCT { ?s qy:cites ?o } WHERE { ?s qy:cites ?o FILTER(ISIRI(?s) && ISIRI(?o)) }")
    folder = f"{Scratch(spark, 'rdfxml').root}/documents"
    store.write_rdfxml(graph, folder)
    other = TripleStore(spark)
    other.import_rdfxml_file(folder)
    return _relations(other)


def store_rdfxml_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph as one RDF/XML text and back."""
    store = loaded(spark, sf_dir)
    text = store.export_as_rdfxml(store.query("CONSTRUCT { ?s qy:locatedIn ?o } WHERE { ?s qy:locatedIn ?o FILTER(ISIRI(?s) && ISIRI(?o)) }"))
    other = TripleStore(spark)
    other.import_rdfxml_data(text)
    return _relations(other)


def store_from_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store in the folder that the environment names, opened, filled, emptied and filled again."""
    os.environ["ONTOLOOM_EXAMPLE_STORE"] = f"{Scratch(spark, 'env').root}/store"
    store = TripleStore.new_from_env(spark, "ONTOLOOM_EXAMPLE_STORE")
    store.insert_statements(rows_of_tables(spark, sf_dir))
    store.reset_db()
    known = rows_of_tables(spark, sf_dir).where(F.col("p") == _NS + "knows")
    store.insert_statements(known)
    again = TripleStore.new_from_env(spark, "ONTOLOOM_EXAMPLE_STORE")
    return _relations(again)


def store_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(spark, sf_dir).query("SELECT DISTINCT ?a ?c WHERE { ?a qy:partOf ?b . ?b qy:locatedIn ?c FILTER(ISIRI(?a) && ISIRI(?c)) }").values


def _many_sided(spark: SparkSession, sf_dir: str) -> str:
    """The smallest IRI that has relations both ways and properties."""
    store = loaded(spark, sf_dir)
    r, q = store.table("relations"), store.table("properties")
    both = r.where("s_kind = 'iri'").select("s").intersect(r.where("o_kind = 'iri'").select("o")).intersect(q.where("s_kind = 'iri'").select("s"))
    return both.agg(F.min("s").alias("s")).head().s


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.col("s.value").alias("s"), "p", F.col("o.value").alias("o")).distinct()


def store_describe_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the id that the store gives a node."""
    store = loaded(spark, sf_dir)
    return _shown(store.describe_object_by_id(store.get_id_from_iri(_many_sided(spark, sf_dir))).df)


def store_describe_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the ids that the store gives a predicate of relations and one of properties."""
    store = loaded(spark, sf_dir)
    ids = [store.get_id_from_iri(_NS + name, ElementType.PREDICATE) for name in ("knows", "label")]
    one, two = (store.describe_predicate_by_id(n).df for n in ids)
    return _shown(one.unionByName(two))


def store_subject_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = loaded(spark, sf_dir)
    most = store.table("relations").where(f"p = '{_NS}memberOf' and o_kind = 'iri'").agg(F.min("o").alias("o")).head().o
    return store.get_relation_subject_list("qy:memberOf", most).select("subject")


def store_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registering, listing, expanding and shortening."""
    store = TripleStore(spark)
    for prefix, namespace in prefix_map(table(spark, sf_dir, "prefixes")).items():
        store.add_prefix(namespace, prefix)
    store.add_prefix("urn:new:", "lode")  # a prefix gets another namespace
    store.add_prefix("urn:new:", "fresh")  # and that another prefix
    found = [("prefix", p, n) for p, n in store.get_all_prefixes().items()]
    found += [("normalize", x, store.normalize_iri(x)) for x in ("qy:knows", "<urn:a:b>", "http://x/y", "fresh:z")]
    found += [("shorten", x, store.get_short_iri(x)) for x in (_NS + "knows", "http://quarry.example/id/agent/1", "urn:new:", "urn:other:x")]
    return spark.createDataFrame(found, "what string, given string, got string")


def store_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted triples: stored with their parts, stated of, and not asserted; one insert goes triple by triple."""
    store, again = TripleStore(spark), TripleStore(spark)
    store.import_turtle_data(QUOTED)
    again.insert_triples(parse_turtle(QUOTED)[0])
    again.insert_triple(A.Triple(A.Iri("http://example.org/a"), A.Iri("http://example.org/knows"), A.Iri("http://example.org/d")))
    out = []
    for n, s in enumerate((store, again)):
        quoted = s.table("quoted").select(F.lit(n).alias("store"), F.lit("quoted").alias("what"), "s", "p", "o")
        about = s.table("annotations").select(F.lit(n).alias("store"), F.lit("stated").alias("what"), F.when(F.col("s_kind") == "iri", F.col("s")).otherwise("_").alias("s"), "p", F.col("quoted").alias("o"))
        told = s.table("relations").select(F.lit(n).alias("store"), F.lit("asserted").alias("what"), F.when(F.col("s_kind") == "iri", F.col("s")).otherwise("_").alias("s"), "p", "o")
        out += [quoted, about, told]
    whole = out[0]
    for part in out[1:]:
        whole = whole.union(part)
    return whole


QUERIES = {f.__name__: f for f in (store_insert, store_properties, store_ntriples, store_turtle, store_rdfxml, store_rdfxml_text, store_from_env, store_path, store_describe_object, store_describe_predicate, store_subject_list, store_prefixes, store_quoted)}

_TRIPLES = (
    "with recs as (select subject, predicate, literal_value, coalesce(literal_type, '') as literal_type from node_properties where literal_value is not null),"
    + read("predicates", "iri")
    + ","
    + read("recs", "literal_type")
    + """, nodes as (select id, kind, value from objects union all select id, kind, value from core_objects),
 rels as (select distinct s.kind as sk, s.value as s, p.term as p, o.kind as ok, o.value as o from relations r join read_predicates p on p.id = r.predicate join nodes s on s.id = r.subject join nodes o on o.id = r.object),
 props as (select distinct s.kind as sk, s.value as s, p.term as p, r.literal_value as value,
   case when r.term = '' then 'http://www.w3.org/2001/XMLSchema#string' when r.term like '@%' then 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' else r.term end as datatype, case when r.term like '@%' then substr(r.term, 2) end as lang
   from read_recs r join read_predicates p on p.id = r.predicate join nodes s on s.id = r.subject)
"""
)
_TEXTS = _TRIPLES + " select distinct case when sk = 'iri' then s else '_' end as s, p, case when ok = 'iri' then o else '_' end as o from rels union select distinct case when sk = 'iri' then s else '_' end, p, value from props"
_NODE = "(select min(s) from rels where sk = 'iri' and s in (select o from rels where ok = 'iri') and s in (select s from props where sk = 'iri'))"
_EX = "http://example.org/"
_Q1, _Q2 = f"<<( <{_EX}a> <{_EX}knows> <{_EX}b> )>>", f'<<( <{_EX}a> <{_EX}says> "hello \\"you\\""@en )>>'
_REIFIES = "http://www.w3.org/1999/02/22-rdf-syntax-ns#reifies"
_STARRED = [
    ("quoted", f"{_EX}a", f"{_EX}knows", f"{_EX}b"),
    ("quoted", f"{_EX}a", f"{_EX}says", 'hello "you"'),
    ("quoted", f"{_EX}y", f"{_EX}says", _Q1),
    ("stated", "_", _REIFIES, _Q1),
    ("stated", f"{_EX}x", f"{_EX}says", _Q2),
    ("stated", f"{_EX}y", f"{_EX}says", _Q1),
    ("stated", f"{_EX}y", f"{_EX}says", f"<<( <{_EX}y> <{_EX}says> {_Q1} )>>"),
    ("asserted", "_", f"{_EX}assertedBy", f"{_EX}c"),
    ("asserted", f"{_EX}a", f"{_EX}knows", f"{_EX}d"),
]

SQL = {
    "store_insert": _TRIPLES + " select s, p, o from rels",
    "store_properties": _TRIPLES + " select s, p, value, datatype, lower(lang) as lang from props",
    "store_ntriples": _TEXTS,
    "store_turtle": _TEXTS,
    "store_rdfxml": _TRIPLES + f" select distinct s, p, o from rels where p = '{_NS}cites' and sk = 'iri' and ok = 'iri'",
    "store_rdfxml_text": _TRIPLES + f" select distinct s, p, o from rels where p = '{_NS}locatedIn' and sk = 'iri' and ok = 'iri'",
    "store_from_env": _TRIPLES + f" select distinct s, p, o from rels where p = '{_NS}knows'",
    "store_path": _TRIPLES + f" select distinct x.s as a, y.o as c from rels x join rels y on y.sk = x.ok and y.s = x.o where x.p = '{_NS}partOf' and y.p = '{_NS}locatedIn' and x.sk = 'iri' and y.ok = 'iri'",
    "store_describe_object": _TRIPLES + f" select distinct s, p, o from rels where sk = 'iri' and s = {_NODE} or ok = 'iri' and o = {_NODE} union select s, p, value from props where sk = 'iri' and s = {_NODE}",
    "store_describe_predicate": _TRIPLES + f" select distinct s, p, o from rels where p in ('{_NS}knows', '{_NS}label') union select s, p, value from props where p in ('{_NS}knows', '{_NS}label')",
    "store_subject_list": _TRIPLES + f" select s as subject from rels where p = '{_NS}memberOf' and ok = 'iri' and o = (select min(o) from rels where p = '{_NS}memberOf' and ok = 'iri')",
    "store_prefixes": f"select 'prefix' as what, prefix as given, namespace as got from prefixes where prefix <> 'lode' union all select * from (values ('prefix', 'fresh', 'urn:new:'), ('normalize', 'qy:knows', '{_NS}knows'), ('normalize', '<urn:a:b>', 'urn:a:b'), ('normalize', 'http://x/y', 'http://x/y'), ('normalize', 'fresh:z', 'urn:new:z'), ('shorten', '{_NS}knows', 'qy:knows'), ('shorten', 'http://quarry.example/id/agent/1', 'qi:agent/1'), ('shorten', 'urn:new:', 'urn:new:'), ('shorten', 'urn:other:x', 'urn:other:x')) v",
    "store_quoted": "select cast(n as int) as store, what, s, p, o from range(2) r(n), (values " + ", ".join("(" + ", ".join("'" + text.replace("'", "''") + "'" for text in row) + ")" for row in _STARRED) + ") v(what, s, p, o)",
}
