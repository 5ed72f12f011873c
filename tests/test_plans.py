"""Plans of queries over tables: what reaches the scans, and which joins there are."""

import os
import re

import pytest

from ontoloom.errors import SparqlError
from ontoloom.plans import graph, stores
from ontoloom.sources.mapping import MappedSource, TableMap
from ontoloom.store import Engine

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SMALL), reason="no test data here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def engine(spark):
    return graph.engine(spark, SMALL)


def test_stars_are_one_scan_of_the_columns_they_need(engine):
    text = plan(engine.query("SELECT ?n ?b WHERE { ?c t:c_name ?n ; t:c_acctbal ?b ; t:c_nationkey n:3 . FILTER(?b > 100) }").values)
    assert text.count("FileScan") == 1 and "Join" not in text and "Exchange" not in text
    assert re.search(r"PushedFilters: \[.*EqualTo\(c_nationkey,3\).*GreaterThan\(c_acctbal,100.0\)", text)
    assert "c_mktsegment" not in text


def test_joins_are_on_keys(engine):
    text = plan(engine.query("SELECT ?o ?n WHERE { ?o t:o_custkey ?c . ?c t:c_name ?n }").values)
    assert text.count("FileScan") == 2 and text.count("HashJoin") + text.count("SortMergeJoin") == 1
    assert not re.search(r"Join \[concat", text)


def test_constants_become_keys_and_moments(engine):
    assert "EqualTo(c_custkey,42)" in plan(engine.query("SELECT ?n WHERE { c:42 t:c_name ?n }").values)
    assert "EqualTo(c_custkey,42)" in plan(engine.query("SELECT ?n WHERE { ?c t:c_name ?n . FILTER(?c = c:42) }").values)
    assert "LessThan(o_orderdate,1995-03-01" in plan(engine.query('SELECT ?o WHERE { ?o t:o_orderdate ?d . FILTER(?d < "1995-03-01"^^xsd:dateTime) }').values)


def test_bound_patterns_are_semi_joins(engine):
    assert "LeftSemi" in plan(engine.query('SELECT ?o WHERE { ?o t:o_custkey ?c ; t:o_orderstatus "P" . ?c t:c_mktsegment "BUILDING" }').values)


def test_variable_predicates_read_only_tables_that_can_match(engine):
    text = plan(engine.query("SELECT ?p ?v WHERE { ?n ?p ?v . ?n t:n_name ?name }").values)
    assert "nation.parquet" in text and "lineitem.parquet" not in text and "orders.parquet" not in text


def test_what_is_known_from_outside_prunes_tables_but_decides_no_match(engine):
    text = plan(engine.query("SELECT ?n ?v WHERE { ?n t:n_name ?name . ?n !t:n_name ?v }").values)
    assert "nation.parquet" in text and "orders.parquet" not in text
    # the optional part binds ?k to suppliers, which no nation is
    assert engine.query("SELECT ?k WHERE { ?k t:n_name ?n . { ?r t:r_name ?x OPTIONAL { ?k t:s_name ?y } } }").df.count() == 0
    assert engine.query("SELECT ?k WHERE { ?k t:n_name ?n . { ?r t:r_name ?x MINUS { ?k t:s_name ?y } } }").df.count() == 125
    assert engine.query("SELECT ?k WHERE { ?k t:n_name ?n . { SELECT ?k WHERE { ?k ?p ?o } ORDER BY ?k LIMIT 1 } }").df.count() == 0
    assert engine.query("SELECT ?k ?c WHERE { ?k t:n_name ?n . { SELECT (COUNT(?k) AS ?c) WHERE { ?k t:s_name|t:n_name ?o } } }").values.head().c > 25


def test_string_keys_are_escaped_in_iris(spark):
    keys = ["a/b", "a", "b c", "é%2F", "x~*", "", None, "a%2Fb", "https://x?y#z"]
    df = spark.createDataFrame([(k, n % 2, n) for n, k in enumerate(keys) if k is not None], "k string, j int, v int")
    maps = [TableMap(df.schema, lambda: df, "http://t/row/", ["k", "j"], {"k": "http://t/k/"})]
    found = Engine(spark, [MappedSource(maps)], {"t": "http://tables.example/ns#"})
    rows = found.query("SELECT ?s ?v ?k WHERE { ?s t:v ?v ; t:k ?k }").values.collect()
    assert len({r.s for r in rows}) == len(rows) == 8 and all(r.s.count("/") == 5 for r in rows)
    for r in rows:  # every IRI is turned back into its key
        assert found.query(f"SELECT ?v WHERE {{ <{r.s}> t:v ?v }}").values.collect() == [(r.v,)]
        assert [x.v for x in found.query(f"SELECT ?v WHERE {{ ?s t:k <{r.k}> ; t:v ?v }}").values.collect()] == [r.v]
    assert found.query("ASK { <http://t/row/a%2fb/0> t:v ?v }") is False  # not as this source writes it


@pytest.mark.parametrize("name", sorted({**graph.SQL, **stores.SQL}))
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    rel = con.execute({**graph.SQL, **stores.SQL}[name])
    columns = [c[0] for c in rel.description]

    def text(row):
        return repr(tuple(f"{x:.9g}" if isinstance(x, float) else x for x in row))

    expected = sorted(map(text, rel.fetchall()))
    found = {**graph.QUERIES, **stores.QUERIES}[name](spark, SMALL)
    assert sorted(found.columns) == sorted(columns) and sorted(map(text, found.select(*columns).collect())) == expected


def test_descriptions_by_id_have_all_kinds_of_triples(spark):
    found = graph.QUERIES["describe_object_by_id"](spark, SMALL).collect()
    nodes = {r.value for r in graph.encoded(spark, SMALL).source.nodes.select("value").collect()}
    (me,) = set.intersection(*({r.s, r.o} for r in found if r.o in nodes)) or {None}
    assert any(r.s == me and r.o in nodes for r in found) and any(r.o == me for r in found) and any(r.o not in nodes for r in found)
    found = graph.QUERIES["describe_predicate_by_id"](spark, SMALL).collect()
    assert len({r.p for r in found}) == 2 and {r.o in nodes for r in found} == {True, False}


def test_prefixes_beyond_a_map_are_looked_up(spark, monkeypatch):
    from ontoloom.functions import iri

    few = graph.encoded(spark, SMALL).query(graph.GRAPH_SELECTS["graph_relation"][0]).values.collect()
    monkeypatch.setattr(iri, "MOST_PREFIXES", 7)  # the table has 8
    store = graph.encoded(spark, SMALL)
    assert store.prefixes == {} and few
    assert sorted(store.query(graph.GRAPH_SELECTS["graph_relation"][0]).values.collect()) == sorted(few)
    assert store.query("PREFIX qy: <http://no/> SELECT ?a ?b WHERE { ?a qy:cites ?b }").values.count() == 0
    assert store.query("ASK { ?a <http://quarry.example/ns#cites> ?b }") is True
    with pytest.raises(SparqlError):
        store.query("ASK { ?a none:cites ?b }")
