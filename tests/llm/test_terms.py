"""Term counts, and the queries that SQL can express."""

import os

import pytest

from ontoloom.functions.iri import XSD
from ontoloom.llm import plans, terms

SMALL = "/root/testdata/sf0.001"


def test_graph_terms(spark):
    prefixes = spark.createDataFrame([("http://p/", "p")], "namespace string, prefix string")
    predicates = spark.createDataFrame([(1, "p:a", "x"), (2, " <http://p/a>", "x"), (3, "http://p/unused", "x"), (4, None, "x"), (None, "p:b", "x")], "id long, iri string, term string")
    relations = spark.createDataFrame([(s, 1, 9) for s in range(6)] + [(0, 2, 9), (0, 2, 8), (None, 1, 9), (3, 99, 1), (3, None, 1)], "subject long, predicate long, object long")
    properties = spark.createDataFrame([(100, 1, None), (100, 1, ""), (101, 3 + 96, " xsd:string"), (101, 1, "@en"), (None, 1, "@EN ")], "subject long, predicate long, literal_type string").withColumn("code", terms.F.lit(1))
    found = {(r.field, r.term): (r.rows, r.records, r.mark) for r in terms.graph_terms(relations, properties, predicates, prefixes).collect()}
    assert found == {
        ("iri", "http://p/a"): (13, 8, "common"),
        ("iri", "http://p/unused"): (0, 0, "rare"),
        ("iri", "http://p/b"): (0, 0, "rare"),
        ("literal_type", XSD + "string"): (2, 1, "rare"),
        ("literal_type", "xsd:string"): (1, 1, "rare"),
        ("literal_type", "@en"): (1, 1, "rare"),
        ("literal_type", "@EN"): (1, 0, "rare"),
    }
    assert terms.graph_terms(relations.limit(0), properties.limit(0), predicates.limit(0), prefixes).count() == 0


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test data here")
@pytest.mark.parametrize("name", ["p3_found", "p3_counts"])
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("relations", "node_properties", "predicates", "prefixes"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    rel = con.execute(plans.SQL[name])
    columns = [c[0] for c in rel.description]
    expected = sorted(map(repr, rel.fetchall()))
    assert sorted(repr(tuple(r)) for r in plans.QUERIES[name](spark, SMALL).select(*columns).collect()) == expected


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test data here")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_queries_run(spark, name):
    assert plans.QUERIES[name](spark, SMALL).count() > 0
