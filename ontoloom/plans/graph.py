"""SPARQL over the relational tables as virtual triples, and over the dictionary-encoded graph.

Each entry of ``SELECTS`` is a SPARQL query and the SQL it must equal.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.encoded import EncodedStore
from ontoloom.plans.bulk import schema, table
from ontoloom.plans.bulk_sql import read
from ontoloom.sources.mapping import MappedSource, TableMap
from ontoloom.store import Engine, shorten_column

BASE = "http://tables.example/"
NS = BASE + "ns#"
#: Table -> (name in IRIs, key columns, column -> table it refers to, columns without triples).
TABLES = {
    "region": ("region", ["r_regionkey"], {}, ()),
    "nation": ("nation", ["n_nationkey"], {"n_regionkey": "region"}, ()),
    "customer": ("customer", ["c_custkey"], {"c_nationkey": "nation"}, ()),
    "supplier": ("supplier", ["s_suppkey"], {"s_nationkey": "nation"}, ()),
    "part": ("part", ["p_partkey"], {}, ()),
    "orders": ("order", ["o_orderkey"], {"o_custkey": "customer"}, ()),
    "lineitem": ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], {"l_orderkey": "order", "l_partkey": "part", "l_suppkey": "supplier"}, ()),
    "events": ("event", ["event_id"], {"user_id": "customer"}, ()),
    "documents": ("document", ["doc_id"], {"parent_id": "document", "dup_of": "document"}, ()),
    "benchmark": ("item", ["item_id"], {}, ()),
    "embeddings": ("vector", ["vec_id"], {}, ()),
}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    maps = [TableMap(schema(spark, sf_dir, t), partial(table, spark, sf_dir, t), f"{BASE}{name}/", keys, {c: f"{BASE}{to}/" for c, to in links.items()}, skip, NS) for t, (name, keys, links, skip) in TABLES.items()]
    return Engine(spark, [MappedSource(maps)], {"t": NS, "n": BASE + "nation/", "c": BASE + "customer/", "xsd": "http://www.w3.org/2001/XMLSchema#"})


def encoded(spark: SparkSession, sf_dir: str) -> EncodedStore:
    nodes = table(spark, sf_dir, "objects").unionByName(table(spark, sf_dir, "core_objects"))
    return EncodedStore(spark, table(spark, sf_dir, "relations"), table(spark, sf_dir, "node_properties"), nodes, table(spark, sf_dir, "predicates"), table(spark, sf_dir, "prefixes"))


def iri(name: str, *columns: str) -> str:
    """SQL text of an IRI over key columns."""
    return f"'{BASE}{name}/' || " + " || '/' || ".join(columns)


_C, _N, _O, _P, _S, _E = iri("customer", "c_custkey"), iri("nation", "n_nationkey"), iri("order", "o_orderkey"), iri("part", "p_partkey"), iri("supplier", "s_suppkey"), iri("event", "event_id")
_PART = "SELECT ?p ?v WHERE {{ ?p t:p_name ?name ; t:p_size ?size ; t:p_brand ?brand . BIND({} AS ?v) }}"
_PART_SQL = f"select {_P} as p, {{}} as v from part"


def part(expression: str, sql: str) -> tuple[str, str]:
    return _PART.format(expression), _PART_SQL.format(sql)


def customers(condition: str, sql: str) -> tuple[str, str]:
    return f"SELECT ?c ?bal WHERE {{ ?c t:c_acctbal ?bal ; t:c_mktsegment ?seg ; t:c_name ?name . FILTER({condition}) }}", f"select {_C} as c, c_acctbal as bal from customer where {sql}"


SELECTS: dict[str, tuple[str, str]] = {
    "bgp_single": ("SELECT ?c ?name WHERE { ?c t:c_name ?name }", f"select {_C} as c, c_name as name from customer"),
    "bgp_star": ("SELECT ?c ?name ?bal ?seg WHERE { ?c t:c_name ?name ; t:c_acctbal ?bal ; t:c_mktsegment ?seg }", f"select {_C} as c, c_name as name, c_acctbal as bal, c_mktsegment as seg from customer"),
    "bgp_path3": (
        "SELECT ?o ?price ?nation WHERE { ?o t:o_custkey ?c ; t:o_totalprice ?price . ?c t:c_nationkey ?n . ?n t:n_name ?nation . FILTER(?price > 400000) }",
        f"select {_O} as o, o_totalprice as price, n_name as nation from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where o_totalprice > 400000",
    ),
    "bgp_path4": (
        "SELECT ?l ?region WHERE { ?l t:l_orderkey ?o ; t:l_quantity ?q . ?o t:o_custkey ?c . ?c t:c_nationkey ?n . ?n t:n_regionkey ?r . ?r t:r_name ?region . FILTER(?q = 50) }",
        f"select {iri('lineitem', 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')} || '/' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%f') as l, r_name as region from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where l_quantity = 50",
    ),
    "bgp_iri_object": ("SELECT ?c ?name WHERE { ?c t:c_nationkey n:3 ; t:c_name ?name }", f"select {_C} as c, c_name as name from customer where c_nationkey = 3"),
    "bgp_iri_subject": ("SELECT ?name ?n WHERE { c:42 t:c_name ?name ; t:c_nationkey ?n }", f"select c_name as name, {iri('nation', 'c_nationkey')} as n from customer where c_custkey = 42"),
    "bgp_literal_object": ('SELECT ?c WHERE { ?c t:c_mktsegment "BUILDING" }', f"select {_C} as c from customer where c_mktsegment = 'BUILDING'"),
    "bgp_semi": ('SELECT ?o ?c WHERE { ?o t:o_custkey ?c ; t:o_orderstatus "P" . ?c t:c_mktsegment "MACHINERY" }', f"select {_O} as o, {_C} as c from orders join customer on c_custkey = o_custkey where o_orderstatus = 'P' and c_mktsegment = 'MACHINERY'"),
    "bgp_cross": ("SELECT ?rn ?nn WHERE { ?r t:r_name ?rn . ?n t:n_name ?nn }", "select r_name as rn, n_name as nn from region, nation"),
    "bgp_var_predicate": (
        "SELECT ?n ?p ?v WHERE { ?n ?p ?v . ?n t:n_name ?name }",
        f"select {_N} as n, '{NS}n_nationkey' as p, cast(n_nationkey as varchar) as v from nation union all select {_N}, '{NS}n_name', n_name from nation union all select {_N}, '{NS}n_regionkey', {iri('region', 'n_regionkey')} from nation",
    ),
    "bgp_bnode": ("SELECT ?a ?b WHERE { ?a t:n_regionkey _:r . ?b t:n_regionkey _:r . FILTER(?a != ?b) }", f"select {iri('nation', 'x.n_nationkey')} as a, {iri('nation', 'y.n_nationkey')} as b from nation x join nation y on x.n_regionkey = y.n_regionkey and x.n_nationkey <> y.n_nationkey"),
    "bgp_bnode_apart": ("SELECT ?x ?rn WHERE { _:x t:r_name ?rn . ?x t:n_regionkey <http://tables.example/region/1> }", f"select {_N} as x, r_name as rn from nation, region where n_regionkey = 1"),
    "bgp_shared_literal": ('SELECT ?p ?n WHERE { ?p t:p_size ?x ; t:p_brand "Brand#2" . ?n t:n_nationkey ?x }', f"select {_P} as p, {_N} as n from part join nation on p_size = n_nationkey where p_brand = 'Brand#2'"),
    "bgp_const_check": ("SELECT ?n WHERE { ?r t:r_name ?n . n:1 t:n_regionkey <http://tables.example/region/1> }", "select r_name as n from region where exists (select 1 from nation where n_nationkey = 1 and n_regionkey = 1)"),
    "bgp_const_check_none": ("SELECT ?n WHERE { ?r t:r_name ?n . n:1 t:n_regionkey <http://tables.example/region/9> }", "select r_name as n from region where exists (select 1 from nation where n_nationkey = 1 and n_regionkey = 9)"),
    "bgp_subselect": ("SELECT ?c ?n WHERE { { SELECT ?c WHERE { ?c t:c_nationkey n:3 } } ?c t:c_name ?n }", f"select {_C} as c, c_name as n from customer where c_nationkey = 3"),
    "bgp_date": ('SELECT ?o ?d WHERE { ?o t:o_orderdate ?d . FILTER(?d < "1995-03-01"^^xsd:dateTime) }', f"select {_O} as o, o_orderdate as d from orders where o_orderdate < timestamp '1995-03-01'"),
    "bgp_date_range": ('SELECT ?o ?d WHERE { ?o t:o_orderdate ?d . FILTER(?d >= "1996-01-01"^^xsd:dateTime && "1996-03-01T00:00:00"^^xsd:dateTime > ?d && ?d > "1996-01-05T00:00:00.000000"^^xsd:dateTime) }', f"select {_O} as o, o_orderdate as d from orders where o_orderdate > timestamp '1996-01-05' and o_orderdate < timestamp '1996-03-01'"),
    "filter_iri": customers("?c = c:42 || ?c IN (c:43, n:3) || c:44 = ?c", "c_custkey in (42, 43, 44)"),
    "filter_eq": customers('?seg = "BUILDING"', "c_mktsegment = 'BUILDING'"),
    "filter_neq": customers('?seg != "BUILDING"', "c_mktsegment <> 'BUILDING'"),
    "filter_mixed_types": customers("?seg != 5 && !(?seg < 5)", "true"),
    "filter_same_term": customers('SAMETERM(?seg, "BUILDING")', "c_mktsegment = 'BUILDING'"),
    "filter_lt": customers("?bal < 0", "c_acctbal < 0"),
    "filter_le": customers("?bal <= 1000.5", "c_acctbal <= 1000.5"),
    "filter_gt": customers("?bal > 9000", "c_acctbal > 9000"),
    "filter_ge": customers("?bal >= 9000", "c_acctbal >= 9000"),
    "filter_iri_order": customers("?c < c:2", f"{_C} < '{BASE}customer/2'"),
    "filter_and_or_not": customers('!(?bal > 5000 || ?seg = "BUILDING") && ?bal > 0', "not (c_acctbal > 5000 or c_mktsegment = 'BUILDING') and c_acctbal > 0"),
    "filter_in": customers('?seg IN ("BUILDING", "MACHINERY", 3)', "c_mktsegment in ('BUILDING', 'MACHINERY')"),
    "filter_not_in": customers('?seg NOT IN ("BUILDING", "MACHINERY")', "c_mktsegment not in ('BUILDING', 'MACHINERY')"),
    "filter_arith": customers("?bal * 2 + 10 - 5 > 9000", "c_acctbal * 2 + 10 - 5 > 9000"),
    "filter_div": customers("?bal / 4 > 2000 || ?bal / 0 = 1", "c_acctbal / 4 > 2000"),
    "filter_unary": customers("-?bal > 100 && +?bal < 0", "-c_acctbal > 100"),
    "filter_if": customers('IF(?seg = "BUILDING", ?bal, -?bal) > 100', "case when c_mktsegment = 'BUILDING' then c_acctbal else -c_acctbal end > 100"),
    "filter_coalesce": customers("COALESCE(?nothing, ?bal) > 9000", "c_acctbal > 9000"),
    "filter_bound": customers("BOUND(?bal) && !BOUND(?nothing)", "c_acctbal is not null"),
    "filter_constant": customers("true", "true"),
    "filter_exists": customers('EXISTS { ?o t:o_custkey ?c ; t:o_orderstatus "P" }', "exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')"),
    "filter_not_exists": customers('NOT EXISTS { ?o t:o_custkey ?c ; t:o_orderstatus "P" }', "not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')"),
    "exists_correlated": customers("EXISTS { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > ?bal * 60) }", "exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > c_acctbal * 60)"),
    "not_exists_correlated": customers("NOT EXISTS { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > ?bal * 60) }", "not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > c_acctbal * 60)"),
    "exists_or": customers('?seg = "BUILDING" || EXISTS { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > ?bal * 90) }', "c_mktsegment = 'BUILDING' or exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > c_acctbal * 90)"),
    "exists_bind": ('SELECT ?c ?has WHERE { ?c t:c_nationkey n:3 BIND(EXISTS { ?o t:o_custkey ?c ; t:o_orderstatus "P" } AS ?has) }', f"select {_C} as c, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') as has from customer where c_nationkey = 3"),
    "filter_no_boolean": customers('?bal', "false"),
    "fn_contains": part('CONTAINS(?name, "ing")', "contains(p_name, 'ing')"),
    "fn_strstarts": part('STRSTARTS(?name, "re")', "starts_with(p_name, 're')"),
    "fn_strends": part('STRENDS(?brand, "7")', "suffix(p_brand, '7')"),
    "fn_strbefore": part('STRBEFORE(?name, " ")', "case when strpos(p_name, ' ') > 0 then substr(p_name, 1, strpos(p_name, ' ') - 1) else '' end"),
    "fn_strafter": part('STRAFTER(?name, " ")', "case when strpos(p_name, ' ') > 0 then substr(p_name, strpos(p_name, ' ') + 1) else '' end"),
    "fn_strlen": part("STRLEN(?name)", "cast(length(p_name) as double)"),
    "fn_str": part("STR(?size)", "cast(p_size as varchar)"),
    "fn_ucase": part("UCASE(?name)", "upper(p_name)"),
    "fn_lcase": part("LCASE(?brand)", "lower(p_brand)"),
    "fn_concat": part('CONCAT(?name, "/", ?size)', "p_name || '/' || p_size"),
    "fn_substr": part("SUBSTR(?name, 2, 4)", "substr(p_name, 2, 4)"),
    "fn_substr_beyond": part("SUBSTR(?name, 99)", "''"),
    "fn_replace": part('REPLACE(?name, "([aeiou])(.)", "$2$1")', r"regexp_replace(p_name, '([aeiou])(.)', '\2\1', 'g')"),
    "fn_regex": part('REGEX(?name, "^s.*g$")', "regexp_matches(p_name, '^s.*g$')"),
    "fn_regex_i": part('REGEX(?brand, "^BRAND#1", "i")', "regexp_matches(p_brand, '^BRAND#1', 'i')"),
    "fn_isiri": part("ISIRI(?p) && !ISIRI(?name)", "true"),
    "fn_isblank": part("ISBLANK(?p)", "false"),
    "fn_isliteral": part("ISLITERAL(?size) && !ISLITERAL(?p)", "true"),
    "fn_isnumeric": part("ISNUMERIC(?size) && !ISNUMERIC(?name)", "true"),
    "fn_datatype": part("STR(DATATYPE(?size))", "'http://www.w3.org/2001/XMLSchema#int'"),
    "fn_lang": part("CONCAT(LANG(?name), \"-\", STR(LANGMATCHES(LANG(?name), \"*\")))", "'-false'"),
    "fn_abs": part("ABS(20 - ?size)", "cast(abs(20 - p_size) as double)"),
    "fn_ceil_floor_round": part("CEIL(?size / 4) * 10000 + FLOOR(?size / 4) * 100 + ROUND(?size / 4)", "ceil(p_size / 4.0) * 10000 + floor(p_size / 4.0) * 100 + round(p_size / 4.0)"),
    "fn_iri": part('STR(IRI(CONCAT("urn:part:", ?size)))', "'urn:part:' || p_size"),
    "fn_dates": ("SELECT ?o ?n WHERE { ?o t:o_orderdate ?d BIND(YEAR(?d) * 10000 + MONTH(?d) * 100 + DAY(?d) + HOURS(?d) + MINUTES(?d) + SECONDS(?d) AS ?n) }", f"select {_O} as o, cast(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) + hour(o_orderdate) + minute(o_orderdate) + second(o_orderdate) as double) as n from orders"),
    "fn_hashes": part('CONCAT(MD5(?name), SHA256(?brand))', "md5(p_name) || sha256(p_brand)"),
    "fn_encode": part("ENCODE_FOR_URI(CONCAT(?name, ?brand))", "replace(replace(p_name || p_brand, ' ', '%20'), '#', '%23')"),
    "fn_casts": part("xsd:integer(CONCAT(STR(?size), \".75\")) + xsd:double(xsd:boolean(\"1\"))", "cast(p_size + 1 as double)"),
    "fn_typed": part('CONCAT(STR(DATATYPE(?size)), LANG(?brand))', "'http://www.w3.org/2001/XMLSchema#int'"),
    "base_reduced": ("BASE <http://tables.example/> SELECT REDUCED ?seg FROM <http://tables.example/any> WHERE { ?c t:c_nationkey <nation/3> ; t:c_mktsegment ?seg }", "select distinct c_mktsegment as seg from customer where c_nationkey = 3"),
    "aggregates": (
        "SELECT ?n (AVG(?bal) AS ?mean) (MIN(?bal) AS ?low) (MAX(?seg) AS ?last) (COUNT(DISTINCT ?seg) AS ?segs) (GROUP_CONCAT(DISTINCT ?seg; SEPARATOR=\"/\") AS ?names) WHERE { ?c t:c_nationkey ?n ; t:c_acctbal ?bal ; t:c_mktsegment ?seg } GROUP BY ?n",
        f"select {iri('nation', 'c_nationkey')} as n, avg(c_acctbal) as mean, min(c_acctbal) as low, max(c_mktsegment) as last, count(distinct c_mktsegment) as segs, string_agg(distinct c_mktsegment, '/' order by c_mktsegment) as names from customer group by 1",
    ),
    "sample": ("SELECT (SAMPLE(?r) AS ?one) WHERE { ?n t:n_regionkey ?r . ?r t:r_name \"ASIA\" }", f"select {iri('region', 'r_regionkey')} as one from region where r_name = 'ASIA'"),
    "fn_unknown": ("SELECT ?p WHERE { ?p t:p_name ?n . FILTER(NOW() = 1) }", f"select {_P} as p from part where false"),
    "distinct": ("SELECT DISTINCT ?seg WHERE { ?c t:c_mktsegment ?seg }", "select distinct c_mktsegment as seg from customer"),
    "distinct_order": ("SELECT DISTINCT ?seg WHERE { ?c t:c_mktsegment ?seg } ORDER BY DESC(?seg) LIMIT 3", "select distinct c_mktsegment as seg from customer order by 1 desc limit 3"),
    "order_limit": ("SELECT ?o ?price WHERE { ?o t:o_totalprice ?price } ORDER BY DESC(?price) ?o LIMIT 20", f"select {_O} as o, o_totalprice as price from orders order by o_totalprice desc, 1 limit 20"),
    "offset": ("SELECT ?n WHERE { ?x t:n_name ?n } ORDER BY ?n OFFSET 20", "select n_name as n from nation order by 1 offset 20"),
    "optional": ("SELECT ?c ?o WHERE { ?c t:c_nationkey n:3 OPTIONAL { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > 300000) } }", f"select {_C} as c, {_O} as o from customer left join orders on o_custkey = c_custkey and o_totalprice > 300000 where c_nationkey = 3"),
    "union": ("SELECT ?x WHERE { { ?x t:c_nationkey n:3 } UNION { ?x t:s_nationkey n:3 } }", f"select {_C} as x from customer where c_nationkey = 3 union all select {_S} from supplier where s_nationkey = 3"),
    "optional_unbound": (
        'SELECT ?c ?o ?p WHERE { ?c t:c_nationkey n:3 OPTIONAL { ?o t:o_custkey ?c ; t:o_orderstatus "P" } ?o t:o_totalprice ?p FILTER(?p > 440000) }',
        f"select {_C} as c, {iri('order', 'x.o_orderkey')} as o, x.o_totalprice as p from customer left join orders o on o.o_custkey = c_custkey and o.o_orderstatus = 'P' join orders x on (o.o_orderkey is null or x.o_orderkey = o.o_orderkey) where c_nationkey = 3 and x.o_totalprice > 440000",
    ),
    "optional_twice": (
        'SELECT ?c ?o WHERE { ?c t:c_nationkey n:3 OPTIONAL { ?o t:o_custkey ?c ; t:o_orderstatus "P" } OPTIONAL { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > 300000) } }',
        f"select {_C} as c, {iri('order', 'coalesce(o.o_orderkey, x.o_orderkey)')} as o from customer left join orders o on o.o_custkey = c_custkey and o.o_orderstatus = 'P' left join orders x on x.o_custkey = c_custkey and x.o_totalprice > 300000 and (o.o_orderkey is null or x.o_orderkey = o.o_orderkey) where c_nationkey = 3",
    ),
    "minus": ('SELECT ?c WHERE { ?c t:c_mktsegment "BUILDING" MINUS { ?o t:o_custkey ?c ; t:o_orderstatus "P" } }', f"select {_C} as c from customer where c_mktsegment = 'BUILDING' and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')"),
    "minus_rows": (
        'SELECT ?c ?o WHERE { ?c t:c_nationkey n:3 OPTIONAL { ?o t:o_custkey ?c ; t:o_orderstatus "P" } MINUS { ?o t:o_totalprice ?p FILTER(?p < 200000) } }',
        f"select {_C} as c, {_O} as o from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'P' where c_nationkey = 3 and (o_totalprice is null or o_totalprice >= 200000)",
    ),
    "path_seq": ("SELECT ?o ?name WHERE { ?o t:o_custkey/t:c_nationkey/t:n_name ?name ; t:o_totalprice ?p FILTER(?p > 400000) }", f"select {_O} as o, n_name as name from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where o_totalprice > 400000"),
    "path_inverse": ("SELECT ?r ?c WHERE { ?r ^t:n_regionkey/^t:s_nationkey ?c }", f"select {iri('region', 'n_regionkey')} as r, {_S} as c from nation join supplier on s_nationkey = n_nationkey"),
    "path_alt": ("SELECT ?x ?n WHERE { ?x t:c_nationkey|t:s_nationkey ?n }", f"select {_C} as x, {iri('nation', 'c_nationkey')} as n from customer union all select {_S}, {iri('nation', 's_nationkey')} from supplier"),
    "path_opt": ("SELECT ?x ?y WHERE { ?x t:n_name ?name . ?x t:n_regionkey? ?y }", f"select {_N} as x, {_N} as y from nation union all select {_N}, {iri('region', 'n_regionkey')} from nation"),
    "path_star": (
        "SELECT ?a ?b WHERE { ?a t:post_kind \"answer\" . ?a (t:parent_id|t:dup_of)* ?b }",
        f"with recursive step as (select doc_id as x, parent_id as y from documents where parent_id is not null union select doc_id, dup_of from documents where dup_of is not null), walk as (select doc_id as x, doc_id as y from documents where post_kind = 'answer' union select w.x, s.y from walk w join step s on s.x = w.y) select {iri('document', 'x')} as a, {iri('document', 'y')} as b from walk",
    ),
    "path_not": ("SELECT ?n ?v WHERE { ?n t:n_name ?name . ?n !(t:n_name|t:n_nationkey) ?v }", f"select {_N} as n, {iri('region', 'n_regionkey')} as v from nation"),
    "values": ("SELECT ?n ?name WHERE { VALUES ?n { n:3 n:4 n:99 } ?n t:n_name ?name }", f"select {_N} as n, n_name as name from nation where n_nationkey in (3, 4)"),
    "group": ("SELECT ?n (COUNT(?c) AS ?customers) (SUM(?bal) AS ?total) WHERE { ?c t:c_nationkey ?n ; t:c_acctbal ?bal } GROUP BY ?n HAVING(COUNT(?c) > 10)", f"select {iri('nation', 'c_nationkey')} as n, count(*) as customers, sum(c_acctbal) as total from customer group by 1 having count(*) > 10"),
    "events_by_type": ("SELECT ?type (COUNT(*) AS ?n) (MAX(?v) AS ?most) WHERE { ?e t:event_type ?type ; t:value ?v } GROUP BY ?type", "select event_type as type, count(*) as n, max(value) as most from events group by 1"),
    "lineitem_star": ("SELECT ?q ?price ?date WHERE { ?l t:l_quantity ?q ; t:l_extendedprice ?price ; t:l_discount ?d ; t:l_orderkey ?o . ?o t:o_orderdate ?date . FILTER(?q > 45 && ?d >= 0.05) }", "select l_quantity as q, l_extendedprice as price, o_orderdate as date from lineitem join orders on o_orderkey = l_orderkey where l_quantity > 45 and l_discount >= 0.05"),
    "document_threads": ("SELECT ?a ?q ?title WHERE { ?a t:parent_id ?q ; t:post_kind \"answer\" . ?q t:title ?title }", f"select {iri('document', 'a.doc_id')} as a, {iri('document', 'q.doc_id')} as q, q.title from documents a join documents q on q.doc_id = a.parent_id where a.post_kind = 'answer' and q.title is not null"),
}

_QY = "http://quarry.example/ns#"
_PRED = "(select id from predicates where rtrim(iri) in ('http://quarry.example/ns#{0}', '<http://quarry.example/ns#{0}>', 'qy:{0}'))"
_NODES = "(select id, kind, value from objects union all select id, kind, value from core_objects)"


def rel(name: str) -> str:
    return f"(select distinct subject, object from relations where predicate in {_PRED.format(name)})"


#: As ``SELECTS``, over the encoded graph.
GRAPH_SELECTS: dict[str, tuple[str, str]] = {
    "graph_relation": ("SELECT ?a ?b WHERE { ?a qy:cites ?b }", f"select a.value as a, b.value as b from {rel('cites')} r join {_NODES} a on a.id = r.subject join {_NODES} b on b.id = r.object"),
    "graph_path": ("SELECT ?a ?c WHERE { ?a qy:partOf ?b . ?b qy:locatedIn ?c }", f"select a.value as a, c.value as c from {rel('partOf')} r join {rel('locatedIn')} s on s.subject = r.object join {_NODES} a on a.id = r.subject join {_NODES} c on c.id = s.object"),
    "graph_counts": ("SELECT ?o (COUNT(?s) AS ?n) WHERE { ?s qy:memberOf ?o } GROUP BY ?o", f"select o.value as o, count(*) as n from {rel('memberOf')} r join {_NODES} o on o.id = r.object group by 1"),
    "graph_property": (
        'SELECT ?s ?v WHERE { ?s qy:label ?v . FILTER(STRSTARTS(?v, "amber")) }',
        f"select s.value as s, p.v from (select distinct subject, literal_value as v, ltype from (select subject, literal_value, replace(replace(replace(trim(coalesce(literal_type, '')), '<', ''), '>', ''), 'xsd:', 'http://www.w3.org/2001/XMLSchema#') as lt, case when lt = '' then 'http://www.w3.org/2001/XMLSchema#string' else lt end as ltype from node_properties where predicate in {_PRED.format('label')} and literal_value like 'amber%') where ltype <> 'http://www.w3.org/2001/XMLSchema#boolean') p join {_NODES} s on s.id = p.subject",
    ),
    "graph_lang": (
        'SELECT ?s ?v ?l WHERE { ?s qy:label ?v FILTER(LANGMATCHES(LANG(?v), "en")) BIND(LANG(?v) AS ?l) }',
        f"select s.value as s, p.v, p.l from (select distinct subject, literal_value as v, substr(trim(literal_type), 2) as l from node_properties where predicate in {_PRED.format('label')} and literal_value is not null and lower(trim(literal_type)) like '@en%') p join {_NODES} s on s.id = p.subject",
    ),
    "graph_blank": ("SELECT ?s ?o WHERE { ?s qy:kindOf ?o FILTER(ISBLANK(?s)) }", f"select s.value as s, o.value as o from {rel('kindOf')} r join {_NODES} s on s.id = r.subject join {_NODES} o on o.id = r.object where s.kind = 'blank'"),
    "graph_reach": (
        "SELECT ?a ?b WHERE { ?a qy:partOf+ ?b }",
        f"with recursive step as {rel('partOf')}, walk as (select subject, object from step union select w.subject, s.object from walk w join step s on s.subject = w.object) select a.value as a, b.value as b from walk join {_NODES} a on a.id = walk.subject join {_NODES} b on b.id = walk.object",
    ),
    "graph_reach_from": (
        "SELECT ?b WHERE { <http://quarry.example/id/none> qy:partOf* ?b }",
        "select 'http://quarry.example/id/none' as b",
    ),
    "graph_semi": ("SELECT ?a ?b WHERE { ?a qy:partOf ?b . ?b qy:hasPart ?a }", f"select a.value as a, b.value as b from {rel('partOf')} r join {rel('hasPart')} k on k.subject = r.object and k.object = r.subject join {_NODES} a on a.id = r.subject join {_NODES} b on b.id = r.object"),
}


def _select(make, text: str):
    return lambda spark, sf_dir: make(spark, sf_dir).query(text).values


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("s.value").alias("s"), "p", F.col("o.value").alias("o"))


def construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "CONSTRUCT { ?n t:inRegion ?name . ?n a t:Nation . ?r t:holds ?n } WHERE { ?n t:n_regionkey ?r . ?r t:r_name ?name }"
    return _flat(engine(spark, sf_dir).query(text).df)


def construct_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template with a blank node, a new one for each solution; their labels are left out."""
    found = engine(spark, sf_dir).query("CONSTRUCT { ?n t:called [ t:name ?name ] } WHERE { ?n t:n_name ?name }").df

    def shown(c: str):
        return F.when(F.col(f"{c}.kind") == "blank", "_").otherwise(F.col(f"{c}.value")).alias(c)

    return found.select(shown("s"), "p", shown("o"))


def describe_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(engine(spark, sf_dir).query("DESCRIBE n:3").df)


def construct_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(engine(spark, sf_dir).query("CONSTRUCT { ?s t:s_nationkey ?o } WHERE { ?s t:s_nationkey ?o }").df)


def describe_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(encoded(spark, sf_dir).describe_object_by_id(1010).df)


def describe_object_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest node of ``objects`` with relations both ways and properties."""
    relations, properties = table(spark, sf_dir, "relations"), table(spark, sf_dir, "node_properties").where("literal_value is not null")
    ids = table(spark, sf_dir, "objects").select("id").intersect(relations.select("subject")).intersect(relations.select("object")).intersect(properties.select("subject"))
    return _flat(encoded(spark, sf_dir).describe_object_by_id(ids.agg(F.min("id").alias("id")).head().id).df)


def describe_predicate_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest predicate with relations and the smallest with properties; none of the tables' has both."""
    store = encoded(spark, sf_dir)
    tables = table(spark, sf_dir, "relations"), table(spark, sf_dir, "node_properties").where("literal_value is not null")
    one, two = (store.describe_predicate_by_id(t.agg(F.min("predicate").alias("id")).head().id).df for t in tables)
    return _flat(one.unionByName(two))


def subject_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, sf_dir).get_relation_subject_list(_QY + "inDataset", _core_iri(spark, sf_dir))


def _core_iri(spark: SparkSession, sf_dir: str) -> str:
    return table(spark, sf_dir, "core_objects").where("kind = 'iri'").agg(F.min("value").alias("v")).head().v


def ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = [(q, engine(spark, sf_dir).query(f"ASK {{ {q} }}")) for q in ("n:1 t:n_regionkey ?r", "n:999 t:n_regionkey ?r")]
    return spark.createDataFrame(answers, "pattern string, answer boolean")


def shorten_iri(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {r.prefix: r.namespace for r in table(spark, sf_dir, "prefixes").toLocalIterator()}
    return table(spark, sf_dir, "objects").where("kind = 'iri'").select("id", shorten_column(F.col("value"), known).alias("short"))


QUERIES = {
    **{name: _select(engine, text) for name, (text, _) in SELECTS.items()},
    **{name: _select(encoded, text) for name, (text, _) in GRAPH_SELECTS.items()},
    **{f.__name__: f for f in (construct, construct_blank, describe_object, construct_predicate, describe_by_id, describe_object_by_id, describe_predicate_by_id, subject_list, ask, shorten_iri)},
}



def _described(relations: str, properties: str) -> str:
    """SQL text of the distinct triples of some relations and some properties."""
    return (
        "with recs as (select subject, predicate, literal_value, coalesce(literal_type, '') as literal_type from node_properties where literal_value is not null and " + properties + "),"
        + read("predicates", "iri")
        + ","
        + read("recs", "literal_type")
        + f", rel_rows as (select distinct s.kind as sk, s.value as s, p.term as p, o.kind as ok, o.value as o from relations r join read_predicates p on p.id = r.predicate join {_NODES} s on s.id = r.subject join {_NODES} o on o.id = r.object where {relations}),"
        + f" prop_rows as (select distinct s.kind as sk, s.value as s, p.term as p, r.literal_value as o, case when r.term = '' then 'http://www.w3.org/2001/XMLSchema#string' else r.term end as datatype from read_recs r join read_predicates p on p.id = r.predicate join {_NODES} s on s.id = r.subject)"
        + " select s, p, o from rel_rows union all select s, p, o from prop_rows"
    )


_MANY_SIDED = "(select min(id) from objects where id in (select subject from relations) and id in (select object from relations) and id in (select subject from node_properties where literal_value is not null))"
_CUSTOMER_3 = "(select * from customer where c_nationkey = 3)"
SQL = {name: sql for name, (_, sql) in {**SELECTS, **GRAPH_SELECTS}.items()} | {
    "construct": f"select {_N} as s, '{NS}inRegion' as p, r_name as o from nation join region on r_regionkey = n_regionkey union select {_N}, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{NS}Nation' from nation union select {iri('region', 'n_regionkey')}, '{NS}holds', {_N} from nation",
    "construct_blank": f"select {_N} as s, '{NS}called' as p, '_' as o from nation union all select '_', '{NS}name', n_name from nation",
    "describe_object": f"select {_N} as s, '{NS}n_nationkey' as p, cast(n_nationkey as varchar) as o from nation where n_nationkey = 3 union all select {_N}, '{NS}n_name', n_name from nation where n_nationkey = 3 union all select {_N}, '{NS}n_regionkey', {iri('region', 'n_regionkey')} from nation where n_nationkey = 3 union all select {_C}, '{NS}c_nationkey', '{BASE}nation/3' from customer where c_nationkey = 3 union all select {_S}, '{NS}s_nationkey', '{BASE}nation/3' from supplier where s_nationkey = 3",
    "construct_predicate": f"select {_S} as s, '{NS}s_nationkey' as p, {iri('nation', 's_nationkey')} as o from supplier",
    "describe_by_id": "with " + read("predicates", "iri") + f"select distinct s.value as s, p.term as p, o.value as o from relations r join read_predicates p on p.id = r.predicate join {_NODES} s on s.id = r.subject join {_NODES} o on o.id = r.object where 1010 in (r.subject, r.object)",
    "describe_object_by_id": _described(f"{_MANY_SIDED} in (r.subject, r.object)", f"subject = {_MANY_SIDED}"),
    "describe_predicate_by_id": _described("r.predicate = (select min(predicate) from relations)", "predicate = (select min(predicate) from node_properties where literal_value is not null)"),
    "subject_list": f"select s.value as subject, r.subject as subject_id, r.object as object_id from {rel('inDataset')} r join {_NODES} s on s.id = r.subject where r.object in (select id from core_objects where value = (select min(value) from core_objects where kind = 'iri'))",
    "ask": "select 'n:1 t:n_regionkey ?r' as pattern, true as answer union all select 'n:999 t:n_regionkey ?r', false",
    "shorten_iri": "select o.id, coalesce((select arg_max(p.prefix, length(p.namespace)) || ':' || substr(o.value, max(length(p.namespace)) + 1) from prefixes p where starts_with(o.value, p.namespace) and length(o.value) > length(p.namespace)), o.value) as short from objects o where kind = 'iri'",
}
