"""The bulk operators against brute force and on odd inputs."""

import decimal
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ontoloom.functions.iri import XSD, read_iris
from ontoloom.operators import faults, hierarchy, runs, wide
from ontoloom.plans import bulk, bulk_sql

SMALL = "/root/testdata/sf0.001"


# hierarchies
def walk(links):
    """(root, depth, path) of every node, by following parents."""
    parent, nodes = {}, set()
    for c, p in links:
        nodes |= {x for x in (c, p) if x is not None}
        if c is not None and p is not None:
            parent[c] = min(p, parent.get(c, p))
    out = {}
    for n in nodes:
        path = [n]
        while path[-1] in parent and len(path) <= len(nodes) + 1:
            path.append(parent[path[-1]])
        if len(path) <= len(nodes):
            out[n] = (path[-1], len(path) - 1, path[::-1])
        else:
            on, at = False, parent[n]
            for _ in nodes:
                on, at = on or at == n, parent[at]
            out[n] = (-1, -1 if on else -2, None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy_matches_walking(spark, seed):
    r = random.Random(seed)
    links = [(c, r.randrange(c + 1) if r.random() < 0.97 else r.randrange(200)) for c in range(1, 200) if r.random() < 0.9]
    links += [(None, None), (300, None), (None, 301)] + links[:20] + [(310, 309), (309, 308), (308, 310), (311, 310), (312, 311)]
    df = spark.createDataFrame([(c, p, "x") for c, p in links], "child long, parent long, node string").repartition(3)
    found = {x.node: (x.root, x.depth, x.path) for x in hierarchy.hierarchy(df).collect()}
    assert found == walk(links)


def test_hierarchy_of_a_chain_and_a_star(spark):
    df = spark.createDataFrame([(i + 1, i) for i in range(100)] + [(1000 + i, 0) for i in range(500)], "c int, p int")
    tree = hierarchy.hierarchy(df, "c", "p")
    assert tree.agg({"depth": "max"}).head()[0] == 100 and tree.count() == 601
    below = hierarchy.descendants(tree)
    assert below.count() == 100 * 101 // 2 + 500 and below.where("ancestor = 50").count() == 50
    assert below.where("ancestor = 50 and descendant = 60").head().distance == 10


def test_links_that_are_not_followed_are_told(spark):
    links = [(2, 1), (2, 5), (2, 5), (2, 9), (3, 2), (4, None), (None, 4), (5, 5), (5, 3), (7, 1), (7, 1)]
    df = spark.createDataFrame([(*x, 0) for x in links], "child long, parent long, node int")
    assert {(x.node, x.parent) for x in hierarchy.further_parents(df).collect()} == {(2, 5), (2, 9), (5, 5)}
    followed = {(c, min(p for a, p in links if a == c and p is not None)) for c, p in links if None not in (c, p)}
    assert followed | {(2, 5), (2, 9), (5, 5)} == {(c, p) for c, p in links if None not in (c, p)}
    assert hierarchy.further_parents(df.limit(0)).count() == 0


def test_hierarchy_of_nothing(spark):
    assert hierarchy.hierarchy(spark.createDataFrame([], "child long, parent long")).count() == 0
    relations = bulk.table(spark, SMALL, "relations")
    terms = bulk.table(spark, SMALL, "predicates").withColumnRenamed("iri", "term")
    assert hierarchy.hierarchy(hierarchy.parent_links(relations, terms, ["no"], ["none"])).count() == 0


def test_hierarchy_of_text_ids(spark):
    found = hierarchy.hierarchy(spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "x")], "child string, parent string")).collect()
    assert {(r.node, r.root, r.depth) for r in found} == {("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("x", "-1", -1)}


# heavy keys
def test_runs_match_counting(spark):
    r = random.Random(5)
    rows = [(r.choice([None, 1, 1, 1, 1, 2, r.randrange(50)]), r.choice(["a", None, "b"]), r.choice([None, 7, 7, 7, r.randrange(400)])) for _ in range(30_000)]
    rows += [(9, "hot", 1)] * 20_000
    df = spark.createDataFrame([(*x, 0, 1) for x in rows], "key0 int, rows string, record long, tie int, first int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "997")
    try:
        found = {(x[0], x[1]): (x[2], x[3]) for x in runs.count_runs(df.withColumnRenamed("rows", "k"), ["key0", "k"], "record").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    counts, sets = defaultdict(int), defaultdict(set)
    for a, b, s in rows:
        counts[a, b] += 1
        sets[a, b] |= {s} - {None}
    assert found == {k: (n, len(sets[k])) for k, n in counts.items()}


def test_hot_copies_are_spread_over_ranges(spark):
    df = spark.range(60_000).selectExpr("1L as subject", "2L as predicate", "3L as object")
    pairs = df.select(F.col("predicate").alias("key0"), F.col("subject").alias("record"), runs.tie().alias("tie"))
    sizes = [len(x) for x in pairs.repartitionByRange(4, "key0", "record", "tie").rdd.glom().collect()]
    assert max(sizes) < 30_000
    assert {tuple(x) for x in runs.graph_key_counts(df).collect()} == {("predicate", 2, 60_000, 1), ("object", 3, 60_000, 1)}
    assert runs.graph_key_counts(df.limit(0)).count() == 0


def test_only_ends_of_ranges_are_stitched(spark):
    rows = [(k, s) for k in range(300) for s in range(7)] + [(1000, s % 900) for s in range(9000)]
    df = spark.createDataFrame(rows, "k int, s int").repartition(3)
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        states = runs.run_states(df, ["k"], "s").withColumn("part", F.spark_partition_id()).collect()
        counts = {tuple(x) for x in runs.count_runs(df, ["k"], "s").collect()}
    finally:
        for name in settings:
            spark.conf.unset(name)
    ends = [x.part for x in states if x.at is not None]
    assert max(map(ends.count, ends)) <= 2 and len({x.part for x in states}) > 1
    assert len(states) <= 301 + len(set(ends))
    assert all(x["first"] is None for x in states if x.at is None)
    assert counts == {(k, 7, 7) for k in range(300)} | {(1000, 9000, 900)}


def test_keys_that_are_not_numbers_are_one_key(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, 1), (nan, 2), (None, 1), (0.5, None), (None, 1)], "k double, s int")
    found = {(str(x.k), x.rows, x.records) for x in runs.count_runs(df, ["k"], "s").collect()}
    assert found == {("nan", 2, 2), ("None", 2, 1), ("0.5", 1, 0)}


# wide tables
COLUMNS = [(1, "n", "bigint"), (2, "d", "decimal"), (3, "x", "double"), (4, "b", "boolean"), (5, "day", "date"), (6, "at", "timestamp"), (7, "s", "string"), (8, "s", "string")]


def cells_of(spark, rows):
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "subject long, predicate long, literal_value string, column_name string, low int")
    columns = spark.createDataFrame(COLUMNS, "predicate long, column_name string, column_type string")
    return wide.cells(df, columns), columns


@pytest.mark.parametrize(
    "predicate,same,other,bad",
    [
        (1, ["7", "+7", "0007"], "8", ["7.0", " 7", "x", "9223372036854775808", ""]),
        (2, ["7.0", "07", "+7.", "7.00"], "-7", ["7e0", ".", "1,0", "NaN"]),
        (2, ["0", "-0.0", "+.0"], "0.1", ["--1"]),
        (3, ["1e2", "100", "100.0E0", "+1.0e+2"], "1e-2", ["100d", "inf", "1e", "+INF"]),
        (3, ["NaN", "NaN"], "INF", ["nan"]),
        (3, ["0", "-0.0"], "1", ["Infinity"]),
        (4, ["true", "1"], "0", ["TRUE", "yes", " 1"]),
        (5, ["2024-02-29"], "2024-02-28", ["2023-02-29", "2024-2-9", "2024-02-29Z"]),
        (6, ["2024-01-01T00:00:00", "2024-01-01T00:00:00Z", "2024-01-01T02:00:00.000+02:00", "2023-12-31T23:00:00.0-01:00"], "2024-01-01T00:00:00.0000001", ["2024-01-01", "2024-01-01T25:00:00", "2024-13-01T00:00:00", "2024-01-01 00:00:00"]),
        (7, ["a ", "a "], "a", []),
    ],
)
def test_spellings_of_one_value(spark, predicate, same, other, bad):
    rows = [(1, predicate, v) for v in same + bad + [None]] + [(2, predicate, v) for v in [same[0], other]]
    found, columns = cells_of(spark, rows)
    by = {r.subject: r for r in found.collect()}
    assert by[1].low == by[1].high and by[1].n_read == len(same) and by[1].n_values == len(same + bad)
    assert by[1].unread == (min(bad) if bad else None)
    assert [r.subject for r in wide.conflicts(wide.widen(found, columns)).collect()] == [2]


def test_wide_rows(spark):
    found, columns = cells_of(spark, [(1, 1, "5"), (1, 2, "1.50"), (1, 6, "2024-01-01T00:00:00.25Z"), (1, 7, "a"), (1, 8, "b"), (2, 4, "maybe"), (3, 2, "9" * 40), (4, 99, "x"), (None, 1, "3"), (1, None, "3"), (1, 5, None)])
    rows = {r.subject: r for r in wide.widen(found, columns).collect()}
    assert set(rows) == {1, 2, 3, None}
    assert (rows[1].n, rows[1].d, rows[1].s, rows[1].conflicts, rows[1].failures) == (5, decimal.Decimal("1.5"), "a", ["s"], {})
    assert rows[1]["at"].isoformat() == "2024-01-01T00:00:00.250000" and rows[1].day is None
    assert rows[2].b is None and rows[2].failures == {"b": "maybe"} and rows[3].d is None and rows[3].failures == {"d": "9" * 40}
    empty, columns = cells_of(spark, [])
    assert wide.widen(empty, columns).count() == 0 and wide.conflicts(wide.widen(empty, columns)).count() == 0


def test_columns_named_as_those_of_the_result(spark):
    columns = spark.createDataFrame([(1, "subject", "bigint"), (2, "subject_", "string"), (3, "failures", "string"), (4, None, "string")], "predicate long, column_name string, column_type string")
    df = spark.createDataFrame([(9, 1, "5"), (9, 2, "x"), (9, 3, "y"), (9, 4, "z")], "subject long, predicate long, literal_value string")
    (row,) = wide.widen(wide.cells(df, columns), columns).collect()
    assert row.asDict() == {"subject": 9, "subject_": 5, "subject__": "x", "failures_": "y", "conflicts": [], "failures": {}, "n_failed": {}}


def test_further_types_of_a_column_are_set_apart(spark):
    columns = spark.createDataFrame([(1, "a", "string"), (1, "a", "bigint"), (2, "b", "date")], "predicate long, column_name string, column_type string")
    df = spark.createDataFrame([(9, 1, "5"), (9, 1, "05"), (9, 2, "x"), (8, 1, "no")], "subject long, predicate long, literal_value string")
    rows = {r.subject: r for r in wide.widen(wide.cells(df, columns), columns).collect()}
    assert (rows[9].a, rows[9].conflicts, rows[9].failures, rows[9].n_failed) == (5, ["a:string"], {"a:string": "05", "b": "x"}, {"a:string": 2, "b": 1})
    assert (rows[8].a, rows[8].conflicts, rows[8].failures) == (None, [], {"a": "no", "a:string": "no"})


def test_more_columns_than_a_plan_holds_stay_a_map(spark, monkeypatch):
    rows = [(s, p, f"{s * p}") for s in range(4) for p in range(13)] + [(1, 3, "x"), (1, 5, "7")]
    df = spark.createDataFrame(rows, "subject long, predicate long, literal_value string")
    columns = spark.createDataFrame([(p, f"c{p:02}", "bigint") for p in range(12)] + [(12, "c00", "string")], "predicate long, column_name string, column_type string")
    typed = {r.subject: r for r in wide.widen(wide.cells(df, columns), columns).collect()}
    monkeypatch.setattr(wide, "MOST_COLUMNS", 12)  # one less than there are pairs of name and type
    found = wide.widen(wide.cells(df, columns), columns)
    assert found.columns == ["subject", "values", "conflicts", "failures", "n_failed"] and found.count() == 4
    for r in found.collect():
        one = typed[r.subject]
        own = {k: int(v) for k, v in r["values"].items() if ":" not in k}
        assert own == {f"c{p:02}": one[f"c{p:02}"] for p in range(12)} and r["values"]["c00:string"] == f"{r.subject * 12}"
        assert (r.conflicts, r.failures, r.n_failed) == (one.conflicts, one.failures, one.n_failed)


def test_every_failed_text_is_kept(spark):
    over = ["9" * 40, "+" + "8" * 30]
    rows = [(1, 2, v) for v in ["", "--4236", "--4236", "5", *over, over[0], None]] + [(1, 1, "x"), (2, 2, "1"), (2, 2, over[0]), (3, 1, "7"), (None, 1, "y")] + [(4, 4, f"no{n % 50}") for n in range(500)]
    found, columns = cells_of(spark, rows)
    df = spark.createDataFrame(rows, "subject long, predicate long, literal_value string")
    failed = {(r.subject, r.column_name, r.value): (r.reason, r.n_rows) for r in wide.failures(df, columns).collect()}
    wanted = {(1, "d", ""): ("unreadable", 1), (1, "d", "--4236"): ("unreadable", 2), (1, "d", over[0]): ("unfit", 2), (1, "d", over[1]): ("unfit", 1), (1, "n", "x"): ("unreadable", 1), (2, "d", over[0]): ("unfit", 1), (None, "n", "y"): ("unreadable", 1)}
    assert failed == wanted | {(4, "b", f"no{n}"): ("unreadable", 10) for n in range(50)}
    # the wide rows name every cell with a failed text, and only those
    smallest, n_rows = {}, defaultdict(int)
    for (s, c, v), (_, n) in failed.items():
        smallest[s, c] = min(v, smallest.get((s, c), v))
        n_rows[s, c] += n
    wide_rows = wide.widen(found, columns).collect()
    assert {(r.subject, c): v for r in wide_rows for c, v in r.failures.items()} == smallest
    assert {(r.subject, c): v for r in wide_rows for c, v in r.n_failed.items()} == n_rows


def test_values_that_would_lose_digits_are_failures(spark):
    small, fine = "0.0000000000001", "0.12345678901249"
    at, full = "2024-01-01T00:00:00.1234567", "9" * 26 + ".9999999999999"
    rows = [(1, 2, small), (1, 6, at), (2, 2, fine), (2, 2, "1.5"), (2, 6, "2024-01-01T00:00:00.123456000Z"), (3, 2, full), (4, 2, "-" + "9" * 26 + "." + "9" * 12 + "0"), (5, 2, small), (5, 2, fine)]
    found, columns = cells_of(spark, rows)
    by = {r.subject: r for r in wide.widen(found, columns).collect()}
    assert by[1].d is None and by[1]["at"] is None and by[1].failures == {"d": small, "at": at} and by[1].conflicts == []
    assert by[2].d == decimal.Decimal("1.5") and by[2].failures == {"d": fine} and by[2].conflicts == ["d"]
    assert by[2]["at"].isoformat() == "2024-01-01T00:00:00.123456"
    assert by[3].d is None and by[3].failures == {"d": full}
    assert by[4].d == decimal.Decimal("-" + "9" * 26 + "." + "9" * 12) and by[4].failures == {}
    assert by[5].d is None and by[5].failures == {"d": small} and by[5].n_failed == {"d": 2} and by[5].conflicts == ["d"]
    failed = wide.failures(spark.createDataFrame(rows, "subject long, predicate long, literal_value string"), columns)
    assert {(r.subject, r.value) for r in failed.where("reason = 'unfit'").collect()} == {(1, small), (1, at), (2, fine), (3, full), (5, small), (5, fine)}


def test_conflicts_are_read_off_the_maps(spark):
    found = bulk.p4_found(spark, SMALL)
    assert "map_from_entries" in found._jdf.queryExecution().optimizedPlan().toString()
    wide_rows = bulk.p4_wide(spark, SMALL).select("subject", "conflicts").collect()
    assert sorted((r.subject, r.column_name) for r in found.collect()) == sorted((r.subject, c) for r in wide_rows for c in r.conflicts.split("; ") if c)


def test_failures_of_nothing(spark):
    columns = spark.createDataFrame(COLUMNS, "predicate long, column_name string, column_type string")
    df = spark.createDataFrame([], "subject long, predicate long, literal_value string")
    assert wide.failures(df, columns).count() == 0


def test_very_long_values(spark):
    long = "1." + "0" * 300_000 + "1" + "0" * 300_000
    found, _ = cells_of(spark, [(1, 2, long), (1, 2, "1." + "0" * 300_000 + "1"), (1, 7, "x" * 500_000)])
    assert {(r.column_name, r.low == r.high) for r in found.collect()} == {("d", True), ("s", True)}


# faults
def csv_reason(line):
    """The fault of a line, read character by character."""
    fields, at, line = 0, 0, line or ""
    while True:
        fields += 1
        if line[at : at + 1] == '"':
            at += 1
            while True:
                end = line.find('"', at)
                if end < 0:
                    return "quoting"
                if line[end + 1 : end + 2] == '"':
                    at = end + 2
                    continue
                at = end + 1
                break
            if line[at : at + 1] not in ("", ","):
                return "quoting"
        else:
            end = line.find(",", at)
            end = len(line) if end < 0 else end
            if '"' in line[at:end]:
                return "quoting"
            at = end
        if at >= len(line):
            return None if fields == 4 else "columns"
        at += 1


def test_lines(spark):
    r = random.Random(3)
    lines = ["".join(r.choice('",a\n \\') for _ in range(r.randrange(14))) for _ in range(4000)] + ["", None, "1,2,,", '1,2,"a ""b"", c\nd",', ",,,", '1,2,"' + "x" * 300_000 + '",', '1,2,"' + '""' * 200_000 + '",', "," * 200_000]
    df = spark.createDataFrame([(n, x, "z") for n, x in enumerate(lines)], "line_id long, line string, text string")
    found = {x.row_id: x for x in faults.split_lines(df).collect()}
    assert [found[n].fault for n in range(len(lines))] == [csv_reason(x) for x in lines]
    whole = next(x for x in found.values() if lines[x.row_id] == '1,2,"a ""b"", c\nd",')
    assert (whole.subject, whole.literal_value, whole.literal_type) == ("1", 'a "b", c\nd', "")


def test_classify(spark):
    prefixes = spark.createDataFrame([(XSD, "xsd"), (None, "no"), ("http://z/", "z"), ("http://a/", "z"), (XSD + "inte", "@q")], "namespace string, prefix string")
    cases = [
        ("5", "xsd:integer", None), ("5.0", " <" + XSD + "integer> ", "value"), ("2147483648", "xsd:int", "value"), ("2147483647", "xsd:int", None), ("-1", "xsd:nonNegativeInteger", "value"), ("-0", "xsd:nonNegativeInteger", None),
        ("x", None, None), ("x", "", None), ("x", "  ", None), (None, None, "value"), (None, "xsd:nope", "type"), ("x", "xsd:string", None), ("x", "@en-GB", None), ("x", "@en_GB", "type"), ("x", "@e", "type"), ("x", "@" + "ab-" * 100_000 + "c", None),
        ("true\n", "xsd:boolean", "value"), ("1e5", "xsd:float", None), ("1e5", "xsd:decimal", "value"), (".", "xsd:decimal", "value"), ("5.", "xsd:decimal", None), ("2024-02-30", "xsd:date", "value"), ("2024-01-01T10:00:00+2", "xsd:dateTime", "value"), ("2024-01-01T10:00:00.5-05:30", "xsd:dateTime", None),
        ("1", "<" + XSD + "integer", "type"), ("1", "XSD:integer", "type"), ("x", "@q:ger", "value"), ("7", "<@q:ger>", None), ("x", "no:string", "type"), ("x", "xsd:string>", "type"), ("7", "xsd:integer>", "type"),
    ]
    rows = spark.createDataFrame([(n, v, t, None, "x") for n, (v, t, _) in enumerate(cases)] * 2, "row_id long, literal_value string, literal_type string, fault string, reason string")
    found = faults.classify(rows, prefixes).collect()
    assert len(found) == 2 * len(cases) and {x.row_id: x.reason for x in found} == {n: c[2] for n, c in enumerate(cases)}
    assert faults.classify(rows.limit(0), prefixes).count() == 0


def test_ids_of_lines_that_are_no_numbers_are_kept(spark):
    lines = [(1, "1,2,x,"), (2, "abc,5,hello,"), (3, ",+7,y,"), (4, '"9223372036854775808",1e3,z,'), (5, None)]
    properties = spark.createDataFrame([], "row_id long, subject long, predicate long, literal_value string, literal_type string")
    found = faults.records(properties, spark.createDataFrame([(*x, "s") for x in lines], "line_id long, line string, subject string"))
    rows = {x.row_id: (x.subject, x.predicate, x.subject_text, x.predicate_text) for x in found.collect()}
    assert rows == {1: (1, 2, None, None), 2: (None, 5, "abc", None), 3: (None, 7, "", None), 4: (None, None, "9223372036854775808", "1e3"), 5: (None, None, None, None)}


def test_rows_are_not_shuffled_while_the_dictionary_is_small(spark):
    plan = bulk.QUERIES["p5_loaded"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_read_iris(spark):
    prefixes = spark.createDataFrame([("http://p/", "p"), ("http://q/", "")], "namespace string, prefix string")
    cases = {" p:x ": "http://p/x", "<p:x>": "http://p/x", "<p:x": "<p:x", "p:": "http://p/", ":y": "http://q/y", "P:x": "P:x", "nocolon": "nocolon", "<>": "", "<": "<", "": "", "p:a:b": "http://p/a:b", None: None}
    df = spark.createDataFrame([(k, "n", "h") for k in cases], "raw string, namespace string, prefix string")
    assert {r.raw: r.term for r in read_iris(df, "raw", prefixes, "term").collect()} == cases


@pytest.mark.parametrize("name", sorted(bulk_sql.SQL))
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("relations", "node_properties", "predicates", "prefixes", "wide_columns", "property_lines"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    rel = con.execute(bulk_sql.SQL[name])
    columns = [c[0] for c in rel.description]
    expected = sorted(map(repr, rel.fetchall()))
    assert sorted(repr(tuple(r)) for r in bulk.QUERIES[name](spark, SMALL).select(*columns).collect()) == expected
