"""The queries of the general bulk operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontoloom.functions.iri import read_iris
from ontoloom.operators import faults, hierarchy, runs, wide

#: The hierarchical predicates, child first and parent first.
NS = "http://quarry.example/ns#"
UP, DOWN = [NS + "partOf", NS + "broader"], [NS + "hasPart", NS + "narrower"]


_schemas: dict[tuple[str, str], T.StructType] = {}


def schema(spark: SparkSession, sf_dir: str, name: str) -> T.StructType:
    """The schema of a table, looked up once per application."""
    path = f"{sf_dir}/{name}.parquet"
    key = spark.sparkContext.applicationId, path
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return _schemas[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.schema(schema(spark, sf_dir, name)).parquet(f"{sf_dir}/{name}.parquet")


def _links(spark: SparkSession, sf_dir: str, up: list[str], down: list[str]) -> DataFrame:
    terms = read_iris(table(spark, sf_dir, "predicates"), "iri", table(spark, sf_dir, "prefixes"), "term")
    return hierarchy.parent_links(table(spark, sf_dir, "relations"), terms, up, down)


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(_links(spark, sf_dir, UP, DOWN))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select("node", "root", "depth")


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select("node", F.concat_ws("/", F.col("path").cast("array<string>")).alias("path")).where("path != ''")


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(_tree(spark, sf_dir))


def p1_further(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links beyond the first parent, over relations that have such."""
    return hierarchy.further_parents(_links(spark, sf_dir, [NS + "memberOf", NS + "cites"], []))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = runs.graph_key_counts(table(spark, sf_dir, "relations"))
    total = counts.where("field = 'predicate'").agg(F.sum("rows").alias("total"))
    return counts.where("key_id is not null").join(F.broadcast(total), F.col("rows") * 100 >= F.col("total")).select("field", "key_id")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.graph_key_counts(table(spark, sf_dir, "relations"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.cells(table(spark, sf_dir, "node_properties"), table(spark, sf_dir, "wide_columns"))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.widen(_cells(spark, sf_dir), table(spark, sf_dir, "wide_columns"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.conflicts(_wide(spark, sf_dir))


def p4_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table; its list and its maps as sorted texts."""
    rows = _wide(spark, sf_dir)
    texts = {c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), "; ").alias(c) for c in ("failures", "n_failed")}
    return rows.select(*[c for c in rows.columns if c not in ("conflicts", *texts)], F.array_join("conflicts", "; ").alias("conflicts"), *texts.values())


def p4_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("subject", "column_name", "n_values", "n_read", "unread")


def p4_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.failures(table(spark, sf_dir, "node_properties"), table(spark, sf_dir, "wide_columns"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.classify(faults.records(table(spark, sf_dir, "node_properties"), table(spark, sf_dir, "property_lines")), table(spark, sf_dir, "prefixes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).where("reason is not null").select("origin", "row_id", "reason")


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).where("reason is null").select("origin", "row_id", "subject", "predicate", "literal_value", "literal_type", "subject_text", "predicate_text")


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_further, p2_found, p2_counts, p4_found, p4_wide, p4_cells, p4_failures, p5_found, p5_loaded)}
