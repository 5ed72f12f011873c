"""Frequency of every term: rows and distinct records, with a mark on the too rare and too common.

(term, record) pairs are range-partitioned, sorted externally and scanned for runs; the
partial states at range borders are stitched (see ``operators.runs``).  A term travels as a
number: spellings are read once each and numbered in a written dictionary, a join side that
the planner broadcasts only while it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.iri import XSD, read_iris
from ontoloom.operators.runs import count_runs
from ontoloom.sources.scratch import Scratch


def term_counts(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """(field, term, rows, records) for every row of ``terms`` (code, field, term).

    ``pairs`` holds (code, record).  Null records count as rows only; a term without pairs has
    0 and 0; pairs of other codes are left out.
    """
    counts = count_runs(pairs, ["code"], "record")
    return terms.join(counts, "code", "left").select("field", "term", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("records", F.lit(0)).alias("records"))


def numbered(read: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(spellings, terms) of ``read`` (field, raw, term), with a code for each (field, term)."""
    known = scratch.save(read.distinct(), "read")
    terms = scratch.save(known.select("field", "term").distinct().withColumn("code", F.monotonically_increasing_id()), "terms")
    return known.join(terms, ["field", "term"]).select("field", "raw", "code"), terms


def mark(records: Column, total: Column, rare_below: int = 5, common_above: float = 0.5) -> Column:
    """'rare' under ``rare_below`` records, 'common' over that share of ``total``, else null."""
    return F.when(records < rare_below, "rare").when(records > total * common_above, "common")


def graph_terms(relations: DataFrame, properties: DataFrame, predicates: DataFrame, prefixes: DataFrame, rare_below: int = 5, common_above: float = 0.5) -> DataFrame:
    """(field, term, rows, records, mark) of predicate IRIs and literal types.

    'iri': every IRI of ``predicates`` (id, iri), over the rows of both tables; 'literal_type': every
    type of ``properties``, null and blank as xsd:string.  Records are distinct subjects.  The share of
    'common' is taken of all subjects of both tables, or of ``properties``.  Null IRIs and rows of unknown predicates
    are left out; empty tables give no rows.
    """
    scratch = Scratch(relations.sparkSession, "terms")
    iris = read_iris(predicates.where("iri is not null").select(F.lit("iri").alias("field"), F.col("id").cast("string").alias("raw"), "iri"), "iri", prefixes, "term").select("field", "raw", "term")
    string = XSD + "string"
    raw_type = F.coalesce("literal_type", F.lit(""))
    types = read_iris(properties.select(raw_type.alias("raw")).distinct().select(F.lit("literal_type").alias("field"), "raw"), "raw", prefixes, "term")
    types = types.select("field", "raw", F.when(F.col("term") == "", string).otherwise(F.col("term")).alias("term"))
    spellings, terms = numbered(iris.unionByName(types), scratch)
    ids = spellings.where("field = 'iri'").select(F.col("raw").cast("bigint").alias("id"), "code").where("id is not null")
    used = relations.select("predicate", "subject").unionByName(properties.select("predicate", "subject"))
    by_iri = used.join(ids, F.col("predicate") == F.col("id")).select("code", F.col("subject").alias("record"))
    by_type = properties.select(raw_type.alias("raw"), F.col("subject").alias("record")).join(spellings.where("field = 'literal_type'").select("raw", "code"), "raw").select("code", "record")
    counts = term_counts(by_iri.unionByName(by_type), terms)
    totals = _subjects(relations, properties)
    return counts.join(F.broadcast(totals), "field").select("field", "term", "rows", "records", mark(F.col("records"), F.col("total"), rare_below, common_above).alias("mark"))


def _subjects(relations: DataFrame, properties: DataFrame) -> DataFrame:
    """(field, total): the two numbers of all subjects, from one aggregation."""
    both = relations.select("subject", F.lit(0).alias("p")).unionByName(properties.select("subject", F.lit(1).alias("p"))).where("subject is not null")
    sums = both.groupBy("subject").agg(F.max("p").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("p"), F.lit(0)).cast("bigint").alias("n_p"))
    return sums.select(F.inline(F.array(F.struct(F.lit("iri").alias("field"), F.col("n").alias("total")), F.struct(F.lit("literal_type").alias("field"), F.col("n_p").alias("total")))))
