"""The queries of the text operators; their SQL, where SQL can express them, is in ``sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ontoloom.llm import leaks, looks, terms, tokens
from ontoloom.plans.bulk import table
from ontoloom.sources.scratch import Scratch


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.graph_terms(*(table(spark, sf_dir, t) for t in ("relations", "node_properties", "predicates", "prefixes")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).where("mark is not null").select("field", "term", "mark")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).select("field", "term", "rows", "records")


#: Where the vocabulary is unless the session's ``spark.ontoloom.vocabulary`` names another file, readable on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"), spark.conf.get("spark.ontoloom.vocabulary", VOCABULARY))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id")


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of windows of 10 words with at most one word edit."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), errors=1)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = Scratch(spark, "looks").save(looks.form_keys(table(spark, sf_dir, "documents")), "keys")
    return looks.look_alikes(keys)


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear form of p8_found: a row per document, with its class and its spelling."""
    keys = Scratch(spark, "looks").save(looks.form_keys(table(spark, sf_dir, "documents")), "keys")
    return looks.classes(keys)


def p8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed and whole-script confusable tokens of every text."""
    return looks.forms(table(spark, sf_dir, "documents")).select("doc_id", "mixed_tokens", "whole_tokens")


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looks.forms(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_counts, p6_ids, p7_found, p7_near, p8_found, p8_classes, p8_tokens, p8_forms)}


def __getattr__(name: str):
    """``SQL``: name -> the same query in SQL; made when it is asked for, as its tables of characters are long."""
    if name == "SQL":
        from ontoloom.llm.sql import SQL

        return SQL
    raise AttributeError(name)
