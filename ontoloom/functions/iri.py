"""Reading IRIs that are written in several ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The XML Schema namespace and the characters that count as blanks.
XSD = "http://www.w3.org/2001/XMLSchema#"
BLANKS = " \t\n\r\f\x0b"


def bare(c: Column) -> Column:
    """Without blanks at the ends and without one enclosing pair of angle brackets."""
    t = F.btrim(c, F.lit(BLANKS))
    return F.when(t.startswith("<") & t.endswith(">") & (F.length(t) > 1), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)


#: Most prefixes that become part of a plan; more are joined.
MOST_PREFIXES = 10_000


def read_iris(df: DataFrame, column: str, prefixes: DataFrame | dict[str, str], out: str) -> DataFrame:
    """Add ``out``: the IRI that ``column`` stands for; null stays null.

    Blanks at the ends and one enclosing ``<`` ``>`` do not count; if the text before the
    first ``:`` is a prefix of ``prefixes`` (namespace, prefix), prefix and colon stand for
    the namespace.  A table of prefixes is a join side, so the planner broadcasts it only while
    it is small; a dict (prefix -> namespace) becomes an expression.  A prefix given twice
    counts with its smallest namespace.
    """
    text = bare(F.col(f"`{column}`"))
    split = df.withColumn("__text", text).withColumn("__head", F.when(F.locate(":", "__text") > 0, F.substring_index("__text", ":", 1)))
    if isinstance(prefixes, dict):
        pairs = [F.lit(x) for pair in prefixes.items() for x in pair]
        known = split.withColumn("__ns", F.try_element_at(F.create_map(*pairs), F.col("__head")) if pairs else F.lit(None).cast("string"))
    else:
        names = prefixes.where("prefix is not null and namespace is not null").groupBy(F.col("prefix").alias("__pfx")).agg(F.min("namespace").alias("__ns"))
        known = split.join(names, F.col("__head") == F.col("__pfx"), "left").drop("__pfx")
    full = F.concat(F.col("__ns"), F.substr("__text", F.length("__head") + 2))
    return known.withColumn(out, F.coalesce(full, F.col("__text"))).drop("__text", "__head", "__ns")


def prefix_map(prefixes: DataFrame) -> dict[str, str] | None:
    """The table (namespace, prefix) as prefix -> namespace, or None if it has too many rows."""
    rows = prefixes.where("prefix is not null and namespace is not null").select("prefix", "namespace").limit(MOST_PREFIXES + 1).collect()
    if len(rows) > MOST_PREFIXES:
        return None
    out: dict[str, str] = {}
    for prefix, namespace in rows:
        out[prefix] = min(namespace, out.get(prefix, namespace))
    return out
