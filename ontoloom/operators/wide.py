"""Entity-attribute-value rows to one typed row per entity.

First every (entity, column) cell is reduced to a state of fixed size (smallest and largest
value read, counts, one unreadable text); this combines on the map side, so an entity with a
third of all rows costs one state per task.  Then an entity's cells, at most one per wide
column and type, become a key-value map from which the known columns are projected and cast.
All the texts that could not be read or do not fit are in ``failures``, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.lexical import canonical

#: Spark types of the wide columns; a decimal or timestamp that does not fit is kept among the failures.
TYPES = {"bigint": "bigint", "decimal": "decimal(38,12)", "double": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "string": "string"}
#: Most wide columns that become columns of a plan; a wider table stays a map.
MOST_COLUMNS = 5000


#: Canonical texts that the Spark type cannot hold unchanged; those of other types always fit.
UNFIT = {"decimal": r"\A-?[0-9]{27}|\.[0-9]{13}", "timestamp": r"\.[0-9]{7}"}


def _unfit(column_type: Column, text: Column) -> Column:
    """Would a canonical text overflow its type or lose digits in it?"""
    over = F.lit(False)
    for kind, form in UNFIT.items():
        over = F.when(column_type == kind, text.rlike(form)).otherwise(over)
    return F.coalesce(over, F.lit(False))


def _pairs(columns: DataFrame) -> list[tuple[str, str]]:
    """The (column_name, column_type) pairs in order, one more than ``MOST_COLUMNS`` if there are more."""
    known = columns.where("column_name is not null").select("column_name", F.coalesce("column_type", F.lit("")).alias("column_type")).distinct()
    return [tuple(r) for r in known.orderBy("column_name", "column_type").limit(MOST_COLUMNS + 1).collect()]


def _labels(pairs: list[tuple[str, str]]) -> list[str]:
    """A column's smallest type is its own; that of another is named with it."""
    return [name if n == 0 or pairs[n - 1][0] != name else f"{name}:{kind}" for n, (name, kind) in enumerate(pairs)]


def _texts(rows: DataFrame, columns: DataFrame, entity: str, attribute: str, value: str, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(subject, column_name, column_type, value, text, unfit) per row that feeds a column; with ``pairs`` also the code of its pair."""
    wide = columns.where("column_name is not null").select(F.col(attribute).alias("__attribute"), "column_name", F.coalesce("column_type", F.lit("")).alias("column_type")).distinct()
    if pairs is not None:
        # an expression, not a join, so that the side's size stays known
        own = F.array(*[F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("column_type")) for name, kind in pairs])
        wide = wide.withColumn("code", (F.array_position(own, F.struct("column_name", "column_type")) - 1).cast("int") if pairs else F.lit(None).cast("int"))
    read = rows.select(F.col(f"`{entity}`").alias("subject"), F.col(f"`{attribute}`").alias("__of"), F.col(f"`{value}`").alias("value")).join(wide, F.col("__of") == F.col("__attribute"))
    text = read.select("subject", "column_name", "column_type", "value", canonical(F.col("column_type"), F.col("value")).alias("text"), *([] if pairs is None else ["code"]))
    return text.withColumn("unfit", _unfit(F.col("column_type"), F.col("text")))


def cells(rows: DataFrame, columns: DataFrame, entity: str = "subject", attribute: str = "predicate", value: str = "literal_value") -> DataFrame:
    """(subject, code, low, high, n_values, n_read, unread, n_unfit, unfit, column_name, column_type) per cell that has a row.

    ``columns`` holds (``attribute``, column_name, column_type); several attributes may feed a
    column.  Values are read in the column's type into canonical texts, of which ``low`` and
    ``high`` (unfit, text) are the smallest and largest, those that do not fit the type behind all
    others: their texts differ if and only if the rows disagree, and ``low`` fits if any value does.
    ``n_values`` counts rows with a value, ``n_read`` those that could be read, ``unread`` is the
    smallest text that could not; ``n_unfit`` counts the rows that could be read but do not fit
    the type, ``unfit`` is the smallest text of them, as stored.  Null values make a cell without values; rows of attributes
    that feed no column, and null attributes, are left out; a null entity is an entity of its own.
    A null type is an empty one.  ``code`` numbers the pairs of name and type, by which the cells are
    shuffled; of more than ``MOST_COLUMNS`` pairs it is null.
    """
    pairs = _pairs(columns)
    many = len(pairs) > MOST_COLUMNS
    texts = _texts(rows, columns, entity, attribute, value, None if many else pairs)
    bad, over = F.when(F.col("text").isNull(), F.col("value")), F.when(F.col("unfit"), F.col("value"))
    rank = F.when(F.col("text").isNotNull(), F.struct("unfit", "text"))
    state = [F.min(rank).alias("low"), F.max(rank).alias("high"), F.count("value").alias("n_values"), F.count("text").alias("n_read"), F.min(bad).alias("unread"), F.count(over).alias("n_unfit"), F.min(over).alias("unfit")]
    if many:
        return texts.groupBy("subject", "column_name", "column_type").agg(*state).withColumn("code", F.lit(None).cast("int"))
    names = [F.get(F.array(*[F.lit(p[n]) for p in pairs]).cast("array<string>"), F.col("code")).alias(c) for n, c in enumerate(("column_name", "column_type"))]
    return texts.groupBy("subject", "code").agg(*state).select("*", *names)


def failures(rows: DataFrame, columns: DataFrame, entity: str = "subject", attribute: str = "predicate", value: str = "literal_value") -> DataFrame:
    """(subject, column_name, column_type, value, reason, n_rows) per distinct text of a cell that failed.

    ``value`` is the text as stored, ``n_rows`` the number of rows with it; ``reason`` is
    'unreadable' or, if it can be read but does not fit the type, 'unfit'.  Null values do not fail.
    """
    failed = _texts(rows, columns, entity, attribute, value).where("value is not null and (text is null or unfit)")
    return failed.groupBy("subject", "column_name", "column_type", "value", F.when(F.col("unfit"), "unfit").otherwise("unreadable").alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def maps(cell_rows: DataFrame, key: str = "code") -> DataFrame:
    """(subject, cells): the cells of an entity, ``key`` -> (low, differs, failed, n_values, n_failed).

    ``low`` is the smallest value that fits, ``failed`` the smallest text that does not or cannot be read.
    """
    cell = F.struct(
        F.when(~F.col("low.unfit"), F.col("low.text")).alias("low"),
        F.coalesce(F.col("low.text") != F.col("high.text"), F.lit(False)).alias("differs"),
        F.least("unread", "unfit").alias("failed"),
        F.col("n_values").alias("n_values"),
        (F.col("n_values") - F.col("n_read") + F.col("n_unfit")).alias("n_failed"),
    )
    return cell_rows.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct(key, cell))).alias("cells"))


def _typed(kind: str, text: Column) -> Column:
    if kind == "timestamp":
        whole, part = F.substring_index(text, ".", 1), F.regexp_extract(text, r"\.([0-9]{1,6})", 1)
        return F.when(~text.rlike(UNFIT[kind]), F.timestamp_micros(whole.cast("bigint") * 1_000_000 + F.coalesce(F.rpad(part, 6, "0").try_cast("bigint"), F.lit(0))))
    typed = text.try_cast(TYPES[kind])
    return F.when(~text.rlike(UNFIT[kind]), typed) if kind in UNFIT else typed


def widen(cell_rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(subject, <a typed column per column_name>, conflicts, failures, n_failed): one row per subject of ``cells``.

    A cell takes its smallest value (by canonical text) that fits its type; ``conflicts`` lists the columns whose
    rows disagree, ``failures`` maps a column to the smallest text of it that could not be read or
    does not fit the type, ``n_failed`` to the number of its rows with such a text.  Each key of
    them stands, with the subject, for the rows of ``failures()``, which has all the texts.
    Columns without a value are null.  Of several types for a column the smallest name makes the typed column;
    the values of another stand under ``name:type`` in the failures and conflicts.  A column named as one of the result's own gets a ``_`` behind.
    The column names are read by the driver, at most ``MOST_COLUMNS`` pairs of name and type; a table with more
    has, in place of the typed columns, one column ``values``, a map from every column's name (or ``name:type``) to its canonical text.
    """
    pairs = _pairs(columns)
    many = len(pairs) > MOST_COLUMNS
    if many:
        own = columns.where("column_name is not null").groupBy("column_name").agg(F.min(F.coalesce("column_type", F.lit(""))).alias("__own"))
        named = cell_rows.join(own, "column_name").withColumn("label", F.when(F.col("column_type") == F.col("__own"), F.col("column_name")).otherwise(F.concat_ws(":", "column_name", "column_type")))
        whole = maps(named.withColumn("label", F.struct((F.col("column_type") != F.col("__own")).alias("further"), F.col("label").alias("label"))), "label")
    else:
        whole = maps(cell_rows)
    labels = F.array(*[F.lit(x) for x in _labels(pairs)]).cast("array<string>")
    further = F.array(*[F.lit(n > 0 and pairs[n - 1][0] == name) for n, (name, _) in enumerate(pairs)]).cast("array<boolean>")

    def label(e) -> Column:
        return e["key"]["label"] if many else F.get(labels, e["key"])

    def is_further(e) -> Column:
        return e["key"]["further"] if many else F.get(further, e["key"])

    def failed(e) -> Column:
        return F.when(is_further(e), F.coalesce(e["value"]["low"], e["value"]["failed"])).otherwise(e["value"]["failed"])

    entries = F.map_entries("cells")
    bad = F.filter(entries, lambda e: failed(e).isNotNull())
    rest = [
        F.array_sort(F.transform(F.filter(entries, lambda e: e["value"]["differs"]), label)).alias("conflicts"),
        F.map_from_entries(F.transform(bad, lambda e: F.struct(label(e), failed(e)))).alias("failures"),
        F.map_from_entries(F.transform(bad, lambda e: F.struct(label(e), F.when(is_further(e), e["value"]["n_values"]).otherwise(e["value"]["n_failed"])))).alias("n_failed"),
    ]
    if many:
        read = F.filter(entries, lambda e: e["value"]["low"].isNotNull())
        return whole.select("subject", F.map_from_entries(F.transform(read, lambda e: F.struct(label(e), e["value"]["low"]))).alias("values"), *rest)
    taken, typed = {"subject", "conflicts", "failures", "n_failed"}, []
    own = [n for n, p in enumerate(pairs) if n == 0 or pairs[n - 1][0] != p[0]]
    # each value is looked up once, in a projection of its own, which the casts then read
    looked = whole.select("subject", *rest, *[F.col("cells")[F.lit(n)]["low"].alias(f"__{n}") for n in own])
    for n in own:
        name, kind = pairs[n]
        while name in taken:
            name += "_"
        taken.add(name)
        typed.append((_typed(kind, F.col(f"__{n}")) if kind in TYPES else F.lit(None).cast("string")).alias(name))
    return looked.select("subject", *typed, "conflicts", "failures", "n_failed")


def conflicts(wide_rows: DataFrame) -> DataFrame:
    """(subject, column_name) of the cells whose rows disagree, from the rows of ``widen``."""
    return wide_rows.select("subject", F.explode("conflicts").alias("column_name"))
