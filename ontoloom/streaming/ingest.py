"""Documents that arrive in a folder, parsed and inserted batch by batch."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ontoloom.sources.statements import from_lines, parse_batches
from ontoloom.store import TripleStore


def stream_documents(store: TripleStore, folder: str, form: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Follow a folder of N-Triples ('ntriples'), Turtle ('turtle') or RDF/XML ('rdfxml') files into a store.

    An insert has set semantics, so a batch that is repeated after a failure changes nothing.
    Prefixes of the documents are registered.  ``available_now``: end with what is there.
    """
    by_line = form == "ntriples"
    texts = store.spark.readStream.text(folder, wholetext=not by_line).select(F.hex(F.xxhash64(F.col("_metadata.file_path"))).alias("scope"), "value")

    def insert(batch: DataFrame, number: int) -> None:
        store.insert_statements(from_lines(batch.withColumn("scope", F.concat(F.lit("f"), "scope", F.lit("_")))) if by_line else parse_batches(batch, form))

    writer = texts.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
