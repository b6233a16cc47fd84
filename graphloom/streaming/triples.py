"""Extension: triples from files as they land. Parsing and dispatch hold no state, so the batch functions serve as they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import vocab
from ..sources import ntriples


def landing(spark: SparkSession, folder: str, hosts: Sequence[str] = vocab.HOSTS) -> DataFrame:
    """Streaming dispatched triples of the *.nt files that arrive in a folder."""
    lines = spark.readStream.option("pathGlobFilter", "*.nt").text(folder).select(F.make_valid_utf8("value").alias("value"))
    return ntriples.dispatched(ntriples.parse(lines), hosts)


def append(triples: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all files that are there now to a Parquet table by role and key, each once, then stops."""
    writer = triples.writeStream.format("parquet").partitionBy("role", "key").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).outputMode("append").start(path)
