"""The append-and-resume runner on Structured Streaming.

New records are read as a stream of files. The keys that were seen are state of the query, so a record comes through once, whatever is
delivered again, and no batch reads the sink. Each micro-batch is scored and written to a folder of its own number, which a batch that is run again after a
loss replaces: with the checkpoint every record is in the sink once. Runs stop early when too many records fail.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TooManyFailures(RuntimeError):
    """The share of failed records passed the limit."""


def unprocessed(batch: DataFrame, sink: str, key: str) -> DataFrame:
    """Records whose key isn't in the sink yet, each key once."""
    spark = batch.sparkSession
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(sink)
    batch = batch.dropDuplicates([key])
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return batch
    return batch.join(spark.read.parquet(sink).select(key), key, "left_anti")


def run(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], key: str = "global_sample_index", most_failed: float = 0.5, least_records: int = 10, files: int | None = None):
    """Processes what is new in ``source`` (JSON lines) and returns the finished query. ``process`` adds a boolean ``failed``; ``files``: files a batch at most.

    Failures count over the whole run since the query was started: it stops when, of ``least_records`` or more, a greater share than ``most_failed`` has failed. What was
    processed stays in the sink (``processed``), and a later run with the same checkpoint goes on behind it.
    """
    seen = {"n": 0, "bad": 0}

    def each(batch: DataFrame, number: int) -> None:
        out = process(batch).persist()
        n, bad = out.agg(F.count("*"), F.count_if("failed")).first()
        out.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        out.unpersist()
        seen["n"] += n
        seen["bad"] += bad
        if seen["n"] >= least_records and seen["bad"] > most_failed * seen["n"]:
            raise TooManyFailures(f"{seen['bad']} of {seen['n']} records failed")

    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    q = reader.json(source).dropDuplicates([key]).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def processed(spark: SparkSession, sink: str) -> DataFrame:
    """The records of a sink."""
    return spark.read.parquet(sink).drop("batch")
