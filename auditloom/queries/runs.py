"""Queries of whole runs: records that arrive as files, processed once each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..scratch import Scratch
from ..sources import fixtures as fx
from ..streaming import runner
from .registry import query


class Lost(RuntimeError):
    """Stands for a driver that is lost between two batches."""


@query("run_resumed", "select event_id global_sample_index, user_id, event_type = 'error' failed, round(case when event_type = 'error' then 0 else value end, 6) confidence from events")
def resumed(spark, d):
    """Events as records in shards, some delivered twice; the run is lost in its second batch, and resumed from its checkpoint."""
    scratch = Scratch(spark, "run")
    e = fx.table(spark, d, "events").select(F.col("event_id").alias("global_sample_index"), "user_id", "event_type", "value")
    again = e.where("global_sample_index % 5 = 0")
    e.unionByName(again).repartition(6).write.json(f"{scratch.root}/source")
    calls = []

    def process(batch):
        calls.append(1)
        if len(calls) == 2:
            raise Lost
        bad = F.col("event_type") == "error"
        return batch.select("global_sample_index", "user_id", bad.alias("failed"), F.round(F.when(bad, 0.0).otherwise(F.col("value")), 6).alias("confidence"))

    def go():
        return runner.run(spark, f"{scratch.root}/source", "global_sample_index long, user_id long, event_type string, value double", f"{scratch.root}/sink", f"{scratch.root}/checkpoint", process, most_failed=1.0, files=2)

    try:
        go()
    except Exception as x:  # the first run is meant to be lost, and by nothing else
        if "Lost" not in str(x):
            raise
    go()
    return runner.processed(spark, f"{scratch.root}/sink")
