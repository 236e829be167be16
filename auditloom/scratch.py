"""Tables in the shared folder that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Tables that cut lineage, written below the cluster's shared ``spark.checkpoint.dir``.

    Where that setting is absent, a local master (tests) takes a temporary folder of this process, which all its tasks
    see; any other master is refused, as its executors would not. What is left of a run's tables is deleted when the
    driver's process ends; tables that are spent earlier are dropped by ``drop``.
    """

    _local: str | None = None

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
            Scratch._local = Scratch._local or tempfile.mkdtemp(prefix="auditloom-")
            root = f"file://{Scratch._local}"
        self.root = f"{root.rstrip('/')}/auditloom/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._delete, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001  remembered for drop()
        return out

    def release(self) -> None:
        """Lets Spark delete the shuffle files and broadcasts of plans that have ended; it does so when the driver collects its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        with contextlib.suppress(Exception):  # the session may have ended
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
