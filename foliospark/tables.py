"""Tables between steps: written to the shared folder, read back, and dropped when they are no longer needed."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from foliospark.shared import shared_dir

_written: list[tuple[SparkSession, str]] = []


class Table:
    """Rows in a folder that all machines see: they survive lost executors, and their lineage is cut.

    ``metrics`` are aggregates that are taken while the rows are written. Folders that nobody drops go when the interpreter ends.
    """

    def __init__(self, df: DataFrame, metrics: dict[str, Column] | None = None, by: list[str] | None = None):
        spark = df.sparkSession
        self.spark, self.path = spark, f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
        seen = None
        if metrics:
            seen = Observation(uuid.uuid4().hex)
            df = df.observe(seen, *[c.alias(k) for k, c in metrics.items()])
        writer = df.write.partitionBy(*by) if by else df.write
        _written.append((spark, self.path))
        writer.parquet(self.path)
        self.metrics = seen.get if seen else {}
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; no plan may read the table afterwards."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        if (self.spark, self.path) in _written:
            _written.remove((self.spark, self.path))


@atexit.register
def _clean() -> None:
    for spark, path in list(_written):
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the cluster's own cleaner of the shared folder is left
            return
