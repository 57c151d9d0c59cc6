"""The folder that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, local mode has a temporary folder; a cluster has no
    folder that all its machines see, which is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='folio-')}")
        folder = _own[0]
    return folder.rstrip("/")
