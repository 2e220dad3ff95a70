"""Where streams keep their checkpoints: below the folder that the cluster names, a temporary one only in local tests."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-stream-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"
