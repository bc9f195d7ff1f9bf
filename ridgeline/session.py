"""Session settings that operators need."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder in spark.checkpoint.dir; only where none is set and all runs in this process (tests), to a local one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and not re.match(r"local($|\[)", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ridgeline-"))
