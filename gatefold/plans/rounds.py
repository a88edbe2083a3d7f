"""Iterative plans: a round's result is written to the shared checkpoint folder, so that plans don't grow round by round."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder of ``spark.checkpoint.dir``; in one of its own only on a local master without that."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gatefold-rounds-"))
    return df.checkpoint()
