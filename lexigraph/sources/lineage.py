"""Tables cut from the plan that made them, by reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .scratch import shared_dir


def cut(df: DataFrame, name: str | None = None) -> DataFrame:
    """The same rows, read from the folder that driver and executors share; ``name`` is for writers that keep tables by name."""
    if not df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
