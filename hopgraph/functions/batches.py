"""User functions over batches with shared read-only arguments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def map_batches(df: DataFrame, fn: Callable[..., pd.DataFrame], schema: str, **shared) -> DataFrame:
    """``fn(batch, **shared)`` on every Arrow batch; the results form one table.

    Shared arguments are broadcast once per executor and are meant to be small.
    """
    held = df.sparkSession.sparkContext.broadcast(shared)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield fn(f, **held.value)

    return df.mapInPandas(run, schema)
