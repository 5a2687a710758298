"""The boundary to models: a loader runs once in each worker, and its function sees Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

_loaded: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}


def infer(df: DataFrame, name: str, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """df through the model that load() gives. The name keys the worker's copy, so tasks share it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _loaded:
            _loaded[name] = load()
        for batch in batches:
            yield _loaded[name](batch)

    return df.mapInPandas(run, schema)
