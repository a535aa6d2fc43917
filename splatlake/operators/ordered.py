"""Work that depends on what was chosen before, over rows of one key in order.

Rows are hash-partitioned by key and sorted inside the partition; each task streams its rows in
Arrow batches and holds only a small state for the current key, never the whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame


def stream_groups(df: DataFrame, keys: list[str], order: list[Column], start: Callable, step: Callable,
                  out: list[str], schema: str) -> DataFrame:
    """Appends the columns ``out``: ``step(state, row)`` returns their values and updates the state."""
    cols = df.columns  # key names must not start with an underscore: rows come as named tuples

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            made = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    current, state = key, start()
                made.append(step(state, row))
            extra = pd.DataFrame(made, columns=out, index=pdf.index)
            yield pd.concat([pdf, extra], axis=1)[[*cols, *out]]

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    spread = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return spread.mapInPandas(run, f"{types}, {schema}")
