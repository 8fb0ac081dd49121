"""Sub-steps: equal parts of a step, or data-dependent ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed(steps: DataFrame, count: int, seconds: str) -> DataFrame:
    """``steps`` with sub_step, dt and midpoint (of the step, 0 to 1)."""
    if count < 1:
        raise ValueError("a step needs a sub-step")
    out = steps.withColumn("sub_step", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return out.withColumns({"dt": F.col(seconds) / count, "midpoint": (F.col("sub_step") + 0.5) / count})


def adaptive(steps: DataFrame, seconds: str, candidate: Callable[[pd.DataFrame, np.ndarray], np.ndarray], longest: float, most: int = 10_000) -> DataFrame:
    """``steps`` with sub_step and dt: at each time the least of the candidate, ``longest`` and what remains of the step.

    candidate(rows, elapsed) gives a positive length for each row; all rows of an Arrow batch advance together.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            rows, elapsed, k = rows.reset_index(drop=True), np.zeros(len(rows)), 0
            while len(rows):
                dt = np.asarray(candidate(rows, elapsed), float)
                if not (dt > 0).all():
                    raise ValueError("a sub-step needs a positive length")
                dt = np.minimum(np.minimum(dt, longest), rows[seconds].to_numpy() - elapsed)
                yield rows.assign(sub_step=k, dt=dt)
                elapsed, k = elapsed + dt, k + 1
                left = rows[seconds].to_numpy() - elapsed > 1e-9
                if left.any() and k >= most:
                    raise ValueError(f"more than {most} sub-steps")
                rows, elapsed = rows[left].reset_index(drop=True), elapsed[left]

    schema = steps.selectExpr("*", "CAST(0 AS int) AS sub_step", "0.0D AS dt").schema
    return steps.mapInPandas(run, schema)
