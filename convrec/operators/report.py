"""filter report (rows before / after each step, deleted count and ratio).

Counts are taken with ``DataFrame.observe`` on the pipeline's own DataFrames,
so they are collected by the job that computes the result; only one number per
step reaches the driver.  Where the optimizer removed a counter (a step that keeps
nothing), the step's rows are counted instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _observed(obs: Observation, df: DataFrame) -> int:
    try:
        rows = obs.get.get("rows")
    except Exception:  # noqa: BLE001 - the JVM asserts when the counter is no longer in the plan
        rows = None
    return df.count() if rows is None else int(rows)


class FilterReport:
    def __init__(self) -> None:
        self._obs: list[tuple[str, str, Observation, DataFrame]] = []

    def track(self, df: DataFrame, stage: str, side: str) -> DataFrame:
        """Attach a row counter to ``df``; ``side`` is ``in`` or ``out``."""
        obs = Observation(f"{stage}:{side}:{len(self._obs)}")
        self._obs.append((stage, side, obs, df))
        return df.observe(obs, F.count(F.lit(1)).alias("rows"))

    def step(self, before: DataFrame, after_fn, stage: str) -> DataFrame:
        """Apply ``after_fn`` to ``before`` and count both sides."""
        b = self.track(before, stage, "in")
        return self.track(after_fn(b), stage, "out")

    def frame(self, spark: SparkSession) -> DataFrame:
        """``stage, rows_in, rows_out, deleted, deleted_ratio`` (ratio 0 when nothing came in)."""
        counts: dict[str, dict[str, int]] = {}
        order: list[str] = []
        for stage, side, obs, df in self._obs:
            if stage not in counts:
                counts[stage] = {}
                order.append(stage)
            counts[stage][side] = _observed(obs, df)
        rows = []
        for s in order:
            i, o = counts[s].get("in", 0), counts[s].get("out", 0)
            rows.append((s, i, o, i - o, (i - o) / i if i else 0.0))
        return spark.createDataFrame(rows, "stage string, rows_in bigint, rows_out bigint, deleted bigint, deleted_ratio double")
