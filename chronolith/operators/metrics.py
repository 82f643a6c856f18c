"""Figures of a query's run, gathered while it runs."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class RunMetrics:
    """Rows and wall time of one run of ``df``; ``get`` waits for the run to end."""

    df: DataFrame
    _seen: Observation = field(repr=False)
    _start: float = field(default_factory=time.perf_counter, repr=False)

    def get(self) -> dict[str, float]:
        found = dict(self._seen.get)
        return {"rows": found["rows"], "seconds": time.perf_counter() - self._start}


def observed(df: DataFrame, name: str = "chronolith") -> RunMetrics:
    """Count the rows of a result as it is written or collected, without a pass of its own."""
    seen = Observation(name)
    return RunMetrics(df.observe(seen, F.count(F.lit(1)).alias("rows")), seen)
