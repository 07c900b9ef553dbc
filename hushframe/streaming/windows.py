"""Tumbling-window counts of a stream, each cell released once, when the watermark has passed it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import release as R
from ..policy import Policy


def windowed_counts(events: DataFrame, time: str, by: list[str], policy: Policy, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, keys, count: suppressed under the minimum and rounded or noised. Works on batch and
    streaming frames; write a stream in append mode, so that no cell is released twice."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    known = source
    for k in by:
        known = known.where(F.col(k).isNotNull())
    cells = known.groupBy(F.window(time, size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    start = F.col("w.start")
    count = F.col("n").cast("double")
    if policy.suppression.count_noise:
        count = R.noisy(policy, "count", count, F.col("n"), start, *[F.col(k) for k in by])
    else:
        count = R.round_to(count, policy.round_to)
    return cells.select(start.alias("start"), *by, R.suppress(count, F.col("n"), policy.min_n).alias("count"))
