"""An extension: inference filters and aggregates over predictions that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.inference import InferenceFilter, filtered


def windowed(scored: DataFrame, time: str, filters: list[InferenceFilter], window: str = "10 minutes", late: str = "10 minutes", prediction: str = "prediction") -> DataFrame:
    """(start, end, n_rows, mean, fraction) per window of event time of the rows that pass; rows later than `late` are dropped."""
    rows = filtered(scored, filters)
    rows = rows.withWatermark(time, late) if scored.isStreaming else rows
    sums = rows.groupBy(F.window(time, window)).agg(F.count("*").alias("n_rows"), F.avg(prediction).alias("mean"), F.avg((F.col(prediction) >= 0.5).cast("double")).alias("fraction"))
    return sums.select("window.start", "window.end", "n_rows", "mean", "fraction")
