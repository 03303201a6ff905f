"""The share cube over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_cells(events: DataFrame, lenses: int, late: str = "1 day") -> DataFrame:
    """(unit, day, n, on array) by event-time days; a day is final once the watermark passes it."""
    on = F.array(*[F.sum((F.col("mask").bitwiseAND(F.lit(1 << k)) != 0).cast("long")) for k in range(lenses)], F.sum((F.col("mask") != 0).cast("long")))
    cells = events.withWatermark("ts", late).groupBy("unit", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), on.alias("held"))
    return cells.select("unit", F.col("w.start").alias("day"), "n", "held")


def shares_of(cells: DataFrame) -> DataFrame:
    return cells.select("unit", F.dayofmonth("day").alias("period"), F.posexplode(F.transform("held", lambda h: h / F.col("n"))).alias("lens", "share"))
