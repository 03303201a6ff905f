"""Joins on dimensions: names by interval, keys with a fallback, what nothing matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def name_at(rows: DataFrame, history: DataFrame, unit: str = "unit", period: str = "period", modern: str = "name") -> DataFrame:
    """Adds ``label``: the first interval (by ord) of the unit that holds the period, else its modern name.

    history: unit, ord, first, last, old. The join is on the unit, so its size follows the intervals of one
    unit, and the distinct (unit, period) pairs are joined, not the rows.
    """
    asked = rows.select(unit, period).distinct()
    h = history.select(F.col("unit").alias(unit), "ord", "first", "last", "old")
    found = asked.join(h, unit).where(F.col(period).between(F.col("first"), F.col("last")))
    first = found.groupBy(unit, period).agg(F.min_by("old", "ord").alias("old"))
    return rows.join(first, [unit, period], "left").withColumn("label", F.coalesce("old", modern)).drop("old")


def by_id_or_name(features: DataFrame, dim: DataFrame) -> DataFrame:
    """features (id, name) with ``unit`` from dim (unit, map_id, names): by id, else by one of its names."""
    ids = dim.where("map_id is not null").select(F.col("map_id").alias("id"), F.col("unit").alias("by_id"))
    names = dim.select(F.explode("names").alias("name"), F.col("unit").alias("by_name"))
    return features.join(ids, "id", "left").join(names, "name", "left").withColumn("unit", F.coalesce("by_id", "by_name")).drop("by_id", "by_name")


def undrawn(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of ``left`` that nothing in ``right`` matches."""
    return left.join(right, on, "left_anti")


def known_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows whose slug is a group's, with the group's columns; unknown slugs are dropped."""
    return rows.join(groups, "slug")


def with_default(rows: DataFrame, other: DataFrame, on: list[str], defaults: dict) -> DataFrame:
    """A left join whose missing columns take defaults."""
    joined = rows.join(other, on, "left")
    return joined.select(*[F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else c for c in joined.columns])
