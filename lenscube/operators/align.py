"""Alignment: centroids, cosines of pairs and groups, the percentile scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def centroids(vectors: DataFrame, unit: str, vector: str) -> DataFrame:
    """(unit, dim, v): the mean vector of each unit, dimensions from 0."""
    each = vectors.select(F.col(unit).alias("unit"), F.posexplode(vector).alias("dim", "x"))
    return each.groupBy("unit", "dim").agg(F.avg(F.col("x").cast("double")).alias("v"))


def as_vectors(cells: DataFrame) -> DataFrame:
    """(unit, vec): the dimensions gathered in order."""
    got = F.array_sort(F.collect_list(F.struct("dim", "v")))
    return cells.groupBy("unit").agg(F.transform(got, lambda c: c["v"]).alias("vec"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))


def percent_scale(rows: DataFrame, *within: str) -> DataFrame:
    """Adds ``pct``: the share of cosines up to this one, ties taking the upper rank, rounded half to even.

    Without ``within`` one task ranks all rows: pairs of units, some tens of thousands.
    """
    w = Window.partitionBy(*within).orderBy("cos")
    return rows.withColumn("pct", F.bround(100 * F.cume_dist().over(w), 0).cast("long"))


def pairs(vectors: DataFrame, top: int = 5) -> DataFrame:
    """(unit, rank, target, pct, cos): the closest others; the scale is that of all unordered pairs.

    Units are countries or labels, a few hundred at most: their pairs are the answer, not an intermediate.
    """
    a, b = vectors.select(F.col("unit").alias("a"), F.col("vec").alias("va")), vectors.select(F.col("unit").alias("b"), F.col("vec").alias("vb"))
    each = percent_scale(a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(cosine(F.col("va"), F.col("vb")), 9).alias("cos")))
    both = each.select(F.col("a").alias("unit"), F.col("b").alias("target"), "pct", "cos").unionByName(each.select(F.col("b").alias("unit"), F.col("a").alias("target"), "pct", "cos"))
    w = Window.partitionBy("unit").orderBy(F.desc("cos"), "target")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def modes(vectors: DataFrame, unit: str, vector: str, on: Column, top: int = 5) -> DataFrame:
    """(mode, unit, rank, target, pct, cos): ``pairs`` of all vectors as "overall", of those ``on`` a lens as "lens".

    A unit without vectors on a lens has one row there, with nulls.
    """
    def of(rows: DataFrame, mode: str) -> DataFrame:
        return pairs(as_vectors(centroids(rows, unit, vector)), top).select(F.lit(mode).alias("mode"), "unit", "rank", "target", "pct", "cos")

    own = of(vectors.where(on), "lens")
    units = vectors.select(F.col(unit).alias("unit")).distinct().withColumn("mode", F.lit("lens"))
    return of(vectors, "overall").unionByName(units.join(own, ["mode", "unit"], "left"))


def to_groups(cells: DataFrame, members: DataFrame) -> DataFrame:
    """(unit, rank, sel, pct, cos) of each unit to each group without the unit itself, by leave-one-out sums.

    Groups are ranked by pct, the closest first, then by name.

    A group whose only member is the unit has no row. cells: unit, dim, v; members: sel, unit.
    """
    sums = cells.join(members, "unit").groupBy("sel", "dim").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    own = members.select("sel", "unit", F.lit(1).alias("own"))
    each = cells.join(sums, "dim").join(own, ["sel", "unit"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    rest = each.where(F.col("n") > F.col("own")).withColumn("g", (F.col("s") - F.col("own") * F.col("v")) / (F.col("n") - F.col("own")))
    dots = rest.groupBy("unit", "sel").agg(F.sum(F.col("v") * F.col("g")).alias("vg"), F.sum(F.col("v") * F.col("v")).alias("vv"), F.sum(F.col("g") * F.col("g")).alias("gg"))
    scaled = percent_scale(dots.select("unit", "sel", F.round(F.col("vg") / F.sqrt(F.col("vv") * F.col("gg")), 9).alias("cos")))
    return scaled.withColumn("rank", F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("pct"), "sel")))
