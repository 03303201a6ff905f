"""The share cube and its equal-weight averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lenscube.functions.scalars import TINY, missing_is_null


def share_cube(points: DataFrame, lenses: int, mask: str = "mask") -> DataFrame:
    """(unit, period, lens, share): of each cell's points, those on each lens and, as ``lenses``, on any.

    One aggregation with partial sums; a point on several lenses counts for each, so ALL is no sum.
    """
    bits = [F.avg((F.col(mask).bitwiseAND(F.lit(1 << k)) != 0).cast("double")) for k in range(lenses)]
    any_of = F.avg((F.col(mask) != 0).cast("double"))
    cells = points.groupBy("unit", "period").agg(F.array(*bits, any_of).alias("v"))
    return cells.select("unit", "period", F.posexplode("v").alias("lens", "share"))


def share_from_probability(points: DataFrame, p: str = "p") -> DataFrame:
    """(unit, period, lens, share) as the mean probability of a cell's points."""
    return points.groupBy("unit", "period", "lens").agg(F.avg(p).alias("share"))


def unit_mean(share: DataFrame, period: Column | None = None) -> DataFrame:
    """(unit, lens, v): the mean over the periods in which the unit has a share; others have no row."""
    kept = share if period is None else share.where(period)
    return kept.where("share is not null and not isnan(share)").groupBy("unit", "lens").agg(F.avg("share").alias("v"))


def group_mean(means: DataFrame, members: DataFrame) -> DataFrame:
    """(sel, slot, lens, v): the mean of unit means, every unit weighing the same."""
    return means.join(members, "unit").groupBy("sel", "slot", "lens").agg(F.avg("v").alias("v"))


def world_mean(means: DataFrame) -> DataFrame:
    return means.groupBy("lens").agg(F.avg("v").alias("world"))


def ratio_to_world(groups: DataFrame, world: DataFrame) -> DataFrame:
    """Adds world and ratio; no ratio for a share under TINY or a world without share."""
    ratio = F.when((F.col("v") >= TINY) & (F.col("world") > 0), F.col("v") / F.col("world"))
    return groups.join(world, "lens", "left").withColumn("ratio", ratio)


def trend(share: DataFrame, members: DataFrame, periods: DataFrame, lens: int, world: str = "world") -> DataFrame:
    """(series, period, v) over every period: the members' equal-weight mean, null where none has a share."""
    own = share.where(F.col("lens") == lens).withColumn("share", missing_is_null(F.col("share"))).where("share is not null")
    series = own.join(members, "unit").select("sel", "period", "share").unionByName(own.select(F.lit(world).alias("sel"), "period", "share"))
    names = members.select("sel").distinct().unionByName(members.sparkSession.createDataFrame([(world,)], "sel string"))
    grid = names.join(F.broadcast(periods))  # a row for each series and period: both lists are short
    found = series.groupBy("sel", "period").agg(F.avg("share").alias("v"))
    return grid.join(found, ["sel", "period"], "left").select(F.col("sel").alias("series"), "period", "v")


def composition(parts: DataFrame, spoken: DataFrame) -> DataFrame:
    """(unit, topic, share, seen): the sum of a topic's parts over the periods spoken; a topic not named counts 0.

    parts: unit, period, ord (place in the speech), topic, share. ``seen`` is a topic's first (period, ord).
    """
    n = spoken.groupBy("unit").agg(F.count_distinct("period").alias("periods"))
    sums = parts.groupBy("unit", "topic").agg(F.sum("share").alias("s"), F.min(F.struct("period", "ord")).alias("seen"))
    return sums.join(n, "unit").select("unit", "topic", (F.col("s") / F.col("periods")).alias("share"), "seen")


def top_and_others(shares: DataFrame, top: int, lenses: int) -> DataFrame:
    """(unit, ord, topic, share, shade): the largest shares, then what is left as topic -1 if it is worth it.

    Equal shares stand in the order in which their topics were first seen (``composition``).
    Shades alternate within the family of lenses (topic < ``lenses``) and within that of other topics.
    """
    ranked = shares.withColumn("ord", F.expr("row_number() over (partition by unit order by round(share, 9) desc, seen)")).where(F.col("ord") <= top)
    shade = F.expr(f"(row_number() over (partition by unit, topic < {lenses} order by ord) - 1) % 2")
    segments = ranked.withColumn("shade", shade)
    rest = ranked.groupBy("unit").agg((1 - F.sum("share")).alias("share")).where(F.col("share") > TINY)
    others = rest.select("unit", F.lit(top + 1).alias("ord"), F.lit(-1).alias("topic"), "share", F.lit(None).cast("int").alias("shade"))
    return segments.select("unit", "ord", F.col("topic").cast("int").alias("topic"), "share", "shade").unionByName(others)
