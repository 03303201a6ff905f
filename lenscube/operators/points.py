"""Points on the map: classes, slots, speeches, and the nearest point in a radius."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lenscube.functions.scalars import on_lens

_CELL = ("kind", "own", "level", "cx", "cy")


def smallest_selection(members: DataFrame) -> DataFrame:
    """(unit, slot): the smallest selection that holds the unit, the earliest slot at a tie."""
    size = members.groupBy("slot").agg(F.count("*").alias("n"))
    return members.join(size, "slot").groupBy("unit").agg(F.min(F.struct("n", "slot")).alias("s")).select("unit", "s.slot")


def layer_of_regions(in_period: Column, slot: Column, mask: Column, lens: int | None) -> Column:
    """-1 out of the period, 0 in no selection, 1 off the lens, else 4 - slot."""
    return F.when(~in_period, -1).when(slot.isNull(), 0).when(on_lens(mask, lens), 4 - slot).otherwise(1).cast("long")


def layer_of_unit(in_period: Column, own: Column, mask: Column) -> Column:
    """-1 out of the period, 0 another unit's, 1 own, 2 own and on any lens."""
    return F.when(~in_period, -1).when(~own, 0).when(on_lens(mask, None), 2).otherwise(1).cast("long")


def speeches(fragments: DataFrame) -> DataFrame:
    """(unit, period, mask, x, y): a speech is on a lens if any fragment is; it lies at their mean."""
    return fragments.groupBy("unit", "period").agg(F.bit_or("mask").alias("mask"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def local_index(points: DataFrame) -> DataFrame:
    """Adds a point's number within its unit, from 0, by its number among all."""
    return points.withColumn("local", F.expr("row_number() over (partition by unit order by idx) - 1"))


def unit_starts(points: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, start): the least point number; 0 for a unit without points."""
    found = points.groupBy("unit").agg(F.min("idx").alias("start"))
    return units.join(found, "unit", "left").select("unit", F.coalesce("start", F.lit(0)).alias("start"))


def best_fragment(speech: DataFrame, fragments: DataFrame) -> DataFrame:
    """Speeches (unit, ..., k) with their k-th fragment (unit, local, ...); none where k is negative or absent."""
    return speech.where("k >= 0").join(fragments, (speech["unit"] == fragments["unit"]) & (speech["k"] == fragments["local"])).drop(fragments["unit"])


def _levels(points: DataFrame, width: float, fill: int = 64, sample: int = 16_384, most: int = 10) -> int:
    """How often cells of this width are cut in four by four for the fullest to have about ``fill`` places.

    Judged by the points with the least hashes, which decides nothing but the work: every level gives the same result.
    """
    n = points.count()
    few = points.orderBy(F.xxhash64("idx", "x", "y"), "idx").limit(sample).select("x", "y").collect()  # ``sample`` points
    places, each = {(r.x / width, r.y / width) for r in few}, max(1.0, n / max(1, len(few)))
    for k in range(most + 1):
        fullest = max(Counter((math.floor(x * 4**k), math.floor(y * 4**k)) for x, y in places).values(), default=0)
        if fullest <= max(8, fill / each):
            return min(most, k + math.ceil(math.log(max(1.0, fullest * each / fill), 4)))
    return most


def nearest_in_radius(probes: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(probe, idx, tier, d2): the nearest point closer than ``radius``; a lower tier wins over a nearer point.

    Ties go to the lower idx. probes: probe, px, py, label; points: idx, x, y, label, with coordinates of the unit
    square's size. Tier 0 has the probe's label.

    Exact, with few pairs: cells as wide as the radius are cut in four by four, level by level. Each cell's extent bounds
    a probe's least distance from above (``bound``), over the nine cells about it at every level; only the points of the
    finest nine cells that reach as far are then compared. The points of one label are searched first-hand, and all
    points where no own one is certain: without an own point in the radius any point is of tier 1. Of points at one place
    the two lowest idx can win (one may be the probe).
    """
    real = lambda c: F.abs(c) < F.lit(math.inf)  # noqa: E731  no null, NaN or infinity
    spare = 1 + 1e-6  # more than what rounding can move a point to another cell
    width = radius * spare
    points = points.where(real("x") & real("y"))
    levels = _levels(points, width)

    def cell(v: str, k: int, off: int = 0) -> Column:
        return F.floor(F.col(v) / width * 4**k) + off

    def lowest(rows: DataFrame, *place: str) -> DataFrame:
        return rows.withColumn("_k", F.dense_rank().over(Window.partitionBy(*place).orderBy("idx"))).where("_k <= 2").drop("_k")

    def kinds(rows: DataFrame, anyone: DataFrame) -> DataFrame:
        own = rows.withColumn("kind", F.lit(0)).withColumn("own", F.col("label"))
        return own.unionByName(anyone.withColumn("kind", F.lit(1)).withColumn("own", F.lit(None).cast(rows.schema["label"].dataType)))

    def in_cells(rows: DataFrame, x: str, y: str, offs: tuple[int, ...]) -> DataFrame:
        at = [F.struct(F.lit(k).alias("level"), cell(x, k, a).alias("cx"), cell(y, k, b).alias("cy")) for k in range(levels + 1) for a in offs for b in offs]
        return rows.withColumn("_c", F.explode(F.array(*at))).select(*rows.columns, "_c.*")

    places = lowest(points.select("idx", "x", "y", "label"), "x", "y", "label")
    there = in_cells(kinds(places, lowest(places, "x", "y")).drop("label"), "x", "y", (0,))
    asked = probes.where(real("px") & real("py")).select("probe", "px", "py", "label")
    asked = in_cells(kinds(asked.where(F.col("label").isNotNull()), asked), "px", "py", (-1, 0, 1))

    extent = there.groupBy(*_CELL).agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y", "idx") for n, f in (("lo", F.min), ("hi", F.max))])
    met = _same_cell(asked, extent).where((F.col("lo_idx") != F.col("probe")) | (F.col("hi_idx") != F.col("probe")))
    sides = [(F.col(p) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(p)) for p, c in (("px", "x"), ("py", "y"))]
    far, near = ([f(*s, *more) for s in sides] for f, more in ((F.greatest, ()), (lambda a, b, z: F.greatest(-a, -b, z), (F.lit(0.0),))))
    met = met.select("probe", "px", "py", "label", *_CELL, (far[0] * far[0] + far[1] * far[1]).alias("far2"), (near[0] * near[0] + near[1] * near[1]).alias("near2"))
    of = Window.partitionBy("probe", "px", "py", "label")  # at most 18 cells a level
    met = met.withColumn("own2", F.min(F.when(F.col("kind") == 0, F.col("far2"))).over(of)).withColumn("bound", F.min("far2").over(of.partitionBy("probe", "px", "py", "label", "kind")))
    met = met.where((F.col("kind") == 0) | F.col("own2").isNull() | (F.col("own2") >= radius * radius))
    reach = F.sqrt(F.least("bound", F.lit(radius * radius))) * spare
    finest = sum((F.when(reach <= width / 4**k, 1).otherwise(0) for k in range(1, levels + 1)), F.lit(0))
    chosen = met.where((F.col("level") == finest) & (F.col("near2") <= F.col("bound")) & (F.col("near2") < radius * radius)).select("probe", "px", "py", F.col("label").alias("plabel"), *_CELL, "bound")

    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    pairs = _same_cell(there, chosen).where(F.col("idx") != F.col("probe")).withColumn("d2", dx * dx + dy * dy).where((F.col("d2") < radius * radius) & (F.col("d2") <= F.col("bound")))
    best = F.min(F.struct(F.col("kind").alias("tier"), "d2", "idx")).alias("b")
    return pairs.groupBy("probe").agg(best).select("probe", "b.idx", F.col("b.tier").cast("long").alias("tier"), "b.d2")


def _same_cell(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on the cell and what is searched in it (``own`` can be null), with the left side's columns of these.

    Rows are many times what Spark estimates before they are put in cells, so neither side is broadcast by estimate.
    """
    named = right.withColumnsRenamed({k: f"_{k}" for k in _CELL})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) if k == "own" else F.col(k) == F.col(f"_{k}") for k in _CELL]
    return left.join(named.hint("merge"), on).drop(*[f"_{k}" for k in _CELL])


def label_order(labels: DataFrame) -> DataFrame:
    """Adds the placing order: lenses first, then by count."""
    return labels.withColumn("rank", F.expr("row_number() over (order by is_lens desc, n desc, topic)"))  # one row a topic


def outline(members: DataFrame) -> DataFrame:
    """(slot, unit, n, layer): each selection's units with its size and turn, larger selections first, then earlier slots.

    The turn is ranked over the selections, a few rows.
    """
    size = members.groupBy("slot").agg(F.count("*").alias("n"))
    turn = size.withColumn("layer", F.expr("row_number() over (order by n desc, slot)"))
    return members.select("slot", "unit").join(turn, "slot")


def label_anchors(points: DataFrame, cells: int = 20, alternates: int = 4) -> DataFrame:
    """(topic, place, x, y, n): the centres of each topic's fullest grid cells, with the topic's count.

    Place 0 is the anchor, others are alternates in their order. (Cells and number of alternates are our choice.)
    """
    grid = points.select("topic", F.least(F.floor(F.col("x") * cells), F.lit(cells - 1)).alias("cx"), F.least(F.floor(F.col("y") * cells), F.lit(cells - 1)).alias("cy"))
    counts = grid.groupBy("topic", "cx", "cy").agg(F.count("*").alias("k"))
    total = counts.groupBy("topic").agg(F.sum("k").alias("n"))
    ranked = counts.withColumn("place", F.expr("row_number() over (partition by topic order by k desc, cx, cy) - 1")).where(F.col("place") <= alternates)
    return ranked.join(total, "topic").select("topic", "place", ((F.col("cx") + 0.5) / cells).alias("x"), ((F.col("cy") + 0.5) / cells).alias("y"), "n")
