"""Ordered computations: last values, declutter, running totals without a single partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_non_null(series: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value): the last value that isn't null, 0 where there is none."""
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    return series.groupBy(key).agg(F.coalesce(last, F.lit(0.0)).alias(value))


def declutter(rows: DataFrame, y: str, gap: float, bottom: float, tie: str, within: list[str] | None = None) -> DataFrame:
    """Adds ``placed``: in order of y each at least ``gap`` below the one before; all shift up by the overflow.

    y_k = max(y_k, y_(k-1) + gap) is max(y_j - gap * j) over j <= k, plus gap * k. ``within`` splits the rows
    into plots; one plot has as many rows as series.
    """
    keys = within or []
    w = Window.partitionBy(*keys).orderBy(y, tie)
    ranked = rows.withColumn("_k", F.row_number().over(w))
    pushed = ranked.withColumn("_p", F.max(F.col(y) - gap * F.col("_k")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + gap * F.col("_k"))
    over = F.greatest(F.max("_p").over(Window.partitionBy(*keys)) - bottom, F.lit(0.0))
    return pushed.withColumn("placed", F.col("_p") - over).drop("_k", "_p")


def _part(value: Column, bounds: list) -> Column:
    """The range of a value: how many of the ascending bounds lie before it."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < value))


def _every(bounds: list, n: int, per_range: int) -> list:
    """As many of the bounds as make ranges of about ``per_range`` rows."""
    ranges = min(len(bounds) + 1, -(-n // per_range))
    return [bounds[len(bounds) * k // ranges] for k in range(1, ranges)] if ranges > 1 else []


def running_totals(rows: DataFrame, order: str, values: list[str], per_range: int = 250_000, most: int = 1000) -> DataFrame:
    """Adds sum_<value> over all rows up to this one by ``order``, whose values must be distinct, and total_<value>.

    Two levels: ranges of ``order`` by approximate quantiles, as many as the rows need (``most`` at most), each
    sum by themselves; the ranges' totals, a few rows, are summed and added. No partition holds all rows.
    """
    at = [k / most for k in range(1, most)]
    n, bounds = rows.agg(F.count("*"), F.percentile_approx(order, at, 10 * most)).first()  # one row
    bounds = _every(sorted(set(bounds or [])), n, per_range)
    parted = rows.withColumn("_part", _part(F.col(order), bounds))
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    within = parted.select("*", *[F.sum(v).over(w).alias(f"_{v}") for v in values])
    totals = parted.groupBy("_part").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before, whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # one row a range
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values], *[F.sum(f"_t_{v}").over(whole).alias(f"total_{v}") for v in values])
    joined = within.join(F.broadcast(offsets), "_part")  # at most ``most`` rows
    return joined.select(*rows.columns, *[(F.col(f"_{v}") + F.col(f"_o_{v}")).alias(f"sum_{v}") for v in values], *[f"total_{v}" for v in values])


def rank_of(rows: DataFrame, by: str, collation: str | None = None, per_range: int = 250_000, sample: int = 4000) -> DataFrame:
    """Adds ``rank`` by a column of distinct names, in a language's order with ``collation``.

    Names are ranked in ranges, and a range's offset is the size of those before it. Bounds come from a sample of
    names with the least hashes, which decides nothing but the ranges' sizes.
    """
    key = F.collate(by, collation) if collation else F.col(by)
    n = rows.count()
    bounds = []
    if n > per_range:
        few = rows.select(by).orderBy(F.xxhash64(F.collate(by, "UTF8_BINARY")), by).limit(sample)
        bounds = _every([r[0] for r in few.orderBy(key, by).collect() if r[0] is not None], n, per_range)  # ``sample`` names
    parted = rows.withColumn("_part", F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: (F.collate(b, collation) if collation else b) < key)) if bounds else F.lit(0))
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    own = parted.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(key, by)))
    return own.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_k") + F.col("_o")).drop("_part", "_k", "_o")
