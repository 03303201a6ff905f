"""Excerpts: candidates, the round-robin pick, the best of each lens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candidates(excerpts: DataFrame, members: DataFrame, top: int | None = None) -> DataFrame:
    """(sel, slot, rank, ...) of each selection's excerpts: most probable, then most recent, then by ``ord``.

    With ``top`` the rank is limited within each selection, which Spark pushes below the shuffle.
    """
    w = Window.partitionBy("sel").orderBy(F.desc("p"), F.desc("period"), "ord")
    ranked = excerpts.join(members, "unit").withColumn("rank", F.row_number().over(w))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def pools(excerpts: DataFrame, members: DataFrame) -> DataFrame:
    """(slot, sel, key, rank): each selection's distinct keys with their place in ``candidates``' order.

    An aggregation with partial results; no selection's excerpts are gathered or sorted as a whole.
    """
    place = F.min(F.struct((-F.col("p")).alias("p"), (-F.col("period")).alias("period"), "ord"))
    return excerpts.join(members, "unit").groupBy("slot", "sel", "key").agg(place.alias("rank"))


def round_robin(pools: DataFrame, slots: int, picks: int = 3, rounds: int = 3) -> DataFrame:
    """(pick, sel, slot, key): the pools take turns, each its first key not yet taken.

    ``pools`` has sel, slot, rank (anything that sorts) and key. A pick can be blocked by ``picks`` - 1 others at
    most, so the first ``picks`` distinct keys of a pool are enough; Spark cuts to those before the shuffle, and
    the turns are played on those few rows as nested arrays.
    """
    once = pools.groupBy("slot", "sel", "key").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("slot").orderBy("rank")
    few = once.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= picks).select("slot", "sel", "rank", "key")
    gathered = few.agg(F.array_sort(F.collect_list(F.struct("slot", "rank", "key", "sel"))).alias("pools"))  # slots x picks rows
    turns = F.array(*[F.lit(s) for _ in range(rounds) for s in range(slots)])

    def play(out, slot):
        free = F.filter("pools", lambda c: (c["slot"] == slot) & ~F.exists(out, lambda o: o["key"] == c["key"]))
        return F.when(F.size(out) < picks, F.concat(out, F.slice(free, 1, 1))).otherwise(out)

    staged = gathered.select(F.aggregate(turns, F.slice("pools", 1, 0), play).alias("out"))
    return staged.select(F.posexplode("out").alias("pick", "o")).select((F.col("pick") + 1).alias("pick"), "o.sel", "o.slot", "o.key")


def best_per_lens(excerpts: DataFrame, means: DataFrame, top: int = 3) -> DataFrame:
    """The most probable excerpt of each (unit, lens), the unit's most present lenses first."""
    w = Window.partitionBy("unit", "lens").orderBy(F.desc("p"), F.desc("period"), "ord")
    first = excerpts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    joined = first.join(means.select("unit", "lens", "v"), ["unit", "lens"], "left")
    order = Window.partitionBy("unit").orderBy(F.desc(F.round(F.coalesce("v", F.lit(0.0)), 9)), "lens")
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def chosen_first(rows: DataFrame, lens: int) -> DataFrame:
    """(unit, idx, pos, lens): a card's lenses, the chosen one first, the others in their order."""
    w = Window.partitionBy("unit", "idx").orderBy(F.desc(F.col("lens") == lens), "pos")
    return rows.withColumn("rank", F.row_number().over(w))

