"""Evaluation of topic classifiers: precision, recall, F1, thresholds, the bar, calibration, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lenscube.operators.windows import running_totals


def _rates(tp: Column, predicted: Column, true: Column) -> list[Column]:
    p = F.when(predicted > 0, tp / predicted)
    r = F.when(true > 0, tp / true)
    return [p.alias("precision"), r.alias("recall"), F.when(predicted + true > 0, 2 * tp / (predicted + true)).alias("f1")]


def scores(rows: DataFrame, truth: Column, predicted: Column, weight: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """precision, recall and f1, weighted, by group."""
    w = F.lit(1.0) if weight is None else weight
    t, p = truth.cast("double") * w, predicted.cast("double") * w
    sums = rows.groupBy(*(by or [])).agg(F.sum(t * predicted.cast("double")).alias("tp"), F.sum(p).alias("pp"), F.sum(t).alias("t"))
    return sums.select(*(by or []), *_rates(F.col("tp"), F.col("pp"), F.col("t")))


def sweep(rows: DataFrame, truth: Column, score: str) -> DataFrame:
    """(threshold, tp, predicted, precision, recall, f1) with ``score <= threshold`` predicted, at each distinct score."""
    counts = rows.groupBy(F.col(score).alias("threshold")).agg(F.sum(truth.cast("long")).alias("t"), F.count("*").alias("n"))
    totals = running_totals(counts, "threshold", ["t", "n"])
    return totals.select("threshold", F.col("sum_t").alias("tp"), F.col("sum_n").alias("predicted"), *_rates(F.col("sum_t"), F.col("sum_n"), F.col("total_t")))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The threshold of the highest F1, the smaller at a tie."""
    return swept.orderBy(F.desc(F.round("f1", 9)), "threshold").limit(1)


def passes(rows: DataFrame, truth: Column, predicted: Column, period: str, bar: float, least: int = 1) -> DataFrame:
    """(period, f1, passed): F1 in each period with ``least`` true examples and overall; 'overall' passes if all do."""
    each = rows.groupBy(F.col(period).cast("string").alias("period")).agg(F.sum(truth.cast("long") * predicted.cast("long")).alias("tp"), F.sum(predicted.cast("long")).alias("pp"), F.sum(truth.cast("long")).alias("t"))
    whole = each.agg(F.lit("overall").alias("period"), F.sum("tp").alias("tp"), F.sum("pp").alias("pp"), F.sum("t").alias("t"))
    f1 = 2 * F.col("tp") / (F.col("pp") + F.col("t"))
    own = each.where(F.col("t") >= least).select("period", f1.alias("f1"), (f1 >= bar).alias("passed"))
    total = whole.select("period", f1.alias("f1"), (f1 >= bar).alias("passed"))
    every = own.unionByName(total).agg(F.bool_and("passed")).first()[0]
    return own.unionByName(total.withColumn("passed", F.lit(every)))


def calibration(rows: DataFrame, truth: Column, score: str, bins: int = 10) -> DataFrame:
    """(bin, n, hits, of_ten): of every ten rows with a score like this one, how many are true.

    Bins end at the quantiles of the score (our choice of rule); they are found by one aggregation.
    """
    at = [k / bins for k in range(1, bins)]
    bounds = rows.agg(F.percentile_approx(score, at, 1_000_000)).first()[0] or []
    binned = rows.withColumn("bin", sum(((F.col(score) > b).cast("long") for b in bounds), F.lit(1).cast("long")))
    sums = binned.groupBy("bin").agg(F.count("*").alias("n"), F.sum(truth.cast("long")).alias("hits"))
    return sums.withColumn("of_ten", F.floor(10.0 * F.col("hits") / F.col("n") + 0.5).cast("long"))


def chance(key: Column, seed: int = 0) -> Column:
    """A number from 0 to 1 made from a row's key alone: the same on any layout of the rows."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / 4294967296.0


def fold(group: Column, folds: int, seed: int = 0) -> Column:
    """The fold of a row; rows of one group (a speech) are never parted."""
    return F.floor(chance(group, seed) * folds).cast("long")


def stratified(rows: DataFrame, stratum: str, rates: dict, key: str, seed: int = 7) -> DataFrame:
    """A random sample by stratum, with ``weight`` 1 / rate; rows go by the hash of their key."""
    rate = F.element_at(F.create_map(*[F.lit(x) for k, r in rates.items() for x in (k, float(r))]), F.col(stratum))
    return rows.where(chance(F.col(key), seed) < rate).withColumn("weight", 1.0 / rate)


def train(rows: DataFrame, features: str, label: str):
    """A logistic regression on a vector column of array<double> features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    table = rows.select(array_to_vector(F.col(features)).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=20).fit(table)


def with_threshold(rows: DataFrame, features: str, label: str):
    """(model, threshold): a logistic regression and the probability from which on its F1 on ``rows`` is highest."""
    model = train(rows, features, label)
    scored = scored_by(model, rows, features).select((-F.col("p")).alias("score"), (F.col(label) == 1).alias("truth"))
    return model, -best_threshold(sweep(scored, F.col("truth"), "score")).first().threshold


def scored_by(model, rows: DataFrame, features: str) -> DataFrame:
    """Adds ``p``, the model's probability."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(rows.withColumn("_x", array_to_vector(F.col(features))).withColumnRenamed("_x", "features"))
    return scored.withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, "p")
