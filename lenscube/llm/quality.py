"""Quality classifier: regularised quadratic discriminant analysis.

Document statistics, log-transformed, are modelled by one normal distribution per class. Counts, sums and
products are gathered over all training rows in one aggregation of fixed size; each class covariance is
shrunk towards its diagonal and a common ridge. A score is the logistic of the difference of the two
log-densities, whose Mahalanobis terms use inverse Cholesky factors kept with the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lenscube.llm.common import cut, docs_of, forget, map_rows, slices

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32,), "line": (10,), "tab": (9, 11, 12, 13),
    "stop": (46, 44, 59, 58, 39, 45), "mark": (33, 63), "sign": (35, 36, 37, 38, 42, 64, 94, 126), "bar": (124, 95, 61, 43, 92, 47),
    "angle": (60, 62, 123, 125, 91, 93, 40, 41), "beyond": range(128, 256),
}
_OF = np.zeros((256, len(_CLASSES)), np.float64)
for _k, _bytes in enumerate(_CLASSES.values()):
    _OF[list(_bytes), _k] = 1
#: A text's plain statistics: bytes of each class, bytes, words, distinct words, lines, distinct lines.
STATS = len(_CLASSES) + 5
WIDTH = len(_CLASSES) + 6
#: How many ordinary bytes and words stand beside every text's own: short texts, whose own shares say little, come
#: out as ordinary ones.
PRIOR_BYTES, PRIOR_WORDS = 180, 2
SHRINKAGE, RIDGE = 0.02, 0.005  # these four are the choice of ``tuning.choose``, which sees training rows only


def stats(texts: list[str | None]) -> np.ndarray:
    """A row of plain statistics for each text; a null text is an empty one."""
    out = np.zeros((len(texts), STATS))
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        words, lines = raw.split(), raw.split(b"\n")
        out[i, : len(_CLASSES)] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _OF
        out[i, len(_CLASSES) :] = len(raw), len(words), len(set(words)), len(lines), len(set(lines))
    return out


def ordinary(total: np.ndarray) -> np.ndarray:
    """From the sums of all texts' statistics: shares of the classes, letters, distinct words and lines for a word.

    Without any text the classes are equal and a word is one letter.
    """
    counts, (n, words, distinct, lines, _) = total[: len(_CLASSES)], total[len(_CLASSES) :]
    if not n or not words:
        return np.array([*np.full(len(_CLASSES), 1 / len(_CLASSES)), 1.0, 1.0, 1.0])
    return np.array([*counts / n, (n - counts[3]) / words, distinct / words, lines / words])


def features(raw: np.ndarray, usual: np.ndarray, prior_bytes: float = PRIOR_BYTES, prior_words: float = PRIOR_WORDS) -> np.ndarray:
    """Transformed statistics, with some of an ordinary text's (``ordinary``) beside each text's own."""
    k = len(_CLASSES)
    counts, (n, w, distinct, lines, distinct_lines) = raw[:, :k], raw[:, k:].T
    per_word = w + prior_words
    return np.column_stack([
        np.log((counts + prior_bytes * usual[:k] + 0.05) / (n + prior_bytes + 0.05 * k)[:, None]), np.log1p(n), np.log1p(w),
        np.log((n - counts[:, 3] + usual[k] * prior_words + 0.01) / per_word), np.log((distinct + usual[k + 1] * prior_words) / per_word),
        np.log((distinct_lines + 2) / (lines + 2)), np.log((lines + usual[k + 2] * prior_words) / per_word),
    ])


@dataclass
class Model:
    """Per class: log prior, mean, inverse Cholesky factor and log-determinant of the covariance."""

    log_prior: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, from 0 to 1."""
        logs = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.factors[c].T
            logs.append(self.log_prior[c] - 0.5 * (np.einsum("ij,ij->i", z, z) + self.log_dets[c]))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit_moments(n: np.ndarray, total: np.ndarray, products: np.ndarray, shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Model:
    """The model from counts (2), sums (2, d) and sums of products (2, d, d) of the classes' rows.

    A class without rows takes the moments of all; without any row at all every score is one half.
    """
    d = total.shape[1]
    n_all = n.sum()
    means, factors, dets = np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        k, s, p = (n[c], total[c], products[c]) if n[c] else (n_all, total.sum(axis=0), products.sum(axis=0))
        k = max(k, 1.0)
        means[c] = s / k
        cov = p / k - np.outer(means[c], means[c])
        weight = min(1.0, shrinkage + d / (k + d))  # few rows: closer to the diagonal
        cov = (1 - weight) * cov + weight * np.diag(np.diag(cov)) + ridge * np.eye(d)
        low = np.linalg.cholesky(cov)
        factors[c] = np.linalg.inv(low)
        dets[c] = 2 * np.log(np.diag(low)).sum()
    prior = np.log((n + 1) / (n_all + 2))
    return Model(prior, means, factors, dets)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5 is 0: such rows' labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def table_of(docs: DataFrame) -> DataFrame:
    """(doc_id, f array<double>): the statistics of every row, computed once."""

    def run(batches):
        for b in slices(batches, 8 << 20):
            yield [b.column(0), list(stats(b.column(1).to_pylist()))]

    return cut(map_rows(docs_of(docs), run, "doc_id long, f array<double>"))


def _summed(rows: DataFrame, summed: Callable[[Iterable], np.ndarray]) -> np.ndarray:
    """The sum of every task's array of one fixed size."""

    def run(batches):
        part = np.asarray(summed(batches), np.float64)
        yield [np.arange(part.size), part.ravel()]

    found = {r.k: r.v for r in map_rows(rows, run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}  # of that size
    return np.array([found[k] for k in range(len(found))])


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def usual_of(table: DataFrame) -> np.ndarray:
    """``ordinary`` of all rows of a table of statistics."""
    return ordinary(np.resize(_summed(table.select("f"), lambda batches: sum((_matrix(b.column(0), STATS).sum(axis=0) for b in batches), np.zeros(STATS))), STATS))


def fit(table: DataFrame, labels: DataFrame, usual: np.ndarray, label: str = "quality") -> Model:
    """Fits on every labelled row that isn't held out; null labels and null ids are passed over."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())

    def moments(batches) -> np.ndarray:
        sums = np.zeros((2, 1 + WIDTH + WIDTH * WIDTH))
        for b in batches:
            y, x = b.column(0).to_numpy(), features(_matrix(b.column(1), STATS), usual)
            for c in (0, 1):
                own = x[y == c]
                sums[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        return sums

    sums = np.resize(_summed(table.join(known, "doc_id").select("y", "f"), moments), (2, 1 + WIDTH + WIDTH * WIDTH))
    return fit_moments(sums[:, 0], sums[:, 1 : 1 + WIDTH], sums[:, 1 + WIDTH :].reshape(2, WIDTH, WIDTH))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, rows that repeat an id included.

    A null or empty text is scored as an empty one, a text of any length whole; a null doc_id stays null and counts
    as not held out. A label of an id that several rows have counts for each; several labels of one id count each.
    Without labels every score is one half; an empty table gives no rows. Other columns are not read.
    """
    table = table_of(docs)
    usual = usual_of(table)
    model = fit(table, labels, usual)

    def run(batches):
        for b in batches:
            yield [b.column(0), model.score(features(_matrix(b.column(1), STATS), usual))]

    scored = map_rows(table, run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier accepts, all columns, of whatever names, as they were; nulls as in ``classify``.

    The statistics are worked out for the fit and again while the texts pass by, so that no text is shuffled or
    written.
    """
    table = table_of(docs)
    usual = usual_of(table)
    model = fit(table, labels, usual)
    forget(table)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(features(stats(text.tolist()), usual)) if len(text) else [], dtype=float)

    return docs.where(score(F.col("text")) >= threshold)
