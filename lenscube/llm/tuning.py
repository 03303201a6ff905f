"""How the quality classifier's constants are chosen: inner folds of training rows, never a held-out row.

``python -m lenscube.llm.tuning TABLES...`` prints the settings in their order for folders of tables.
"""

from __future__ import annotations

import itertools
import sys
import zlib

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lenscube.llm import quality
from lenscube.llm.common import load

#: prior bytes, prior words, shrinkage, ridge
GRID = ((20, 60, 180, 540, 1620), (0.5, 2, 5, 15), (0.002, 0.005, 0.01, 0.02, 0.05, 0.1), (0.001, 0.0025, 0.005, 0.01, 0.02))
#: Labelled training rows of a folder that are looked at, at most.
MOST_ROWS = 8000


def training_rows(ids: list[int], texts: list[str | None], labels: list[int]) -> tuple[list, np.ndarray, np.ndarray]:
    """Texts, labels and inner folds (0 to 4) of the rows that aren't held out."""
    crc = np.array([zlib.crc32(str(i).encode()) for i in ids], np.int64)
    kept = np.flatnonzero(crc % 5 != 0)
    return [texts[k] for k in kept], np.array(labels, int)[kept], crc[kept] // 5 % 5


def moments(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of products of the two classes."""
    own = [x[y == c] for c in (0, 1)]
    return np.array([len(o) for o in own], float), np.array([o.sum(axis=0) for o in own]), np.array([o.T @ o for o in own])


def error(y: np.ndarray, score: np.ndarray, threshold: float = 0.3) -> tuple[float, float]:
    """Mean of the two classes' error shares at the threshold, and the log loss."""
    wrong = (score >= threshold) != (y == 1)
    e = np.clip(score, 1e-12, 1 - 1e-12)
    shares = [wrong[y == c].mean() for c in (0, 1) if (y == c).any()]
    return float(np.mean(shares)), float(-np.mean(y * np.log(e) + (1 - y) * np.log(1 - e)))


def choose(tables: list[tuple[list, np.ndarray, np.ndarray]], grid: tuple = GRID) -> list[tuple[tuple, tuple[float, float]]]:
    """Settings with their error, best first: cross-validated error averaged over the tables, ties by log loss."""
    found = {}
    plain = [(raw := quality.stats(texts), quality.ordinary(raw.sum(axis=0)), y, fold) for texts, y, fold in tables]
    for prior_bytes, prior_words in itertools.product(*grid[:2]):
        data = [(quality.features(raw, usual, prior_bytes, prior_words), y, fold) for raw, usual, y, fold in plain]
        for shrinkage, ridge in itertools.product(*grid[2:]):
            errors = []
            for x, y, fold in data:
                score = np.zeros(len(y))
                for f in range(5):
                    model = quality.fit_moments(*moments(x[fold != f], y[fold != f]), shrinkage, ridge)
                    score[fold == f] = model.score(x[fold == f])
                errors.append(error(y, score))
            mean = np.mean(errors, axis=0)
            found[prior_bytes, prior_words, shrinkage, ridge] = (round(float(mean[0]), 6), float(mean[1]))
    return sorted(found.items(), key=lambda kv: kv[1])


def main(folders: list[str]) -> None:
    spark = SparkSession.builder.getOrCreate()
    tables = []
    for folder in folders:
        labels = load(spark, folder, "labels").where("quality in (0, 1)").select("doc_id", "quality")
        known = load(spark, folder, "documents").select("doc_id", "text").join(labels, "doc_id").where(~quality.held_out())
        rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_ROWS).collect()
        tables.append(training_rows(*(list(c) for c in zip(*rows, strict=True))))
    for setting, errors in choose(tables)[:10]:
        print(*setting, *errors)


if __name__ == "__main__":
    main(sys.argv[1:])
