"""Binary tensors and columnar point tables, decoded with numpy from Spark's own binary reader."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

# The stored types (little-endian) and the coordinates' scale.
TYPES = {"uint8": "<u1", "uint16": "<u2", "float32": "<f4"}
FULL = 65535.0


def _content(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def shares(spark: SparkSession, path: str, units: int, periods: int, lenses: int, first: int) -> DataFrame:
    """(unit, period, lens, share) of a dense float tensor [unit][period][lens + ALL]; NaN has no row."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame["content"]:
                cube = np.frombuffer(raw, TYPES["float32"]).reshape(units, periods, lenses + 1)
                u, p, lens = np.nonzero(~np.isnan(cube))
                yield pd.DataFrame({"unit": u, "period": p + first, "lens": lens, "share": cube[u, p, lens].astype(float)})

    return _content(spark, path).mapInPandas(decode, "unit long, period long, lens long, share double")


def counts(spark: SparkSession, path: str, units: int, periods: int, first: int) -> DataFrame:
    """(unit, period, n) of a dense uint16 matrix; only cells that have something."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame["content"]:
                table = np.frombuffer(raw, TYPES["uint16"]).reshape(units, periods)
                u, p = np.nonzero(table)
                yield pd.DataFrame({"unit": u, "period": p + first, "n": table[u, p].astype(int)})

    return _content(spark, path).mapInPandas(decode, "unit long, period long, n long")


def points(spark: SparkSession, path: str, count: int, columns: list[tuple[str, str]], first: int) -> DataFrame:
    """(idx, unit, mask, period, topic, x, y): columns one after another; y is stored upside down."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame["content"]:
                at, found = 0, {}
                for name, kind in columns:
                    found[name] = np.frombuffer(raw, TYPES[kind], count, at)
                    at += found[name].nbytes
                wide = {k: v.astype(int) for k, v in found.items()}
                yield pd.DataFrame({
                    "idx": np.arange(count), "unit": wide["c"], "mask": wide["lensmask"], "period": wide["yr"] + first,
                    "topic": wide["topic"], "x": wide["x"] / FULL, "y": 1 - wide["y"] / FULL,
                })

    return _content(spark, path).mapInPandas(decode, "idx long, unit long, mask long, period long, topic long, x double, y double")


class Lazy:
    """Reads that happen once, on first use, and are kept; one that Spark can't read is not tried again.

    The first use computes the table, so that a file that breaks off or isn't there shows then, and not later.
    """

    def __init__(self, read):
        self.read, self.found, self.failed = read, {}, {}

    def want(self, path: str) -> DataFrame | None:
        if path not in self.found and path not in self.failed:
            try:
                df = self.read(path).cache()
                df.count()
                self.found[path] = df
            except (PySparkException, Py4JJavaError) as e:
                self.failed[path] = e
        return self.found.get(path)


def load_all(reads: dict) -> dict[str, DataFrame]:
    """All of some named reads, computed side by side; the first that fails raises."""
    with ThreadPoolExecutor(max(1, len(reads))) as pool:
        def load(read) -> DataFrame:
            df = read().cache()
            df.count()
            return df

        return dict(zip(reads, pool.map(load, reads.values()), strict=True))


def by_lens(df: DataFrame, path: str, column: str) -> None:
    """Writes a table by one column's values, so that a lookup reads one folder only.

    Every partition writes its own file of each value: values are few, and no task gathers one value's rows.
    """
    df.write.mode("overwrite").partitionBy(column).parquet(path)
