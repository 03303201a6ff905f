"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables, by Spark's own reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Folders under the shared one that this process has written and not yet removed.
_written: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where it is unset, a session in one process (tests) gets a temporary one; on a cluster executors could not
    see that, so a RuntimeError is raised there.
    """
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="lenscube-checkpoint-"))
    return jsc.getCheckpointDir().get()


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path under the shared folder; ``release`` removes it."""
    _written.append(f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return _written[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any longer."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


def kept() -> set[str]:
    """What the operators keep in the shared folder at present."""
    return set(_written)


def release(spark: SparkSession, but: set[str] = frozenset()) -> None:
    """Removes what the operators keep in the shared folder, ``but`` excepted, once their results have been read."""
    for path in kept() - but:
        remove(spark, path)


def _checkpoint_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().logical().rdd().getCheckpointFile().get()


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into the shared checkpoint folder; what follows reads it from there.

    A lost executor costs only its running tasks: the rows are on shared storage. They stay until ``release``, or
    until Spark's cleaner takes them (``spark.cleaner.referenceTracking.cleanCheckpoints``, off by default).
    """
    checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    _written.append(_checkpoint_of(kept))
    return kept


def forget(df: DataFrame) -> None:
    """Removes what ``cut`` keeps of ``df``, which nothing may read any longer."""
    remove(df.sparkSession, _checkpoint_of(df))


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df``, of whatever names, as one struct."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def columns_of(row: str, names: list[str]) -> list[Column]:
    """The columns of a struct that ``whole_row`` made."""
    return [F.col(f"{row}.`{c}`") for c in names]


def docs_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, text string) and nothing else, so that only these columns are read."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def slices(batches: Iterable[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches of (doc_id, text) into ones of about ``max_bytes`` of text, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i in range(n):
            if total and total + int(sizes[i]) > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(sizes[i])
        yield batch.slice(start)


def schema_of(df_schema: str, spark: SparkSession) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(df_schema))


def map_rows(df: DataFrame, function, ddl: str) -> DataFrame:
    """``mapInArrow`` for a function from batches to tuples of columns (lists or arrays)."""
    arrow = schema_of(ddl, df.sparkSession)

    def run(batches):
        for columns in function(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )

    return df.mapInArrow(run, ddl)
