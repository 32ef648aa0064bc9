"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of a batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: Paths that :func:`cut` has written; a caller's own list inside :func:`own_tables`.
_WRITTEN: ContextVar[list[str]] = ContextVar("written", default=[])
_OWN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Only a local session may do without ``spark.checkpoint.dir``: it gets a
    temporary folder, deleted at exit.  On a cluster no folder could be guessed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="verdance-shared-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        root = _OWN[0]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


@contextmanager
def own_tables() -> Iterator[None]:
    """Tables written inside are counted and dropped apart from all others, so that two callers don't meet."""
    token = _WRITTEN.set([])
    try:
        yield
    finally:
        _WRITTEN.reset(token)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again.

    The written table replaces the lineage: a lost executor costs a reread, not
    a recomputation of everything before.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/verdance/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with batches of bounded size: a worker holds a few of them at once, whatever the rows' texts.

    Spark's own limits (10000 rows or 64 MB) are lowered for the session; a user's smaller ones stay.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.sub("[bB]$", "", str(conf.get(name)))
        if not now.lstrip("-").isdigit() or int(now) <= 0 or int(now) > most:
            conf.set(name, str(most))
    return df.mapInArrow(run, schema)


def written() -> int:
    """How many tables :func:`cut` has written for the caller that are still there."""
    return len(_WRITTEN.get())


def drop_written(spark: SparkSession, first: int = 0, keep_last: bool = False, last: int | None = None) -> None:
    """Delete the caller's written tables from the ``first`` on (up to ``last``), once what reads them is stored; the last may stay."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _WRITTEN.get()
    end = len(paths) - keep_last if last is None else last
    for name in paths[first:end]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    del paths[first:end]


def hot_join(rows: DataFrame, table: DataFrame, key: str, hot: Column) -> DataFrame:
    """``rows`` joined with ``table``, which has one row of each ``key``; ``hot`` says which of them very many rows hold.

    Those, few by their share of all rows, are broadcast, so that no task gets all rows of one.
    """
    many, few = F.broadcast(table.where(hot)), table.where(~hot)
    return rows.join(many, key).unionByName(rows.join(many.select(key), key, "left_anti").join(few, key))


def least_hash(ids: DataFrame, column: str, rows: int) -> DataFrame:
    """The ``rows`` rows of least hash of ``column``: a sample that partitioning doesn't change.

    Rows far beyond the expected cut are dropped before the sort, so that each
    task passes on few.
    """
    total = ids.count()
    if total > 4 * rows:
        ids = ids.where(F.xxhash64(column) <= F.lit(int(-(2**63) + 2**64 * 2 * rows / total)))
    return ids.orderBy(F.xxhash64(column), column).limit(rows)


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty, lone surrogates are replaced."""
    return (text or "").encode("utf-8", "replace")


def link_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Merge the classes of ``left[i]`` and ``right[i]`` in place; a label is the smallest index of its class."""
    while left.size:
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return
        left, right = left[apart], right[apart]
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def text_column(names: list[str], text_col: str) -> tuple[list[Column], int]:
    """The text as a further column, unless ``names`` hold it already, and its place."""
    return ([], names.index(text_col)) if text_col in names else ([F.col(text_col).alias("__text")], len(names))
