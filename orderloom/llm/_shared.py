"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import contextvars
import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def each(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then the same of each next start."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach: spark.checkpoint.dir, or the context's checkpoint folder.

    A session that names neither, as in tests, gets a local one if its executors are local too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = named.get() if named.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "/tmp/checkpoints"
    return found.rstrip("/")


#: What materialize() has written inside each scratch() block of this thread or task, the innermost last.
_open: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scratch", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that materialize() writes inside this block are deleted at its end, but for those kept with keep().

    Around a query and the use of its result, it leaves nothing behind. Blocks of other threads are not touched.
    """
    before = _open.set((*_open.get(), []))
    try:
        yield
    finally:
        paths = _open.get()[-1]
        _open.reset(before)
        for path in paths:
            _delete(spark, path)


def keep(df: DataFrame) -> DataFrame:
    """Hands a materialized table to the next outer scratch() block, or to nobody."""
    blocks = _open.get()
    for at, paths in enumerate(blocks):
        if df._scratch_path in paths:
            paths.remove(df._scratch_path)
            if at:
                blocks[at - 1].append(df._scratch_path)
    return df


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts lineage: a lost executor costs a re-read, not the work behind it, and
    several branches can use the result without repeating that work.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    if blocks := _open.get():
        blocks[-1].append(path)
    df.write.parquet(path)
    found = spark.read.schema(schema).parquet(path)
    found._scratch_path = path  # for keep() and remove(), which take this very object
    return found


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a materialized DataFrame that nothing reads any more."""
    _delete(spark, df._scratch_path)
    for paths in _open.get():
        if df._scratch_path in paths:
            paths.remove(df._scratch_path)
