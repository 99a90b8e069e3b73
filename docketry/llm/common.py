"""Helpers shared by the training-data operators.

Inputs may carry any further columns, whatever their names: the operators pick the columns they use by exact
name (else by a single case-insensitive match) and rename the others by position while they work.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import ship

#: A unit of length, for either engine's regular expressions.
WORD = "[^ \\t\\n\\r\\f]{1,16}"
#: Rows in an Arrow batch handed to Python; a batch of very long texts must still fit beside an executor's heap.
ARROW_ROWS = 512


def position(df: DataFrame, name: str) -> int:
    """Place of column ``name``: the first exact match, else the only case-insensitive one."""
    if name in df.columns:
        return df.columns.index(name)
    found = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"column {name!r} is missing or ambiguous among {df.columns}")
    return found[0]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, under those names."""
    at = [position(df, n) for n in names]
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)])


class Boxed:
    """A DataFrame whose columns are called c0, c1, ... while an operator works, so that no name of its own clashes."""

    def __init__(self, df: DataFrame) -> None:
        self.names, self.df = df.columns, df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        self._of = df

    def __getitem__(self, name: str) -> str:
        return f"c{position(self._of, name)}"

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def open(self, df: DataFrame) -> DataFrame:
        """Just the input's columns, under their old names."""
        return df.select(*self.df.columns).toDF(*self.names)


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def small_batches(spark: SparkSession) -> None:
    """Makes the session ready for functions over Arrow batches: the workers know the package, and a batch's rows are
    bounded; a smaller setting of the session's stays."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where is None:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = got.get() if got.isDefined() else None
    if where is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="docketry-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = "file://" + own
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Scratch tables by path, with their file system and place in it, which outlive the session.
_scratch: dict[str, tuple] = {}


def register(spark: SparkSession, path: str) -> str:
    """Makes ``path`` a scratch table: it goes with ``drop``, with the ``scratch`` around it, or at exit."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    _scratch[path] = at.getFileSystem(spark._jsc.hadoopConfiguration()), at
    if _inner:
        _inner[-1].add(path)
    return path


def drop(*paths: str) -> None:
    """Removes scratch tables."""
    for path in paths:
        files, at = _scratch.pop(path)
        files.delete(at, True)


_inner: list[set[str]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Removes the tables that were materialised within, once what reads them is written; those of ``keep`` stay for
    the one around it."""
    _inner.append(set())
    try:
        yield
    finally:
        drop(*(_inner.pop() & set(_scratch)))


@atexit.register
def _clean() -> None:
    for path in [*_scratch]:
        try:
            drop(path)
        except Exception:  # the virtual machine is gone: nothing can be removed any more
            return


def materialise(df: DataFrame, what: str, *partition: str) -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder as Parquet, in folders by ``partition``, and reads it back: lineage ends, and
    a lost executor costs nothing. Returns the table and its path, for ``drop``."""
    spark = df.sparkSession
    path = register(spark, f"{shared_dir(spark)}/docketry/{what}-{uuid.uuid4().hex}")
    (df.write.partitionBy(*partition) if partition else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def sized(keys: DataFrame, most_bytes: int) -> DataFrame:
    """Broadcast only if its measured size (its values as text, and 16 bytes a field) allows, else left to a sorted
    shuffle."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in keys.columns), F.lit(0))
    size = keys.agg(F.sum(width.cast("bigint"))).first()[0] or 0
    return F.broadcast(keys) if size <= most_bytes else keys.hint("merge")


def keep(df: DataFrame, what: str) -> DataFrame:
    """``materialise`` for what a ``scratch`` returns: the table outlives it."""
    table, path = materialise(df, what)
    if _inner:
        _inner[-1].discard(path)
    if len(_inner) > 1:
        _inner[-2].add(path)
    return table


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_dir() -> str:
    """Default place of the public vocabulary files; every operator takes another as a parameter."""
    return os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def word_count(text: str | F.Column):
    """Length of a text column in units, as SQL in either engine counts them: words between white space, those of over
    16 signs one for each 16 begun, so that text without blanks has a length too. Null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("bigint")
