"""State that is kept as a log and a snapshot: appended to, compacted, and rebuilt after a crash.

The log is what counts: a folder of immutable JSON-lines pieces, in order of their names. A snapshot is what the log up
to some piece amounts to, published by one rename; whoever opens the store replays the pieces after it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.sources import logs


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, at = _at(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def should_compact(records: int, seconds: float, every_records: int = 500, every_seconds: float = 10.0) -> bool:
    """Whether a snapshot is due: so many records, or so long, since the last one."""
    return records >= every_records or seconds >= every_seconds


class Store:
    """Last-write-wins state of ``keys`` under ``root``. Rows have the columns of ``schema``; a later append wins over an
    earlier one, within one append the row that is last by ``order``."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], order: list[str], every_records: int = 500, every_seconds: float = 10.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.spark, self.root, self.schema, self.keys, self.order = spark, root, schema, keys, order
        self.every, self.clock = (every_records, every_seconds), clock
        self.since, self.last = 0, clock()

    @property
    def log(self) -> str:
        return f"{self.root}/log"

    def pieces(self) -> list[str]:
        return [n for n in _names(self.spark, self.log) if n.startswith("piece-")]

    def append(self, rows: DataFrame) -> int:
        """Adds rows to the log as one piece, whole or not at all, and compacts if that is due; how many there were."""
        taken = self.pieces()
        number = int(taken[-1].split("-")[1]) + 1 if taken else 0
        fresh = f"{self.root}/.new-{uuid.uuid4().hex}"
        shape = self.spark.createDataFrame([], self.schema).columns
        rows.select(*shape).write.option("ignoreNullFields", False).json(fresh)
        files, _ = _at(self.spark, self.root)
        files.mkdirs(_at(self.spark, self.log)[1])
        if not files.rename(_at(self.spark, fresh)[1], _at(self.spark, f"{self.log}/piece-{number:012d}")[1]):
            raise OSError(f"piece {number} of {self.root} is there already: one writer at a time")
        n = self.spark.read.schema(self.schema).json(f"{self.log}/piece-{number:012d}").count()
        self.since += n
        if should_compact(self.since, self.clock() - self.last, *self.every):
            self.compact()
        return n

    def _snapshot(self) -> tuple[DataFrame | None, str]:
        version = logs.published(self.spark, f"{self.root}/state")
        if version is None:
            return None, ""
        return self.spark.read.parquet(f"{version}/state"), self.spark.read.parquet(f"{version}/upto").first()[0]

    def state(self) -> DataFrame:
        """The last row of each key, from the snapshot and the pieces after it."""
        old, upto = self._snapshot()
        newer = [n for n in self.pieces() if n > upto]
        parts = [] if old is None else [old.withColumn("_piece", F.lit(""))]
        if newer:
            piece = F.regexp_extract(F.col("_metadata.file_path"), "(piece-[0-9]+)", 1)
            parts.append(self.spark.read.schema(self.schema).json([f"{self.log}/{n}" for n in newer]).withColumn("_piece", piece))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return logs.last_by_key(rows, self.keys, ["_piece", *self.order]).drop("_piece").select(*self.spark.createDataFrame([], self.schema).columns)

    def compact(self) -> str:
        """Publishes a snapshot of the log so far; returns its folder. Nothing of the log is removed."""
        pieces = self.pieces()
        upto = self.spark.createDataFrame([(pieces[-1] if pieces else "",)], "upto string")
        version = logs.publish({"state": self.state(), "upto": upto}, f"{self.root}/state")
        self.since, self.last = 0, self.clock()
        return version

    def stale(self) -> bool:
        """Whether the log has pieces that the snapshot doesn't know, as after a crash."""
        _, upto = self._snapshot()
        pieces = self.pieces()
        return bool(pieces) and pieces[-1] > upto

    def recover(self) -> DataFrame:
        """The state after a crash: a log that is newer than the snapshot is replayed over it, and the snapshot renewed."""
        if self.stale():
            self.compact()
        return self.state()

    def errors(self, fine: Iterable[str] = ("unallocated", "ok")) -> DataFrame:
        """The rows of the state whose status isn't one of ``fine``; a null status isn't."""
        return self.state().where(~F.coalesce(F.col("status").isin(*fine), F.lit(False)))

    def sink(self, rows: DataFrame, checkpoint: str, every: str = "5 seconds"):
        """A stream into the store: each batch is one append, the checkpoint remembers which are in."""
        return rows.writeStream.foreachBatch(lambda batch, _: self.append(batch) and None).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def take_new(spark: SparkSession, path: str, folder: str) -> int:
    """Copies what was added to one growing file since the last call, whole lines only, to ``folder`` as a new piece that
    ``pipeline.follow`` finds; returns how many bytes. A file that is shorter than before was begun anew and is read
    from its start. What was taken is known from the pieces' names, so nothing is lost or doubled by a restart."""
    files, at = _at(spark, path)
    if not files.exists(at):
        return 0
    size = files.getFileStatus(at).getLen()
    done = [n[:-5].split("-")[1:] for n in _names(spark, folder) if n.startswith("lines-") and n.endswith(".json")]
    life, start = max(((int(a), int(b)) for a, _, b in done), default=(0, 0))
    if size < start:
        life, start = life + 1, 0
    if size == start:
        return 0
    reader = files.open(at)
    try:
        end, step = size, 1 << 16
        while end > start:  # the last line's end, from behind
            low = max(start, end - step)
            reader.seek(low)
            cut = bytes(reader.readNBytes(end - low)).rfind(b"\n")
            if cut >= 0:
                end = low + cut + 1
                break
            end = low
        if end == start:
            return 0
        into, _ = _at(spark, folder)
        fresh, final = _at(spark, f"{folder}/.{uuid.uuid4().hex}")[1], _at(spark, f"{folder}/lines-{life:06d}-{start:015d}-{end:015d}.json")[1]
        writer = into.create(fresh, True)
        reader.seek(start)
        left = end - start
        while left:
            some = bytes(reader.readNBytes(min(left, 1 << 20)))
            writer.write(bytearray(some))
            left -= len(some)
        writer.close()
        into.rename(fresh, final)
    finally:
        reader.close()
    return end - start
