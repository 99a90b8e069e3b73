"""Streaming counterparts: last-write-wins state, regime detection by pool, following a log, progress and stopping.

The state of a key is bounded: a last row and a counter, or a ring of ``window`` rows and the rows whose time hasn't come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docketry import ship
from docketry.operators.sequences import BANDS

LOG = "kind string, classe string, processo int, url string, status string, error string, ts string, wall_s double, pool string"


def follow(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """New JSON-lines files under ``path`` as they come; malformed lines are rows of nulls and dropped. A file that grows
    is followed by its pieces, see ``store.take_new``."""
    return spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(path).where("kind IS NOT NULL")


def latest(rows: DataFrame) -> DataFrame:
    """(kind, classe, processo, url, status, error, ts, retry_count): the last row of a key by time, for a sink in update
    or complete mode."""
    url = F.coalesce("url", F.lit("")).alias("url")
    g = rows.select("kind", "classe", "processo", url, "status", "error", "ts").groupBy("kind", "classe", "processo", "url")
    return g.agg(F.max_by(F.struct("status", "error", "ts"), F.struct("ts", "status")).alias("r"), (F.count(F.lit(1)) - 1).alias("retry_count")).select("kind", "classe", "processo", "url", "r.status", "r.error", "r.ts", "retry_count")


def progress(rows: DataFrame, delay: str = "10 minutes", every: str = "1 minute") -> DataFrame:
    """(window, kind, status, n) with a watermark on event time, for a sink in append mode."""
    at = rows.withColumn("at", F.try_to_timestamp("ts")).withWatermark("at", delay)
    return at.groupBy(F.window("at", every), "kind", "status").agg(F.count(F.lit(1)).alias("n"))


_OUT = "pool string, ts string, status string, wall_s double, fail_rate double, p95_wall_s double, regime string, tripped boolean"
_STATE = "walls array<double>, bad array<boolean>, failed array<boolean>, at array<bigint>, ts array<string>, status array<string>, wall array<double>"


def regimes(rows: DataFrame, window: int = 50, warm: int = 20, slow: float = 15.0, delay: str = "10 minutes", breaker_window: int = 50, breaker_share: float = 0.8) -> DataFrame:
    """(pool, ts, status, wall_s, fail_rate, p95_wall_s, regime, tripped) for every row, in each pool's order of event
    time, whatever the order of arrival: a row waits until the watermark, ``delay`` behind the latest time, has passed
    it; rows that come later than that are dropped, as by any watermark, and so are those without a time.

    A failure counts for the regime if it took longer than ``slow`` seconds; the breaker trips while more than
    ``breaker_share`` of the last ``breaker_window`` rows failed. Rows of one time go by status, then seconds. For a
    sink in append mode."""
    ring = max(window, breaker_window)

    def judge(pool: str, walls: list, bad: list, failed: list, ts: str, status: str, wall: float) -> tuple:
        n = min(len(walls), window)
        tripped = len(failed) >= breaker_window and sum(failed[-breaker_window:]) / breaker_window > breaker_share
        if n < warm:
            return pool, ts, status, wall, 0.0, 0.0, "warming", tripped
        rate = sum(bad[-n:]) / n
        p95 = sorted(walls[-n:])[int(0.95 * n)] if n == window else 0.0
        label = next((name for name, (p, r) in BANDS.items() if rate > r or p95 > p), "healthy" if rate > 0.05 else "under_utilising")
        return pool, ts, status, wall, rate, p95, label, tripped

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        walls, bad, failed, *waiting = (list(x) for x in state.get) if state.exists else ([] for _ in range(7))
        pending = list(zip(*waiting, strict=True))
        if not state.hasTimedOut:
            for frame in frames:
                at = frame["at"].astype("datetime64[ns]").astype("int64") // 1_000_000
                pending += zip(at.tolist(), frame["ts"].tolist(), frame["status"].tolist(), frame["wall_s"].astype(float).tolist(), strict=True)
        pending.sort(key=lambda r: (r[0], r[1], r[2] or "", r[3]))
        passed, out = state.getCurrentWatermarkMs(), []
        while pending and pending[0][0] <= passed:
            _, ts, status, wall = pending.pop(0)
            walls, bad, failed = [*walls, wall][-ring:], [*bad, status != "ok" and wall > slow][-ring:], [*failed, status != "ok"][-ring:]
            out.append(judge(key[0], walls, bad, failed, ts, status, wall))
        state.update((walls, bad, failed, *([list(c) for c in zip(*pending, strict=True)] or [[], [], [], []])))
        if pending:
            state.setTimeoutTimestamp(max(pending[0][0], passed + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    ship(rows.sparkSession)
    timed = rows.withColumn("at", F.try_to_timestamp("ts")).where("at IS NOT NULL").withWatermark("at", delay)
    return timed.select("pool", "ts", "status", F.coalesce("wall_s", F.lit(0.0)).alias("wall_s"), "at").groupBy("pool").applyInPandasWithState(update, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drain(query: StreamingQuery, seconds: int = 60) -> bool:
    """Lets a query finish what has arrived, then stops it; what it has written and its checkpoint stay whole. Whether it
    was done within ``seconds``; it is stopped in any case."""
    import time

    end = time.monotonic() + seconds
    try:
        while query.isActive and time.monotonic() < end:
            if not query.status["isDataAvailable"] and not query.status["isTriggerActive"]:
                return True
            time.sleep(0.05)
        return not query.isActive
    finally:
        query.stop()


def progress_line(name: str, batch: int, rows: int, per_second: float, seconds: float) -> str:
    return f"[{name}] batch {batch}: {rows} rows, {per_second:.1f} a second, {seconds:.1f}s"


class ProgressLines(StreamingQueryListener):
    """Hands a line about every batch that had rows, and one about a query's end, to ``say``."""

    def __init__(self, say: Callable[[str], None] = print) -> None:
        self.say, self.names = say, {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.numInputRows:
            self.say(progress_line(p.name or str(p.id), p.batchId, p.numInputRows, p.processedRowsPerSecond or 0.0, (p.batchDuration or 0) / 1000))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.say(f"[{self.names.get(str(event.id), event.id)}] " + (f"failed: {event.exception}" if event.exception else "done"))
