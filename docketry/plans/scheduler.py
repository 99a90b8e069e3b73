"""Runs of a pipeline in rounds: tasks that are due, a handler for each kind, results into the store, until nothing is due.

A round takes all due tasks of a stage at once, so a stage is a plan over a table and its concurrency the number of
partitions; what a handler does with a task (fetch, extract) is put in from outside.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators import registry
from docketry.streaming.store import Store

SCHEMA = "kind string, classe string, processo_id int, url string, status string, error string, retry_count int, ts string"
KEYS = ["kind", "classe", "processo_id", "url"]
#: A task's kind, and what it makes due: a case its documents' bytes, those their text.
STAGES = ("fetch_meta", "fetch_bytes", "extract_text")
Handler = Callable[[DataFrame], DataFrame]


def due(targets: DataFrame, state: DataFrame) -> DataFrame:
    """(classe, processo_id, kind, pool, url) of what is to be done next, from the store's state."""
    meta = state.where("kind = 'fetch_meta'")
    urls = state.where("kind <> 'fetch_meta'").withColumn("stage", F.col("kind"))
    # a document that a case's page named, and nothing was done about yet, has no status
    return registry.seeds(targets, meta, urls)


class Outcome(NamedTuple):
    rounds: int
    done: int
    finished: bool


def run(store: Store, targets: DataFrame, handlers: Mapping[str, Handler], concurrency: Mapping[str, int] | None = None, most: int = 10) -> Outcome:
    """Rounds over (classe, processo_id) until nothing is due, or ``most`` of them. A handler gets (classe, processo_id,
    kind, pool, url) and returns rows of SCHEMA without retry_count: for a case's page also the documents that it names,
    as rows of fetch_bytes with a null status. Kinds without a handler stay due."""
    done = 0
    for n in range(most):
        state = store.state()
        tasks = due(targets, state).where(F.col("kind").isin(*handlers))
        worked = 0
        for kind in STAGES:
            if kind not in handlers:
                continue
            mine = tasks.where(F.col("kind") == kind)
            if concurrency and kind in concurrency:
                mine = mine.repartition(concurrency[kind], "classe", "processo_id")
            got = handlers[kind](mine)
            old = state.select(*[F.col(c).alias(f"_{c}") for c in KEYS], F.col("retry_count").alias("_had"), F.col("status").alias("_was"))
            both = got.join(old, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEYS], "left")
            # a document that is known already isn't named anew
            fresh = both.where("status IS NOT NULL OR _kind IS NULL")
            again = F.when(F.col("_was").isNotNull() & F.col("status").isNotNull(), F.coalesce("_had", F.lit(0)) + 1).otherwise(F.lit(0))
            worked += store.append(fresh.select(*KEYS, "status", "error", again.cast("int").alias("retry_count"), "ts"))
        if not worked:
            return Outcome(n, done, True)
        done += worked
    return Outcome(most, done, due(targets, store.state()).where(F.col("kind").isin(*handlers)).isEmpty())


class Stable(NamedTuple):
    """How a recovery ended: after so many passes with so many left, and why."""

    passes: int
    left: int
    why: str


def until_stable(count: Callable[[], int], recover: Callable[[int], bool], most: int = 3) -> Stable:
    """Recovers in passes: counts what could be recovered, stops when nothing is left ("converged"), when it is no less
    than before the last pass or a pass had nothing to do ("no progress"), or after ``most`` passes ("most passes")."""
    before, left = None, 0
    for n in range(1, most + 1):
        left = count()
        if left == 0:
            return Stable(n, 0, "converged")
        if before is not None and left >= before or not recover(n):
            return Stable(n, left, "no progress")
        before = left
    return Stable(most, left, "most passes")
