"""Ordered logic over runs: rolling detectors, transitions, streaks, and nearest-anchor joins."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import rules

#: a label's least 95th percentile of seconds and failure rate, both to be exceeded; the worst first
BANDS = {"collapse": (60, 0.3), "approaching_collapse": (30, 0.2), "l2_engaged": (15, 0.1)}


def regimes(rows: DataFrame, by: list[str], order: list[str], window: int = 50, warm: int = 20) -> DataFrame:
    """Adds fail_rate, p95_wall_s, regime and promoted_by to rows with status, wall_s, http_status and retries.

    Over the last ``window`` rows of a pool; under ``warm`` rows it is warming. The share of failures that look like a
    firewall's counts at once, the 95th percentile only when the window is full. A window's frame is bounded, so memory
    doesn't grow with a pool's history.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - window, 0)
    bad = F.coalesce(F.col("status") != "ok", F.lit(True)) & rules.waf_shape(F.col("wall_s"), F.col("http_status"), F.col("retries"))
    n = F.count(F.lit(1)).over(w)
    r = rows.withColumns({"_n": n, "_bad": F.avg(bad.cast("double")).over(w), "_walls": F.when(n == window, F.collect_list("wall_s").over(w))})
    cold = F.col("_n") < warm
    p95 = F.when(F.col("_n") == window, F.try_element_at(F.array_sort("_walls"), F.lit(int(0.95 * window) + 1))).otherwise(0.0)
    r = r.withColumns({"fail_rate": F.when(cold, 0.0).otherwise(F.col("_bad")), "p95_wall_s": F.when(cold, 0.0).otherwise(p95)})
    label, why = F.lit("under_utilising"), F.lit("default")
    healthy = F.col("fail_rate") > 0.05
    label, why = F.when(healthy, "healthy").otherwise(label), F.when(healthy, "axis_a").otherwise(why)
    for name, (wall, rate) in reversed(BANDS.items()):
        a, b = F.col("fail_rate") > rate, F.col("p95_wall_s") > wall
        label = F.when(a | b, name).otherwise(label)
        why = F.when(a & b, "both").when(a, "axis_a").when(b, "axis_b").otherwise(why)
    return r.withColumns({"regime": F.when(cold, "warming").otherwise(label), "promoted_by": F.when(cold, "warming").otherwise(why)}).drop("_n", "_bad", "_walls")


def breaker(rows: DataFrame, by: list[str], order: list[str], window: int, threshold: float, errors: Iterable[str] = frozenset({"error"})) -> DataFrame:
    """Adds ``tripped``: whether more than ``threshold`` of the last ``window`` rows are errors, once there are so many."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - window, 0)
    share = F.sum(F.coalesce(F.col("status").isin(*errors), F.lit(False)).cast("int")).over(w) / window
    return rows.withColumn("tripped", (F.count(F.lit(1)).over(w) == window) & (share > threshold))


def transitions(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The rows whose value isn't that of the row before; the first of each group stays."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumns({"_at": F.row_number().over(w), "_was": F.lag(value).over(w)}).where((F.col("_at") == 1) | ~F.col(value).eqNullSafe(F.col("_was"))).drop("_at", "_was")


def regime_summary(rows: DataFrame, severe: tuple[str, ...] = ("collapse", "approaching_collapse")) -> DataFrame:
    """(regime, n, first_key, first_ts): how often each regime occurs and where first, by time, then key."""
    return rows.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "key")).alias("f")).select("regime", "n", F.col("f.key").alias("first_key"), F.col("f.ts").alias("first_ts"), F.col("regime").isin(*severe).alias("severe"))


def discover(probes: DataFrame, by: list[str], number: str, hit: str, misses: int = 20, most: int = 1000) -> DataFrame:
    """The hits that a prober finds which walks up the numbers of each group and stops after ``misses`` in a row, or
    after ``most`` probes. Misses in a row are places since the last hit, so islands need no loop."""
    w = Window.partitionBy(*by).orderBy(number)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    r = probes.withColumns({"_i": F.row_number().over(w), "_hit": F.coalesce(F.col(hit), F.lit(False))})
    r = r.withColumn("_last", F.coalesce(F.max(F.when(F.col("_hit"), F.col("_i"))).over(upto), F.lit(0)))
    r = r.withColumn("_stopped", F.coalesce(F.max((F.col("_i") - F.col("_last") >= misses).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return r.where((F.col("_stopped") == 0) & F.col("_hit") & (F.col("_i") <= most)).drop("_i", "_hit", "_last", "_stopped")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by a partial minimum of the order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *[f"r.{c}" for c in rest])


def first_place_last_value(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each key once, at its first place and with its last values."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    g = rows.groupBy(*keys).agg(F.min(order).alias(order), F.max_by(F.struct(*rest), order).alias("r"))
    return g.select(*keys, order, *[f"r.{c}" for c in rest])


def throttle(latencies: Column, errors: Column, start: float, concurrency: float, low: float, high: float) -> Column:
    """Delay after a host's latencies (array, with an array of whether each was an error): half the old and half the
    latency over the concurrency; an error never lowers it; within bounds."""
    pairs = F.arrays_zip(latencies.alias("l"), errors.alias("e"))

    def step(cur: Column, p: Column) -> Column:
        new = (cur + p["l"] / concurrency) / 2
        new = F.when(p["e"] & (new < cur), cur).otherwise(new)
        return F.greatest(F.lit(low), F.least(F.lit(high), new))

    return F.aggregate(pairs, F.lit(float(start)), step)


def retract(events: Column, sign: str = "LANCAMENTO INDEVIDO") -> Column:
    """struct(kept, removed) of a docket (array of struct with folded nome, complemento and data; newest first): an event
    whose name begins with ``sign`` takes back an earlier one that is still there, and both go.

    Which one, by what its complement has in it, first of these that any has: the name of the event just before; the
    name and date of one, its complement and date, its name, its date, its complement (of several the nearest); else the
    one just before. Where nothing is before it goes alone. Null and empty fields are in no complement.
    """
    has = lambda c, x: F.coalesce((x != "") & c.contains(x), F.lit(False))
    kind = "struct<nome:string,complemento:string,data:string>"
    plain = F.transform(F.reverse(events), lambda e: F.struct(*[e[c].alias(c) for c in ("nome", "complemento", "data")]))

    def step(acc: Column, e: Column) -> Column:
        kept, gone, c = acc["kept"], acc["removed"], F.coalesce(e["complemento"], F.lit(""))
        n = F.size(kept)
        last = F.try_element_at(kept, F.lit(-1))
        nearest = lambda test: F.array_max(F.filter(F.transform(kept, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull()))
        tests = (
            *(lambda x: has(c, x["nome"]) & has(c, x["data"]), lambda x: has(c, x["complemento"]) & has(c, x["data"])),
            *(lambda x: has(c, x["nome"]), lambda x: has(c, x["data"]), lambda x: has(c, x["complemento"])),
        )
        at = F.coalesce(F.when(has(c, last["nome"]), n - 1), *[nearest(t) for t in tests], n - 1)
        both = F.transform(F.array(at), lambda k: F.struct(F.filter(kept, lambda x, i: i != k).alias("kept"), F.concat(gone, F.array(e), F.array(F.try_element_at(kept, k + 1))).alias("removed")))[0]
        alone = F.struct(kept.alias("kept"), F.array_append(gone, e).alias("removed"))
        more = F.struct(F.array_append(kept, e).alias("kept"), gone.alias("removed"))
        return F.when(~F.coalesce(e["nome"].startswith(sign), F.lit(False)), more).when(n == 0, alone).otherwise(both)

    none = F.array().cast(f"array<{kind}>")
    out = F.aggregate(plain, F.struct(none.alias("kept"), none.alias("removed")), step)
    return F.transform(F.array(out), lambda o: F.struct(F.reverse(o["kept"]).alias("kept"), o["removed"].alias("removed")))[0]


def cancel_events(names: Column, cancels: Column) -> Column:
    """Events (array of text, oldest first) without those that a later event takes back, nor the takings back:
    ``cancels`` holds for each event the word that the event it takes back contains, or null. The nearest earlier event
    that is still there is taken back; where there is none nothing happens."""
    pairs = F.arrays_zip(names.alias("n"), cancels.alias("c"))

    def step(kept: Column, p: Column) -> Column:
        at = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size(kept), F.lit(1))), lambda i: F.when(F.try_element_at(kept, i).contains(p["c"]), i)))
        without = F.filter(F.transform(kept, lambda x, i: F.when(i + 1 != at, x)), lambda x: x.isNotNull())
        return F.when(p["c"].isNull(), F.array_append(kept, p["n"])).when(at.isNull(), kept).otherwise(without)

    return F.aggregate(pairs, F.array().cast("array<string>"), step)


# calendar


def _segments(anchors: DataFrame, x: str, y: str) -> DataFrame:
    """Pieces between neighbouring anchors; the outer ones run on for ever. ``anchors`` is a calendar's few rows."""
    w = Window.orderBy(x)
    s = anchors.select(F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"), F.row_number().over(w).alias("i")).where("x1 IS NOT NULL")
    last = F.max("i").over(Window.partitionBy(F.lit(0)))
    return s.withColumns({"lo": F.when(F.col("i") == 1, F.lit(-(1 << 62))).otherwise(F.col("x0")), "hi": F.when(F.col("i") == last, F.lit(1 << 62)).otherwise(F.col("x1"))})


def _by_cell(rows: DataFrame, spread: DataFrame, at: str, cell: Callable[[Column], Column], within: Column) -> DataFrame:
    mine = rows.withColumn("_mine", cell(F.col(at)))
    return mine.join(spread, (F.col("_mine") == F.col("_cell")) & within, "left").drop("_mine", "_cell")


def interpolate(rows: DataFrame, anchors: DataFrame, at: str, x: str, y: str, out: str, broadcast_rows: int = 10_000) -> DataFrame:
    """Adds ``out``: the piecewise linear value at ``at``, whole, halves to even; beyond the anchors the outer pieces go
    on. Up to ``broadcast_rows`` pieces are broadcast; more are met by cells of the axis, as many as there are
    pieces, so the join stays an equality. Null where ``at`` is null or there are fewer than two anchors."""
    pieces = _segments(anchors.groupBy(x).agg(F.min(y).alias(y)), x, y)
    within = (F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))
    n, low, high = pieces.agg(F.count(F.lit(1)), F.min("x0"), F.max("x1")).first()
    if n <= broadcast_rows:
        j = rows.join(F.broadcast(pieces), within, "left")
    else:
        width = max(1, (high - low) // n)
        cell = lambda v: F.floor((F.greatest(F.lit(low), F.least(F.lit(high), v)) - low) / width)
        spread = pieces.withColumn("_cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
        j = _by_cell(rows, spread, at, cell, within)
    value = F.col("y0") + (F.col(at) - F.col("x0")) / (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return j.withColumn(out, F.bround(value).cast("bigint")).select(*rows.columns, out)
