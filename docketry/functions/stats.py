"""Small-sample statistics and cost formulas as columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z95 = 1.959963984540054


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, within 0 and 1; 0, 0 for n of 0 or less."""
    q = z * z
    mid = successes + q / 2
    half = z * F.sqrt(successes * (n - successes) / n + q / 4)
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), (mid - half) / (n + q))).otherwise(0.0), F.when(ok, F.least(F.lit(1.0), (mid + half) / (n + q))).otherwise(0.0)


def grant_rates(rows: DataFrame, by: list[str], outcome: str, wins: tuple[str, ...]) -> DataFrame:
    """n, wins, rate and Wilson bounds for each group; null outcomes count in n."""
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col(outcome).isin(*wins), F.lit(False))).alias("wins"))
    lo, hi = wilson(F.col("wins"), F.col("n"))
    return g.select(*by, "n", "wins", (F.col("wins") / F.col("n")).alias("rate"), lo.alias("ci_lo"), hi.alias("ci_hi"))


def beta_prior(groups: DataFrame, wins: str = "wins", n: str = "n") -> DataFrame:
    """One row (alpha, beta): the prior by moments, the binomial part of the variance taken off, floor 1e-6; the
    concentration is 1 where it would not be positive. Groups of n = 0 don't count; without any there is no row."""
    g = groups.where(F.col(n) > 0).select((F.col(wins) / F.col(n)).alias("r"), F.col(n).alias("m"))
    s = g.agg(F.avg("r").alias("mean"), F.var_pop("r").alias("var"), F.avg(1 / F.col("m")).alias("inv"))
    mean = F.col("mean")
    spread = F.greatest(F.col("var") - mean * (1 - mean) * F.col("inv"), F.lit(1e-6))
    raw = mean * (1 - mean) / spread - 1
    k = F.when(raw <= 0, 1.0).otherwise(raw)
    return s.where(mean.isNotNull()).select((mean * k).alias("alpha"), ((1 - mean) * k).alias("beta"))


def _beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        t = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / max(1 + t * d, 1e-300) if 1 + t * d > 0 else 1 / min(1 + t * d, -1e-300)
        c = 1 + t / c
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def beta_quantile(q: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _beta_cdf(mid, a, b) < q else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def beta_ppf(q: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Quantile of Beta(a, b), by bisection; for tables of groups, not of rows."""
    return pd.Series([beta_quantile(*v) for v in zip(q, a, b, strict=True)])


def posterior(groups: DataFrame, alpha: float, beta: float, wins: str = "wins", n: str = "n", conf: float = 0.95) -> DataFrame:
    """Adds shrunk_rate and the bounds of the equal-tailed interval of Beta(alpha + wins, beta + n - wins)."""
    a, b = alpha + F.col(wins), beta + F.col(n) - F.col(wins)
    tail = (1 - conf) / 2
    return groups.withColumns({"shrunk_rate": a / (a + b), "ci_lo": beta_ppf(F.lit(tail), a.cast("double"), b.cast("double")), "ci_hi": beta_ppf(F.lit(1 - tail), a.cast("double"), b.cast("double"))})


# percentile flavours: exact ranks among a group's values

#: Place (from 0) of a rank among n values, and what share of the way to the next it lies, by flavour.
FLAVOURS: dict[str, Callable[[Column, float], tuple[Column, Column]]] = {
    # round(q (n - 1)), halves to even
    "nearest": lambda n, q: (F.bround(F.lit(q) * (n - 1)), F.lit(0.0)),
    # int(q n)
    "floor": lambda n, q: (F.least(F.floor(F.lit(q) * n), n - 1), F.lit(0.0)),
    # int(q n) - 1, the least at least
    "low": lambda n, q: (F.greatest(F.floor(F.lit(q) * n) - 1, F.lit(0)), F.lit(0.0)),
    # the q-th cut of the exclusive method; beyond the ends by the outer pair
    "exclusive": lambda n, q: ((at := F.greatest(F.least(F.floor(F.lit(q) * (n + 1)) - 1, n - 2), F.lit(0))), F.round(F.lit(q) * (n + 1), 9) - 1 - at),
    # linear between neighbours
    "median": lambda n, q: ((at := F.floor(F.lit(q) * (n - 1))), F.lit(q) * (n - 1) - at),
}


def percentiles(rows: DataFrame, by: list[str], value: str, wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """(by, one column for each of ``wanted``: name -> (flavour, q)) for every group with a value; an exclusive cut of
    under two values is null. Equal values are counted first, with partial sums, so what meets is a group's distinct
    values with their counts, and a rank is found by running sums; no group is brought together as a list."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ordered = counts.withColumns({"_upto": F.sum("_n").over(group.orderBy(value)), "_all": F.sum("_n").over(group)})
    x, picks = F.col(value), []
    for name, (flavour, q) in wanted.items():
        place, share = FLAVOURS[flavour](F.col("_all"), q)
        at = F.min(F.when(F.col("_upto") > place, x))
        if flavour in ("exclusive", "median"):
            after = F.min(F.when(F.col("_upto") > F.least(place + 1, F.col("_all") - 1), x))
            at = at + (after - at) * F.max(share)
        picks.append((F.when(F.max("_all") > 1, at) if flavour == "exclusive" else at).alias(name))
    return ordered.groupBy(*by).agg(*picks)


# costs

class Provider(NamedTuple):
    """What an extractor costs: dollars for 1,000 pages, and in a batch where there are any; seconds for a document,
    None where nobody has measured them, and for a whole batch. ``extract`` takes bytes and gives text; it is put in by
    whoever has the vendor's library."""

    dollars: float
    seconds: float | None
    batch_dollars: float | None = None
    batch_seconds: float | None = None
    extract: Callable[[bytes], str] | None = None


#: The eleven extractors known, with public list prices; a batch takes its time to hand in, whatever its size.
PROVIDERS: dict[str, Provider] = {
    "chandra": Provider(3.0, 15.0),
    "chandra_runpod": Provider(0.31, None),
    "gemini": Provider(1.32, 5.0, 0.66, 30.0),
    "mistral": Provider(2.0, 3.5, 1.0, 30.0),
    "paddle": Provider(0.08, None),
    "pypdf": Provider(0.0, 0.1),
    "surya": Provider(0.18, None),
    "tesseract": Provider(0.0, 3.0),
    "tesseract_fly": Provider(0.005, 3.0),
    "tesseract_modal": Provider(0.14, None),
    "unstructured": Provider(10.0, 25.0),
}
PAGES_PER_DOCUMENT = 4.9


def _rate(provider: Column, of: Callable[[Provider], float | None], known: Mapping[str, Provider]) -> Column:
    rate = F.lit(None).cast("double")
    for name, p in known.items():
        if (r := of(p)) is not None:
            rate = F.when(provider == name, F.lit(float(r))).otherwise(rate)
    return rate


def ocr_cost(provider: Column, pages: Column, batch: bool = False, known: Mapping[str, Provider] = PROVIDERS) -> Column:
    """Dollars for so many pages, in a batch where the provider has one; null for unknown providers."""
    return pages * _rate(provider, lambda p: p.batch_dollars if batch and p.batch_dollars is not None else p.dollars, known) / 1000


def ocr_wall(provider: Column, documents: Column, workers: int = 1, batch: bool = False, known: Mapping[str, Provider] = PROVIDERS) -> Column:
    """Seconds for so many documents among so many workers, or for a batch of them where the provider has one; null for
    providers that are unknown or not measured."""
    in_turn = documents * _rate(provider, lambda p: p.seconds, known) / workers
    return F.coalesce(_rate(provider, lambda p: p.batch_seconds, known), in_turn) if batch else in_turn


def provider_table(spark: SparkSession, documents: int = 1, pages: int = 5, batch: bool = True, known: Mapping[str, Provider] = PROVIDERS) -> DataFrame:
    """(provider, usd, seconds, has_batch) of every provider for a piece of work, the cheapest first, equal ones by
    name; providers of unknown cost last."""
    rows = spark.createDataFrame([(n, p.batch_dollars is not None) for n, p in known.items()], "provider string, has_batch boolean")
    t = rows.select("provider", ocr_cost(F.col("provider"), F.lit(pages), batch, known).alias("usd"), ocr_wall(F.col("provider"), F.lit(documents), 1, batch, known).alias("seconds"), "has_batch")
    return t.orderBy(F.col("usd").asc_nulls_last(), "provider")


def cheapest(table: DataFrame) -> DataFrame:
    """(provider, usd): the first of ``provider_table`` that recognises pages, which a text layer's reader doesn't."""
    return table.where("provider <> 'pypdf' AND usd IS NOT NULL").orderBy("usd", "provider").limit(1).select("provider", "usd")


class Pace(NamedTuple):
    """Megabytes and seconds of one unit of work fetched in turn from one address."""

    megabytes: float
    seconds: float


PACES = {"documents": Pace(0.1685, 3.0), "cases": Pace(47 / 1024, 2.0)}
SPEEDUP, SHARDS, USD_PER_GB = 12.7, 16, 3.65


def forecast(units: Column, pace: Pace, speedup: float = SPEEDUP, shards: int = SHARDS, usd_per_gb: float = USD_PER_GB) -> Column:
    """array<struct(mode, seconds, gb, usd)> before a run: in turn from one address, which costs nothing, and by shards
    through proxies, which bill what is transferred."""
    gb, alone = units * pace.megabytes / 1024, units * pace.seconds
    row = lambda mode, s, usd: F.struct(F.lit(mode).alias("mode"), s.alias("seconds"), gb.alias("gb"), usd.alias("usd"))
    return F.array(row("direct", alone, F.lit(0.0)), row(f"{shards} shards", alone / speedup, gb * usd_per_gb))


def extraction_forecast(documents: Column, provider: Column, pages: float = PAGES_PER_DOCUMENT) -> Column:
    """struct(seconds, usd) of extracting so many documents of ``pages`` pages on average, pages cut to a whole number."""
    return F.struct(ocr_wall(provider, documents).alias("seconds"), ocr_cost(provider, F.floor(documents * pages)).alias("usd"))


def proxy_cost(transferred: Column, used: Column, usd_per_gb: float = USD_PER_GB) -> Column:
    """Dollars for bytes through a proxy, by gigabytes of 10**9; nothing where none was used."""
    return F.when(used, transferred / 1e9 * usd_per_gb).otherwise(0.0)


def parsed_cost(lines: Column) -> Column:
    """Dollars that a log line ``cost: ~$1.23`` tells; null for other lines."""
    return F.nullif(F.regexp_extract(lines, "cost: ~?\\$([0-9]+(?:\\.[0-9]+)?)", 1), F.lit("")).cast("double")


def eta(done: Column, total: Column, elapsed_s: Column) -> Column:
    """Seconds left at the pace so far; null before anything is done."""
    return F.when((done > 0) & (elapsed_s > 0), (total - done) * elapsed_s / done)
