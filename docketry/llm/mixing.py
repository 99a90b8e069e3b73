"""Operator 9. Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a keyed random order; a document's virtual finish time is the source's tokens up to
and with it, divided by the source's weight; all documents are sorted by finish time and cut where the tokens reach the
budget. Sources that run dry leave their share to the others.

Scale: a source may hold most of the corpus, so no window runs over a whole source. The random order is a hash of id
and text, its leading digits are buckets of about ``bucket_rows`` rows; sums of buckets (a few numbers each) are
accumulated, then rows within a bucket. The global cut is found by dividing time: tokens are summed for 1,024 slots of
finish time, then for 1,024 slots of the one in which the budget ends, and so on until it has few rows, however uneven
the weights; each round is a partial sum over a narrow table. What is kept is a filter by the place that was found.
Texts take no part: within a source the cut is a single place in its order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm import common

#: Production weights: tokens of these sources count so many times those of the others, which have weight 1.
WEIGHTS = {"src1": 3, "src2": 2, "src3": 2}
BUDGET_SHARE = 0.8


_SLOTS = 1024


def _order(doc_id: str, tie: str, seed: int) -> F.Column:
    """The keyed random order, as 16 hexadecimal digits: of id and text, so that rows of null or equal ids are spread."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.col(tie))), 1, 16)


def _tie(text: str) -> F.Column:
    return F.coalesce(F.md5(text), F.lit(""))


def _key(source: str) -> F.Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _upto(*by: str) -> Window:
    """Sums to and with the row and its equals."""
    return Window.partitionBy(*by).rangeBetween(Window.unboundedPreceding, Window.currentRow)


def finish_times(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, seed: int = 7, bucket_rows: int = 50_000) -> DataFrame:
    """(doc_id, source, tokens, key, place, tie, finish) for every row: its place in its source's random order and its
    virtual finish time.

    A null source is a source of its own; unlisted ones weigh 1; tokens are units of ``common.word_count``, a null
    or empty text has 0. Rows equal in id and text finish together. An empty table gives an empty table; further columns
    are ignored.
    """
    rows = common.pick(docs, "doc_id", "text", "source").select("doc_id", "source", common.word_count("text").alias("tokens"), _key("source").alias("key"), _tie("text").alias("tie")).withColumn("place", _order("doc_id", "tie", seed))
    digits, n = 1, docs.count()
    while n / 16**digits > bucket_rows:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("place", 1, digits))
    before = rows.groupBy("key", "bucket").agg(F.sum("tokens").alias("mine")).select("key", "bucket", (F.sum("mine").over(_upto("key").orderBy("bucket")) - F.col("mine")).alias("before"))
    served = F.sum("tokens").over(_upto("key", "bucket").orderBy("place", "tie")) + F.col("before")
    weight = F.lit(1.0)
    for name, w in weights.items():
        if not w > 0:
            raise ValueError(f"the weight of {name!r} must be above 0")
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    return rows.join(before, ["key", "bucket"]).withColumn("finish", served / weight).drop("bucket", "before")


def _ending(timed: DataFrame, budget: int, bucket_rows: int) -> tuple[float, float, int] | None:
    """(low, high, spent): the stretch of finish times, both ends included, in which the tokens pass the budget, and the
    tokens before it; divided until it has ``bucket_rows`` rows with tokens or fewer, or a single time. None if they
    never do."""
    rows, all_tokens, low, high = timed.where("tokens > 0").agg(F.count(F.lit(1)), F.sum("tokens"), F.min("finish"), F.max("finish")).first()
    if not rows or all_tokens <= budget:
        return None
    before = 0
    while rows > bucket_rows and low < high:
        slot = F.least(F.floor((F.col("finish") - low) / F.lit(high - low) * _SLOTS), F.lit(_SLOTS - 1)).alias("slot")
        inside = timed.where((F.col("tokens") > 0) & F.col("finish").between(low, high))
        sums = inside.groupBy(slot).agg(F.sum("tokens").alias("mine"), F.count(F.lit(1)).alias("n"), F.min("finish").alias("lo"), F.max("finish").alias("hi"))
        for _, mine, n, lo, hi in sorted(sums.collect()):  # _SLOTS rows at most
            if before + mine > budget:
                break
            before += mine
        rows, low, high = n, lo, hi
    return low, high, before


def _mixed(docs: DataFrame, weights: Mapping[str, float], budget_share: float, seed: int, bucket_rows: int) -> DataFrame:
    timed, _ = common.materialise(finish_times(docs, weights, seed, bucket_rows), "finish")
    total = timed.agg(F.sum("tokens")).first()[0]
    budget = int(budget_share * total) if total else 0
    ending = _ending(timed, budget, bucket_rows) if total and budget_share < 1 else None
    if ending is None:
        return timed
    low, high, before = ending
    order = ("finish", "key", "place", "tie")
    some = timed.where((F.col("tokens") > 0) & F.col("finish").between(low, high)).select(*order, "tokens")
    spent = F.sum("tokens").over(Window.partitionBy(F.lit(0)).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)) + F.lit(before)
    # the first place at which the budget is passed; what comes before it stays, without tokens too
    cut = some.withColumn("spent", spent).where(F.col("spent") > budget).agg(F.min(F.struct(*order)).alias("cut")).first()["cut"]
    here = F.lit(False)
    for c in reversed(order):
        here = (F.col(c) < cut[c]) | ((F.col(c) == cut[c]) & here)
    return timed.where(here)


def mix_order(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, budget_share: float = BUDGET_SHARE, seed: int = 7, bucket_rows: int = 50_000) -> DataFrame:
    """(doc_id, source, tokens, finish) of the documents within the budget, ``budget_share`` of all tokens rounded
    down, globally sorted by finish time, then source, place and digest. The cut is the longest beginning of that
    order that fits; rows equal in all stay or go together. Nulls and ties as in ``finish_times``."""
    return _mixed(docs, weights, budget_share, seed, bucket_rows).orderBy("finish", "key", "place", "tie").select("doc_id", "source", "tokens", "finish")


def mix(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, budget_share: float = BUDGET_SHARE, seed: int = 7, bucket_rows: int = 50_000, broadcast_rows: int = 100_000) -> DataFrame:
    """The rows of ``docs`` that ``mix_order`` keeps, with all their columns, in no order. Texts aren't shuffled: a
    source keeps a beginning of its own order, so one place a source decides."""
    last = _mixed(docs, weights, budget_share, seed, bucket_rows).groupBy("key").agg(F.max(F.struct("place", "tie")).alias("last"))
    last, _ = common.materialise(last, "mix-places")
    if last.count() <= broadcast_rows:
        last = F.broadcast(last)
    box = common.Boxed(docs)
    d = box.df.withColumn("key", _key(box["source"]))
    d = d.withColumn("tie", _tie(box["text"])).withColumn("place", _order(box["doc_id"], "tie", seed))
    return box.open(d.join(last, "key").where(F.struct("place", "tie") <= F.col("last")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_order(common.documents(spark, sf_dir))


QUERIES = {"op9_mixing": op9_mixing}
_CASES = " ".join(f"WHEN source = '{k}' THEN {float(v)}" for k, v in WEIGHTS.items())
ORACLE = {
    "op9_mixing": f"""
WITH r AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{common.WORD}')), 0)::BIGINT AS tokens,
    coalesce('=' || source, '') AS key, substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')), 1, 16) AS place,
    coalesce(md5(text), '') AS tie FROM documents),
f AS (SELECT *, (sum(tokens) OVER (PARTITION BY key ORDER BY place, tie))::DOUBLE
    / CAST(CASE {_CASES} ELSE 1.0 END AS DOUBLE) AS finish FROM r),
c AS (SELECT *, sum(tokens) OVER (ORDER BY finish, key, place, tie) AS spent,
    floor({BUDGET_SHARE}::DOUBLE * (SELECT sum(tokens) FROM r)::DOUBLE) AS budget FROM f)
SELECT doc_id, source, tokens, finish FROM c WHERE spent <= budget
"""
}
