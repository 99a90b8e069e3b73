"""Operator 5. Harmonic packing of documents into fixed contexts.

A piece of length l belongs to class k = floor(capacity / l), so its length lies in (capacity / (k + 1), capacity / k]
and exactly k pieces of its class fill a bin. Bins of a class are filled by count alone: no bin looks at another class,
and no worker at another worker's shard, so the packing needs one shuffle of ids and lengths and no state.

Scale: documents are spread over ``shards`` shards by a hash of their id and text, whatever the size of the table; a
group of the window is one class of one shard, and at most one bin of each is left short, so more shards let more
workers fill bins and leave more of them short. Texts don't move: the result is a plan of who goes where.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm import common

#: Units of a context in production.
CAPACITY = 2048
SHARDS = 32


def pack(docs: DataFrame, capacity: int = CAPACITY, shards: int = SHARDS) -> DataFrame:
    """(doc_id, piece, start, length, shard, fill_class, bin, slot): one row for each piece of each document.

    Lengths are units of ``common.word_count``: words, long ones cut to 16 signs. A text longer than ``capacity`` is cut into full pieces and a rest, all
    of it packed; ``start`` is the piece's first unit. A bin is known by (shard, fill_class, bin), a place in it by
    slot, from 0. A null, empty or blank text has length 0, piece 0 and a null class, bin and slot. Within a class
    pieces go by doc_id, nulls last, then digest of the text, then piece, so equal rows are interchangeable; they are in
    one shard, while rows of equal or null ids but different texts are spread. Further columns are ignored; an empty
    table gives an empty table.
    """
    if capacity < 1 or shards < 1:
        raise ValueError("capacity and shards must be 1 or more")
    d = common.pick(docs, "doc_id", "text")
    hashed = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("tie"))), 1, 8), 16, 10).cast("bigint")
    sized = d.select("doc_id", common.word_count("text").alias("words"), F.coalesce(F.md5("text"), F.lit("")).alias("tie")).withColumn("shard", F.pmod(hashed, F.lit(shards)))
    pieces = sized.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("words") / capacity) - 1, F.lit(0)))).alias("piece"))
    pieces = pieces.withColumn("start", F.col("piece") * capacity).withColumn("length", F.least(F.col("words") - F.col("start"), F.lit(capacity).cast("bigint")))
    pieces = pieces.withColumn("fill_class", F.expr(f"{capacity}L div nullif(length, 0)"))
    place = F.row_number().over(Window.partitionBy("shard", "fill_class").orderBy(F.col("doc_id").asc_nulls_last(), "tie", "piece")).cast("bigint") - 1
    filled = pieces.withColumn("place", place)
    return filled.select("doc_id", "piece", "start", "length", "shard", "fill_class", F.expr("place div fill_class").alias("bin"), F.expr("place % fill_class").alias("slot"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))


QUERIES = {"op5_packing": op5_packing}
ORACLE = {
    "op5_packing": f"""
WITH d AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '{common.WORD}')), 0)::BIGINT AS words, coalesce(md5(text), '') AS tie,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')), 1, 8))::BIGINT % {SHARDS} AS shard FROM documents),
p AS (SELECT *, unnest(range(0, greatest(1, ceil(words / {CAPACITY})::BIGINT))) AS piece FROM d),
q AS (SELECT *, piece * {CAPACITY} AS start, least(words - piece * {CAPACITY}, {CAPACITY}) AS length FROM p),
r AS (SELECT *, {CAPACITY} // nullif(length, 0) AS fill_class FROM q),
s AS (SELECT *, row_number() OVER (PARTITION BY shard, fill_class ORDER BY doc_id NULLS LAST, tie, piece) - 1 AS place FROM r)
SELECT doc_id, piece, start, length, shard, fill_class, place // fill_class AS bin, place % fill_class AS slot FROM s
"""
}
