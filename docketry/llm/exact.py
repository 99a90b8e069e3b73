"""Operator 6. Exact deduplication by distributed most-significant-digit radix partitioning.

A group of documents is split by successive digits of their texts until it is a single document (unique) or its texts
have ended (copies). The length goes first, so all texts of a group end together; the digits after it are runs of
bytes, 32 to begin with and each eight times as long as the one before, so a text of n bytes takes about log8(n)
rounds. Texts are only ever compared with themselves, byte by byte; no digest stands for one.

Scale: the first round moves a length and 32 bytes a document, combined on the map side, so a text with millions of
copies is one row. Only documents that share both go on (they are written once to the shared folder, with a number for
each row); each further round groups on the group's number and the next digit, again combined on the map side, and
joins digits without their texts, so that the copies of one text meet as numbers; that join is sorted, and adaptive
execution cuts its skewed partitions. Texts move by row number, evenly, and only those of rows that are still in a group.
Keys are broadcast only if their measured size is below ``broadcast_bytes``; beyond it they are joined by a sorted
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import common

FIRST, GROWTH = 32, 8


def _digit(text: str, start: int, width: int) -> F.Column:
    return F.substring(F.col(text).cast("binary"), start + 1, width)


def exact_dedup(docs: DataFrame, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` (needs doc_id and text) without copies: of each set of equal texts the row of least doc_id
    stays, null ids last, and of rows that are equal in that too, one.

    All columns are returned. A null text equals no other, so its rows all stay; the empty text is a text like others.
    Equality is that of bytes: case, white space and normal forms count. An empty table gives an empty table.
    """
    box = common.Boxed(docs)
    text, doc_id = box["text"], box["doc_id"]
    d = box.df.withColumn("len", F.octet_length(text)).withColumn("head", _digit(text, 0, FIRST))
    shared, _ = common.materialise(d.where("len IS NOT NULL").groupBy("len", "head").count().where("count > 1").select("len", "head"), "exact-keys")
    if shared.isEmpty():
        return docs
    keys = common.sized(shared, broadcast_bytes)
    alone = d.join(keys, ["len", "head"], "left_anti").select(*box.columns)
    meet, _ = common.materialise(d.join(keys, ["len", "head"], "left_semi").drop("head").withColumn("rid", F.monotonically_increasing_id()), "exact-texts")
    first = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("rid").alias("rid"))
    alive, path = meet.select("rid", F.lit(0).cast("bigint").alias("gid"), "len", first.alias("first"), F.col(text).alias("text")), None
    at, width, by, kept = 0, FIRST * (GROWTH + 1), ["len", "gid", "digit"], []
    while True:  # a round for each digit
        keyed = alive.select("rid", "gid", "len", "first", _digit("text", at, width).alias("digit"))
        groups = keyed.groupBy(*by).agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n")).select(*by, "n", F.col("least.rid").alias("new"))
        done = (F.col("n") == 1) | (F.col("len") <= at + width)
        split = keyed.drop("first").join(groups.hint("merge"), by).select("rid", F.col("new").alias("gid"), done.alias("done"))
        split, _ = common.materialise(split.where(~F.col("done") | (F.col("rid") == F.col("gid"))), "exact-split", "done")
        kept.append(split.where("done").select("rid"))
        live, old = split.where("NOT done").select("rid", "gid"), path
        if live.isEmpty():
            if old:
                common.drop(old)
            break
        alive, path = common.materialise(alive.drop("gid").join(common.sized(live, broadcast_bytes), "rid"), "exact-alive")
        if old:
            common.drop(old)
        at, width = at + width, FIRST * GROWTH * GROWTH if at == 0 else width * GROWTH
    stays = kept[0]
    for more in kept[1:]:
        stays = stays.union(more)
    return alone.union(meet.join(common.sized(stays, broadcast_bytes), "rid", "left_semi").select(*box.columns)).toDF(*box.names)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.documents(spark, sf_dir))


QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLE = {
    "op6_exact_dedup": """
SELECT doc_id, text, lang, source, n_chars FROM documents
QUALIFY text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1
"""
}
