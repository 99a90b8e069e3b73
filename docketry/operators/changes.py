"""What changed: field by field, item by item; and what isn't there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.sources import logs

NOISE = ("_meta", "extraido", "schema_version", "status_http")
#: Lists that grow as a case goes on, newest first.
GROWING = ("andamentos", "deslocamentos", "peticoes", "recursos")


def added_items(old: Column, new: Column) -> Column:
    """Items of ``new`` beyond those of ``old``, with repetitions, in order: of k equal ones the first as many as
    ``old`` has are taken to be its. Null lists are empty."""
    empty = F.array().cast("array<string>")
    a, b = F.coalesce(old, empty), F.coalesce(new, empty)
    nth = F.transform(b, lambda x, i: F.struct(x.alias("x"), F.size(F.filter(F.slice(b, 1, i + 1), lambda y: y.eqNullSafe(x))).alias("k")))
    fresh = F.filter(nth, lambda t: t["k"] > F.size(F.filter(a, lambda y: y.eqNullSafe(t["x"]))))
    return F.transform(fresh, lambda t: t["x"])


def field_changes(old: DataFrame, new: DataFrame, keys: list[str], skip: tuple[str, ...] = NOISE) -> DataFrame:
    """(keys, field, old, new, is_new): fields whose values differ, null being a value; a case that ``old`` lacks has one
    row, with is_new. Values are compared as JSON text; one join, then the fields are stacked."""
    fields = sorted((set(old.columns) | set(new.columns)) - set(keys) - set(skip))

    def side(df: DataFrame, name: str) -> DataFrame:
        have = dict(df.dtypes)
        text = lambda f: F.lit(None).cast("string") if f not in have else F.to_json(f) if have[f].startswith(("array", "struct", "map")) else F.col(f).cast("string")
        return df.select(*keys, F.array(*[text(f) for f in fields]).alias(name))

    j = side(new, "n").join(side(old, "o"), keys, "left")
    rows = j.select(*keys, F.col("o").isNull().alias("is_new"), F.explode(F.arrays_zip(F.array(*map(F.lit, fields)).alias("field"), F.coalesce("o", F.array().cast("array<string>")).alias("old"), F.col("n").alias("new"))).alias("f"))
    changed = rows.where(~F.col("is_new") & ~F.col("f.old").eqNullSafe(F.col("f.new"))).select(*keys, "f.field", "f.old", "f.new", "is_new")
    none = F.lit(None).cast("string")
    return changed.unionByName(j.where("o IS NULL").select(*keys, none.alias("field"), none.alias("old"), none.alias("new"), F.lit(True).alias("is_new")))


def growth(current: Column, known: Column) -> Column:
    """Verdict on a list that may only grow at its front: same, grown, shrunk or changed (its tail isn't the known
    list). Null lists are empty."""
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (current, known))
    n, m = F.size(a), F.size(b)
    tail = F.when(m > 0, F.slice(a, n - m + 1, m)).otherwise(F.array().cast("array<string>"))
    return F.when(n < m, "shrunk").when(tail != b, "changed").when(n > m, "grown").otherwise("same")


def gaps(low: int, high: int, present: DataFrame, absent: DataFrame, number: str = "processo_id") -> DataFrame:
    """(number) of low to high that are neither in ``present`` nor in ``absent``, highest first. The range is made on the
    executors."""
    spark = present.sparkSession
    every = spark.range(low, high + 1).select(F.col("id").alias(number))
    out = every.join(present.select(F.col(number).cast("bigint")), number, "left_anti").join(absent.select(F.col(number).cast("bigint")), number, "left_anti")
    return out.orderBy(F.desc(number))


def match_gold(names: DataFrame, gold: DataFrame) -> DataFrame:
    """(name, gold): the gold entry of the same name, else the first one in order that the name begins with or that
    begins with the name's part before a blank."""
    head = F.substring_index(F.col("name"), " ", 1)
    exact = names.join(gold.select(F.col("name").alias("gold")), F.col("name") == F.col("gold"), "left_semi").select("name", F.col("name").alias("gold"))
    rest = names.join(exact.select("name"), "name", "left_anti")
    by_head = gold.select(F.col("name").alias("gold"), F.substring_index("name", " ", 1).alias("head"))
    near = rest.withColumn("head", head).join(by_head, "head").groupBy("name").agg(F.min("gold").alias("gold"))
    return exact.unionByName(near)


# what was last seen


def save_snapshots(spark: SparkSession, cases: DataFrame, root: str, keys: tuple[str, ...] = ("classe", "numero")) -> str:
    """Puts the watched cases of this run in the place of what was last seen of them, and keeps what was seen of others;
    readers see the table before or after, never between. Returns the version's folder."""
    old = load_snapshots(spark, root)
    if old is not None:
        rest = old.join(cases.select(*keys).distinct(), [*keys], "left_anti")
        cases = cases.unionByName(rest, allowMissingColumns=True)
    return logs.publish({"snapshots": cases}, root)


def load_snapshots(spark: SparkSession, root: str) -> DataFrame | None:
    """What was last seen of every watched case; None before the first run."""
    version = logs.published(spark, root)
    return None if version is None else spark.read.parquet(f"{version}/snapshots")


def raise_marks(marks: DataFrame | None, cases: DataFrame) -> DataFrame:
    """(classe, max_numero): the highest number seen of each class, never below the mark that was there."""
    seen = cases.groupBy("classe").agg(F.max("numero").alias("max_numero"))
    if marks is not None:
        seen = seen.unionByName(marks.select("classe", "max_numero")).groupBy("classe").agg(F.max("max_numero").alias("max_numero"))
    return seen


def save_marks(spark: SparkSession, marks: DataFrame, root: str, last_run_utc: str) -> str:
    """Publishes the marks and when they were made."""
    return logs.publish({"marks": marks, "run": spark.createDataFrame([(last_run_utc,)], "last_run_utc string")}, root)


def load_marks(spark: SparkSession, root: str) -> tuple[DataFrame | None, str]:
    """The marks and the time of the last run; None and the empty string before the first."""
    version = logs.published(spark, root)
    if version is None:
        return None, ""
    return spark.read.parquet(f"{version}/marks"), spark.read.parquet(f"{version}/run").first()[0]
