"""The daily report as lines of text: a table (part, a, b, line, text) in the order of its columns.

Each case's lines are made where the case is; ``written`` sorts them and makes one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _or_dash(c: Column) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("—"))


def _lines(rows: DataFrame, part: int, a: Column, b: Column, lines: list[Column]) -> DataFrame:
    some = rows.select(F.lit(part).alias("part"), a.cast("string").alias("a"), b.cast("bigint").alias("b"), F.posexplode(F.array_compact(F.array(*lines))).alias("line", "text"))
    return some.withColumn("line", F.col("line").cast("int"))


def daily(cases: DataFrame, changes: DataFrame | None, date: str, classe: str) -> DataFrame:
    """(part, a, b, line, text): a heading with the number of new cases, the new cases by number (processo_id, relator,
    primeiro_autor, n_andamentos), then, if ``changes`` is given (as ``changes.field_changes`` makes them, keyed by
    classe and numero), the watched cases that changed, by class and number."""
    zero, nothing = F.lit(0), F.lit("")
    head = cases.agg(F.count(F.lit(1)).alias("n"))
    out = _lines(head, 0, nothing, zero, [F.lit(f"# {classe} {date}"), nothing, F.format_string("**%d new cases**", "n"), nothing])
    body = [F.format_string(f"### {classe} %d", F.col("processo_id")), F.concat(F.lit("- Rapporteur: "), _or_dash(F.col("relator"))), F.concat(F.lit("- First party: "), _or_dash(F.col("primeiro_autor"))), F.format_string("- Events: %d", F.coalesce("n_andamentos", zero)), nothing]
    out = out.unionByName(_lines(cases, 1, nothing, F.col("processo_id"), body))
    if changes is None:
        return out
    by_case = changes.groupBy("classe", "numero").agg(F.bool_or("is_new").alias("is_new"), F.array_sort(F.collect_list(F.struct("field", "old", "new"))).alias("fields"))
    told = F.transform("fields", lambda f: F.concat(F.lit("- "), f["field"], F.lit(": "), _or_dash(f["old"]), F.lit(" → "), _or_dash(f["new"])))
    title = F.concat(F.format_string("### %s %d", "classe", "numero"), F.when(F.col("is_new"), " (first seen)").otherwise(""))
    title_of = by_case.agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(_lines(title_of, 2, nothing, zero, [F.format_string("## Watched cases that changed (%d)", "n"), nothing, F.when(F.col("n") == 0, "None since the last run.")]))
    rows = by_case.select("classe", "numero", F.concat(F.array(title), F.when(F.col("is_new"), F.array().cast("array<string>")).otherwise(told), F.array(nothing)).alias("x"))
    watched = rows.select(F.lit(3).alias("part"), F.col("classe").alias("a"), F.col("numero").cast("bigint").alias("b"), F.posexplode("x").alias("line", "text"))
    return out.unionByName(watched.withColumn("line", F.col("line").cast("int")))


def written(lines: DataFrame) -> str:
    """The report as one text, on the driver: a day's news, not a table's."""
    return "\n".join(r["text"] for r in lines.orderBy("part", "a", "b", "line").collect())
