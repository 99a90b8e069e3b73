"""Operator 10. Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is an expression over built-in functions, so the scan, the measures and the verdicts are one stage
without user functions or shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import common


class Rule(NamedTuple):
    """A document fails if its measure is below ``low`` or above ``high``; an unknown (null) measure passes."""

    name: str
    measure: str
    low: float | None
    high: float | None


STOP_WORDS = (
    "the of and to in is it that for with was are on as be at by this have from "
    "der die das und ist nicht mit ein eine zu den von sich auf für dem des als auch "
    "le la les et est une dans que pour qui sur pas au avec un du "
    "el los las y es en por con para una su no se al lo como más"
).split()

#: Words from which a text in one of the languages of STOP_WORDS has some of them: the stop words of shorter texts are
#: an unknown measure for the rule that asks for a least share.
LONG = 50
#: The production table.
RULES = (
    Rule("too_short", "n_words", 3, None),
    Rule("too_long", "n_words", None, 1_000_000),
    Rule("word_length", "mean_word_length", 1.5, 16),
    Rule("symbols", "symbol_ratio", None, 0.2),
    Rule("stop_words", "stop_word_ratio", None, 0.9),
    Rule("no_stop_words", "long_stop_word_ratio", 0.02, None),
    Rule("repeated_words", "repeat_ratio", None, 0.2),
    Rule("repeated_lines", "duplicate_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
)
SYMBOLS = "[#$%&*|!~^<>=+{}\\\\]"


def measures(text: Column) -> list[tuple[str, Column]]:
    """Steps of the projection, in order; a later one may use an earlier one by name."""
    w, lines = F.col("_words"), F.col("_lines")
    n, m = F.size(w), F.size(lines)
    per = lambda count, of: F.when(of > 0, count / of).otherwise(F.lit(0.0))
    return [
        ("_words", F.filter(F.split(F.lower(text), "[ \\t\\n\\r\\f]+"), lambda x: x != "")),
        ("_lines", F.filter(F.split(text, "\\n"), lambda x: F.trim(x) != "")),
        ("n_words", F.coalesce(n, F.lit(0)).cast("bigint")),
        ("_letters", F.length(F.regexp_replace(text, "[ \\t\\n\\r\\f]+", ""))),
        ("_symbols", F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))),
        ("mean_word_length", per(F.col("_letters"), n)),
        ("symbol_ratio", per(F.col("_symbols"), n)),
        ("stop_word_ratio", per(F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))), n)),
        ("long_stop_word_ratio", F.when(n >= LONG, F.col("stop_word_ratio"))),
        ("repeat_ratio", per(F.size(F.filter(F.zip_with(F.slice(w, 2, F.greatest(n - 1, F.lit(0))), F.slice(w, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)), n)),
        ("duplicate_line_ratio", per(m - F.size(F.array_distinct(lines)), m)),
        ("bullet_line_ratio", per(F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-*•]"))), m)),
        ("ellipsis_line_ratio", per(F.size(F.filter(lines, lambda x: F.rtrim(x).rlike("(\\.\\.\\.|…)$"))), m)),
    ]


MEASURES = ("n_words", "mean_word_length", "symbol_ratio", "stop_word_ratio", "long_stop_word_ratio", "repeat_ratio", "duplicate_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio")


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, the measures rounded to 6 places, failed: names of failed rules in table order, keep) for every row.

    A null text has 0 words, null ratios and fails only the rules on n_words; an empty or blank text has ratios of 0.
    Repeated rows each give a row; an empty table gives none; further columns are ignored.
    """
    d = common.pick(docs, "doc_id", "text")
    for name, expression in measures(F.col("text")):
        d = d.withColumn(name, expression)
    known = F.col("text").isNotNull()
    d = d.select("doc_id", "n_words", *[F.when(known, F.round(F.col(c).cast("double"), 6)).alias(c) for c in MEASURES[1:]])
    tests = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.measure) < r.low)
        if r.high is not None:
            bad = bad | (F.col(r.measure) > r.high)
        tests.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(r.name)))
    d = d.withColumn("failed", F.array_compact(F.array(*tests)))
    return d.withColumn("failed", F.array_join("failed", ",")).withColumn("keep", F.col("failed") == "")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.documents(spark, sf_dir))


def _oracle(rules: Sequence[Rule]) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = ", ".join(
        f"CASE WHEN {' OR '.join([f'{r.measure} < {r.low}'] * (r.low is not None) + [f'{r.measure} > {r.high}'] * (r.high is not None))} THEN '{r.name}' END" for r in rules
    )
    return f"""
WITH a AS (SELECT doc_id, text,
    list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM documents),
b AS (SELECT doc_id, coalesce(len(w), 0) AS n_words, text IS NOT NULL AS known, len(w) AS n, len(l) AS m, w, l,
    length(regexp_replace(text, '[ \\t\\n\\r\\f]+', '', 'g')) AS letters,
    length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS symbols FROM a),
c AS (SELECT doc_id, n_words,
    CASE WHEN n > 0 THEN round(letters / n, 6) WHEN known THEN 0 END AS mean_word_length,
    CASE WHEN n > 0 THEN round(symbols / n, 6) WHEN known THEN 0 END AS symbol_ratio,
    CASE WHEN n > 0 THEN round(len(list_filter(w, lambda x: x IN ({stop}))) / n, 6) WHEN known THEN 0 END AS stop_word_ratio,
    CASE WHEN n >= {LONG} THEN round(len(list_filter(w, lambda x: x IN ({stop}))) / n, 6) END AS long_stop_word_ratio,
    CASE WHEN n > 0 THEN round(len(list_filter(list_zip(w[2:], w[:-2]), lambda x: x[1] = x[2])) / n, 6) WHEN known THEN 0 END AS repeat_ratio,
    CASE WHEN m > 0 THEN round((m - len(list_distinct(l))) / m, 6) WHEN known THEN 0 END AS duplicate_line_ratio,
    CASE WHEN m > 0 THEN round(len(list_filter(l, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) / m, 6) WHEN known THEN 0 END AS bullet_line_ratio,
    CASE WHEN m > 0 THEN round(len(list_filter(l, lambda x: regexp_matches(rtrim(x, ' '), '(\\.\\.\\.|…)$'))) / m, 6) WHEN known THEN 0 END AS ellipsis_line_ratio
  FROM b)
SELECT *, failed = '' AS keep FROM (SELECT *, array_to_string(list_filter([{tests}], lambda x: x IS NOT NULL), ',') AS failed FROM c)
"""


QUERIES = {"op10_quality": op10_quality}
ORACLE = {"op10_quality": _oracle(RULES)}
