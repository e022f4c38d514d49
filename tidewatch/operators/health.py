"""Health score: capped deductions by rule over the evaluated pages, gated by coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORE_VERSION = 1
# The score's weights, the rate at which a rule deducts its whole weight, the least coverage.
WEIGHTS = {"http_4xx_5xx": 40, "noindex_on_indexable": 25, "missing_title": 20, "canonical_conflict": 15}
FULL_RATE, LEAST_COVERAGE = 0.2, 0.5


def count_of(x: Column) -> Column:
    """A count: floored, never negative; null and what is no finite number count as 0."""
    d = x.cast("double")
    fine = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
    return F.when(fine, F.greatest(F.lit(0.0), F.floor(d).cast("double"))).otherwise(0.0)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "good").when(score >= 75, "fair").when(score >= 50, "poor").when(score.isNotNull(), "critical")


def health(inputs: DataFrame, evaluated: str = "evaluated", observed: str = "observed", open_by_rule: str = "open_by_rule") -> DataFrame:
    """All columns of inputs and coverage, sufficient, components (by weight), score, reason, unrecognized, score_version."""
    e, o = count_of(F.col(evaluated)), count_of(F.col(observed))
    counts = F.coalesce(F.col(open_by_rule), F.create_map().cast("map<string,double>"))
    one = inputs.withColumn("__e", e).withColumn("coverage", F.when(o > 0, e / o).otherwise(0.0))
    one = one.withColumn("sufficient", (F.col("__e") >= 1) & (F.col("coverage") >= LEAST_COVERAGE))
    parts = []
    for rule, weight in WEIGHTS.items():
        n = count_of(F.try_element_at(counts, F.lit(rule)))
        rate = F.when(F.col("__e") > 0, F.least(F.lit(1.0), n / F.when(F.col("__e") > 0, F.col("__e")))).otherwise(0.0)
        lost = F.when(F.col("sufficient"), half_up(F.lit(float(weight)) * F.least(F.lit(1.0), rate / FULL_RATE))).otherwise(F.lit(0).cast("bigint"))
        parts.append(F.struct(F.lit(rule).alias("rule_key"), F.lit(weight).alias("weight"), n.cast("bigint").alias("open"), rate.alias("rate"), lost.alias("deduction")))
    two = one.withColumn("components", F.array(*parts))
    total = F.aggregate("components", F.lit(0).cast("bigint"), lambda a, c: a + c["deduction"])
    unknown = F.array_sort(F.filter(F.map_keys(counts), lambda k: ~k.isin(*WEIGHTS)))
    score = F.when(F.col("sufficient"), F.greatest(F.lit(0).cast("bigint"), 100 - total))
    return two.withColumns(
        {"score": score, "reason": F.when(F.col("sufficient"), "OK").otherwise("INSUFFICIENT_COVERAGE"), "unrecognized": unknown, "score_version": F.when(F.col("sufficient"), F.lit(SCORE_VERSION))}
    ).drop("__e")
