"""Evidence tests: exception rates against a tolerance, changes of result, design tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Years between updates by risk.
REVIEW_YEARS = {"high": 2, "medium": 8, "low": 10}


def operating_test(rows: DataFrame, by: list[str], exception: Column, tolerance: float = 0.05) -> DataFrame:
    """Exceptions, total, rate (four places) and result of each group; a rate equal to the tolerance is effective."""
    counted = rows.groupBy(*by).agg(F.count_if(exception).alias("exceptions"), F.count("*").alias("total"))
    return with_result(counted, tolerance)


def with_result(counted: DataFrame, tolerance: float | Column = 0.05) -> DataFrame:
    share = F.col("exceptions") / F.col("total")
    result = F.when(F.col("total") == 0, "cannot_assess").when(share <= tolerance, "effective").otherwise("ineffective")
    return counted.withColumns({"rate": F.when(F.col("total") > 0, F.round(share, 4)), "result": result})


def transition(before: Column, now: Column) -> Column:
    """What a result means after the one before it."""
    return (
        F.when(now == "cannot_assess", "cannot_assess")
        .when((now == "ineffective") & before.eqNullSafe(F.lit("ineffective")), "still_failing")
        .when(now == "ineffective", "newly_failing")
        .when(before.eqNullSafe(F.lit("ineffective")), "recovered")
        .otherwise("healthy")
    )


def transitions(tests: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    before = F.lag("result").over(W.partitionBy(*key).orderBy(*order))
    return tests.withColumn("previous", before).withColumn("transition", transition(F.col("previous"), F.col("result")))


def overdue(last: Column, risk: Column, as_of: Column, years: dict[str, int] | None = None) -> Column:
    """Whether the last update lies more than the risk's years of 365 days before ``as_of``."""
    n = F.lit(None).cast("int")
    for name, count in (REVIEW_YEARS if years is None else years).items():
        n = F.when(risk == name, count * 365).otherwise(n)
    return F.coalesce(last < F.date_sub(as_of, n), F.lit(False))


def late(begun: Column, done: Column, days: int | Column) -> Column:
    return F.coalesce(F.datediff(done, begun) > days, F.lit(False))


def missing_parts(owner: Column, frequency: Column, threshold: Column, evidence: Column) -> Column:
    """Names of what a control's design lacks: owner, frequency or threshold, evidence."""
    parts = F.array(F.when(owner.isNull(), "owner"), F.when(frequency.isNull() & threshold.isNull(), "frequency or threshold"), F.when(evidence.isNull(), "evidence"))
    return F.filter(parts, lambda p: p.isNotNull())


def design_result(missing: Column) -> Column:
    return F.when(F.size(missing) == 0, "effective").otherwise("not_effective")


def period(rows: DataFrame, columns: list[str], apart: str = "account_id") -> DataFrame:
    """Earliest and latest of the strings that look like dates (yyyy-mm-dd) in ``columns``, but for ``apart``."""
    stacked = rows.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns if c != apart])).alias("d"))
    dates = stacked.where(F.col("d").rlike("^.{4}-.{5}$"))
    return dates.agg(F.min("d").alias("period_start"), F.max("d").alias("period_end"))


def assess_batch(rows: DataFrame, control: str, exception: Column, tolerance: float, history: DataFrame, order: str) -> DataFrame:
    """A batch's result for each control beside its latest one in ``history`` (control, result, order): nothing is written."""
    now = operating_test(rows, [control], exception, tolerance)
    last = history.groupBy(control).agg(F.max_by("result", order).alias("previous"))
    both = now.join(last, control, "left")
    return both.withColumn("transition", transition(F.col("previous"), F.col("result")))


def gap_after(state: Column, tier: Column) -> Column:
    """Status of a control's gap after a batch: failing ones open or stay open, others are never closed here."""
    return F.when(state.isin("newly_failing", "still_failing"), "open").otherwise(F.coalesce(tier, F.lit("none")))
