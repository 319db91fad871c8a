"""Evidence logs made from a seed, by ranges of row numbers, with an exact number of exceptions."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import REVIEW_YEARS


def _draw(seed: int, what: str, n: int) -> Column:
    """A number below ``n`` that depends on the seed, its use and the row alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col("id")), F.lit(n)).cast("int")


def _excepted(n: int, exceptions: int, seed: int) -> Column:
    """True for exactly ``exceptions`` of ``n`` rows: those that a permutation of the row numbers sends below that number."""
    if not 0 <= exceptions <= n:
        raise ValueError("as many exceptions as rows at most")
    step = next(a for a in range(2 * abs(seed) % max(1, n) + n // 3 + 1, 4 * n + 8) if gcd(a, max(1, n)) == 1)
    return F.pmod(F.col("id") * step + seed, F.lit(max(1, n))) < exceptions


def review_log(spark: SparkSession, n: int, exceptions: int, seed: int, as_of: str, partitions: int | None = None) -> DataFrame:
    """Rows (account_id, risk_category, last_kyc_update): ``exceptions`` accounts are overdue at ``as_of``, by their risk's years."""
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    names = F.array(*map(F.lit, REVIEW_YEARS))
    years = F.array(*map(F.lit, REVIEW_YEARS.values()))
    pick = _draw(seed, "risk", len(REVIEW_YEARS))
    days = F.get(years, pick) * 365
    age = F.when(_excepted(n, exceptions, seed), days + 1 + _draw(seed, "overdue", 400)).otherwise(F.pmod(_draw(seed, "age", 1 << 30), days + 1))
    return rows.select(F.format_string(f"A{seed % 1000:03d}%05d", F.col("id")).alias("account_id"), F.get(names, pick).alias("risk_category"), F.date_sub(F.lit(as_of).cast("date"), age.cast("int")).cast("string").alias("last_kyc_update"))


def upload_log(spark: SparkSession, n: int, exceptions: int, seed: int, start: str, deadline: int = 10, partitions: int | None = None) -> DataFrame:
    """Rows (account_id, opened_on, ckycr_uploaded_on): ``exceptions`` uploads come after more than ``deadline`` days."""
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    opened = F.date_add(F.lit(start).cast("date"), _draw(seed, "opened", 181))
    lag = F.when(_excepted(n, exceptions, seed), deadline + 1 + _draw(seed, "late", 45)).otherwise(1 + _draw(seed, "lag", deadline))
    return rows.select(F.format_string(f"C{seed % 1000:03d}%05d", F.col("id")).alias("account_id"), opened.cast("string").alias("opened_on"), F.date_add(opened, lag.cast("int")).cast("string").alias("ckycr_uploaded_on"))
