"""Stages that keep what they overwrite, so that a later run can put it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.variants import differs, has_key, value_at, variant


def overwritten(rows: DataFrame, stage: str, values: dict[str, Column], where: Column, evidence: str = "evidence") -> DataFrame:
    """``rows`` with new ``values`` where the condition holds; evidence becomes JSON with the stage and what each column held before, as text."""
    was = F.to_json(F.struct(F.lit(stage).alias("stage"), *[F.col(c).cast("string").alias(f"was_{c}") for c in values]), {"ignoreNullFields": "false"})
    hit = F.coalesce(where, F.lit(False))
    return rows.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.when(hit, was).otherwise(F.col(evidence)).alias(evidence) if c == evidence else F.col(c) for c in rows.columns])


def added(rows: DataFrame, new: DataFrame, stage: str, evidence: str = "evidence") -> DataFrame:
    """``rows`` and those of ``new``, whose evidence says which stage added them."""
    mark = F.to_json(F.struct(F.lit(stage).alias("added_by")))
    return rows.unionByName(new.withColumn(evidence, mark), allowMissingColumns=True)


def restored(rows: DataFrame, stage: str, columns: list[str], keep: str | None = None, evidence: str = "evidence") -> DataFrame:
    """``rows`` as they were before the stage: what it added is gone, what it overwrote is back, its evidence is null.

    Evidence whose ``check`` is ``keep`` stays, and so do evidence and rows of other stages.
    """
    v = variant(F.col(evidence))
    left = rows.withColumn("__v", v).where(differs(F.col("__v"), stage, "added_by"))
    own = ~differs(F.col("__v"), stage, "stage")
    kept = ~differs(F.col("__v"), keep, "check") if keep is not None else F.lit(False)
    kinds = dict(rows.dtypes)
    back = {c: F.when(own & has_key(F.col("__v"), f"was_{c}"), value_at(F.col("__v"), f"was_{c}").cast(kinds[c])).otherwise(F.col(c)) for c in columns}
    return left.withColumns(back | {evidence: F.when(own & ~kept, F.lit(None)).otherwise(F.col(evidence))}).select(*rows.columns)
