"""What becomes of a judge's answers: the gate behind the model, mappings and gaps, and later changes of tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import located
from .rules import gap_type, mapping_status

#: Verdicts, issues, and the provisional risk of a verdict as (level, priority).
VERDICTS = ["covered", "partial", "missing"]
ISSUES = ["none", "not_addressed", "weaker_threshold", "narrower_scope", "optional_not_mandatory", "conflicting_statements", "outdated_requirement", "no_owner_or_evidence", "stricter_than_required"]
PROVISIONAL = {"missing": ("high", 0.8), "partial": ("medium", 0.5), "covered": ("low", 0.2)}


def gated(answers: DataFrame, obligations: DataFrame, candidates: DataFrame, issues: list[str] | None = None) -> DataFrame:
    """One row for each usable answer, and one for each obligation without any: obligation, verdict, issue, control, confidence, citation_ok, gap_type, unclear.

    ``answers``: obligation, verdict, issue, control, control_quote_start, confidence. ``obligations``: id,
    modality, candidates (ranked controls). ``candidates``: control, quote. Answers on unknown obligations go.
    A verdict or issue of another name, and an obligation left out, becomes an unspecified gap for review. A
    missing control is cleared; an unknown one is replaced by the first candidate, without citation; without
    candidate the verdict is missing. The citation is good where the quote's start lies in the control's text.
    """
    asked = obligations.select(F.col("id").alias("obligation"), "modality", F.get("candidates", 0).alias("top"))
    both = asked.join(answers, "obligation", "left").join(candidates.select("control", F.col("quote").alias("control_text")), "control", "left")
    given = F.col("verdict").isNotNull() | F.col("issue").isNotNull()
    usable = F.col("verdict").isin(VERDICTS) & F.col("issue").isin(ISSUES if issues is None else issues)
    why = F.when(~given, "no answer").when(~F.coalesce(usable, F.lit(False)), F.concat(F.lit("verdict "), F.coalesce("verdict", F.lit("none")), F.lit(", issue "), F.coalesce("issue", F.lit("none"))))
    known = F.col("control_text").isNotNull()
    first = both.withColumn("unclear", why)
    unclear = F.col("unclear").isNotNull()
    control = F.when(unclear, F.col("top")).when(F.col("verdict") == "missing", F.lit(None)).when(known, F.col("control")).otherwise(F.col("top"))
    cited = located(F.col("control_text"), F.coalesce("control_quote_start", F.lit(""))).isNotNull()
    ok = F.when(unclear, False).when(F.col("verdict") == "missing", True).otherwise(known & F.coalesce(cited, F.lit(False)))
    second = first.withColumns({"named": control, "citation_ok": ok})
    nothing = ~unclear & (F.col("verdict") != "missing") & F.col("named").isNull()
    verdict = F.when(unclear, "partial").when(nothing, "missing").otherwise(F.col("verdict"))
    third = second.select("obligation", "modality", verdict.alias("verdict"), F.when(unclear, "unclear").otherwise(F.col("issue")).alias("issue"), F.col("named").alias("control"), F.when(unclear, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence").cast("double")))).alias("confidence"), (F.col("citation_ok") & ~nothing).alias("citation_ok"), "unclear")
    kind = F.when(F.col("unclear").isNotNull(), "unspecified").otherwise(gap_type(F.col("verdict"), F.col("issue"), F.col("modality")))
    return third.withColumn("gap_type", kind).select("obligation", "verdict", "issue", "control", "confidence", "citation_ok", "gap_type", "unclear")


def mappings(results: DataFrame) -> DataFrame:
    """Rows (obligation, control, verdict, confidence, status) of gated ``results``."""
    return results.select("obligation", "control", "verdict", "confidence", mapping_status(F.col("citation_ok"), F.col("confidence")).alias("status"))


def emitted_gaps(results: DataFrame, levels: DataFrame) -> DataFrame:
    """Gaps of gated ``results``: obligation, control, gap_type, inherent, priority, tier, check; only of obligations at policy level (``levels``: obligation, level; no row is policy).

    An unclear answer is an unspecified gap of medium risk and priority 0.5 in the review tier.
    """
    rows = results.join(levels, "obligation", "left").where((F.coalesce("level", F.lit("policy")) == "policy") & F.col("gap_type").isNotNull())
    level, priority = F.lit("medium"), F.lit(0.5)
    for verdict, (name, value) in PROVISIONAL.items():
        level = F.when(F.col("verdict") == verdict, name).otherwise(level)
        priority = F.when(F.col("verdict") == verdict, value).otherwise(priority)
    unclear = F.col("unclear").isNotNull()
    return rows.select("obligation", "control", "gap_type", F.when(unclear, "medium").otherwise(level).alias("inherent"), F.when(unclear, 0.5).otherwise(priority).alias("priority"), F.when(unclear, "review").alias("tier"), F.when(unclear, "judge_unclear").alias("check"))


def retiered(gaps: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``gaps`` (key, gap_type, control, tier, ...) after ``changes`` (key, gap_type, control, tier, check): a null keeps the old value, and what the judge said stays in judge_type and judge_control."""
    new = changes.select(key, F.col("gap_type").alias("n_type"), F.col("control").alias("n_control"), F.col("tier").alias("n_tier"), F.col("check").alias("n_check"), F.lit(True).alias("changed"))
    both = gaps.join(new, key, "left")
    kept = [c for c in gaps.columns if c not in ("gap_type", "control", "tier", "check")]
    return both.select(
        *kept, F.coalesce("n_type", "gap_type").alias("gap_type"), F.coalesce("n_control", "control").alias("control"), F.coalesce("n_tier", "tier").alias("tier"), F.coalesce("n_check", "check").alias("check"),
        F.when(F.col("changed"), F.col("gap_type")).alias("judge_type"), F.when(F.col("changed"), F.col("control")).alias("judge_control"),
    )


def candidate_text(objective: Column, quote: Column) -> Column:
    """The text by which a control is looked up: its objective, if it has one, before its quote."""
    return F.when(F.trim(F.coalesce(objective, F.lit(""))) == "", quote).otherwise(F.concat(objective, F.lit(". "), quote))


def with_levels(obligations: DataFrame, levels: DataFrame) -> DataFrame:
    """``obligations`` (s, e, action) with the level of ``levels`` (key, level) by the stable key start:end:action, policy where it has none."""
    key = F.concat_ws(":", F.col("s").cast("string"), F.col("e").cast("string"), "action")
    return obligations.withColumn("key", key).join(levels.select("key", "level"), "key", "left").withColumn("level", F.coalesce("level", F.lit("policy"))).drop("key")
