"""Decision tables as column expressions. Values are fixed by the domain; every table is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Gap type of a partial verdict's issue.
GAP_BY_ISSUE = {
    "not_addressed": "missing_control", "weaker_threshold": "weak_threshold", "narrower_scope": "narrow_scope", "optional_not_mandatory": "weak_modality",
    "conflicting_statements": "internal_contradiction", "outdated_requirement": "stale_control", "no_owner_or_evidence": "design_deficiency",
}
#: How much a gap type leaves open, the levels and the bounds of the product.
GAP_FACTORS = {"missing_control": 1.0, "internal_contradiction": 1.0, "operating_failure": 0.9, "weak_threshold": 0.8, "weak_modality": 0.8, "narrow_scope": 0.7, "stale_control": 0.6, "design_deficiency": 0.5, "unspecified": 0.5}
LEVELS = {"low": 1, "medium": 2, "high": 3, "critical": 4}
RESIDUAL_BOUNDS = {"critical": 3.5, "high": 2.4, "medium": 1.4, "low": 0.0}
#: Days until a remedy is due, owners, and what a reviewer's decision does (gap status, tier, verdict).
DUE_DAYS = {"critical": 30, "high": 60, "medium": 90, "low": 180}
OWNERS = {"operating_failure": "1LoD", "design_deficiency": "1LoD"}
DECISIONS = {"confirm": ("open", "high", None), "dismiss": ("closed", None, "covered"), "resolve": ("closed", None, None), "accept": ("accepted", None, None)}
#: Bands of a judge's confidence.
BANDS = [("1.00", 1.0), ("0.95 to 0.99", 0.95), ("0.80 to 0.94", 0.8), ("below 0.80", -1.0)]


def choose(value: Column, table: dict, default: Column | None = None) -> Column:
    """The table's entry for ``value``."""
    out = F.lit(None) if default is None else default
    for key, entry in table.items():
        out = F.when(value == key, F.lit(entry)).otherwise(out)
    return out


def gap_type(verdict: Column, issue: Column, modality: Column, by_issue: dict[str, str] | None = None) -> Column:
    partial = choose(issue, GAP_BY_ISSUE if by_issue is None else by_issue, F.lit("unspecified"))
    optional = F.when(~modality.eqNullSafe(F.lit("may")), "weak_modality")
    return (
        F.when(verdict == "missing", "missing_control")
        .when(issue == "optional_not_mandatory", optional)
        .when(verdict == "partial", partial)
        .when(issue == "no_owner_or_evidence", "design_deficiency")
    )


def mapping_status(citation_ok: Column, confidence: Column, least: float = 0.7) -> Column:
    return F.when(citation_ok & (confidence >= least), "auto").otherwise("escalated")


def level_after(level: Column, has_threshold: Column) -> Column:
    """A threshold is a policy's matter whatever the model said; so is what it left open."""
    known = F.when(level.isin("policy", "sop_system", "board"), level).otherwise("policy")
    return F.when((level == "sop_system") & has_threshold, "policy").otherwise(known)


def first_theme(text: Column, heading: Column, themes: list[tuple[str, str, str]], default: str = "medium") -> Column:
    """Struct (theme, level) of the first theme (name, level, pattern) found in the text, else in the heading."""
    out = F.struct(F.lit(None).cast("string").alias("theme"), F.lit(default).alias("level"))
    for where in (heading, text):
        for name, level, pattern in reversed(themes):
            out = F.when(F.coalesce(where, F.lit("")).rlike("(?i)" + pattern), F.struct(F.lit(name).alias("theme"), F.lit(level).alias("level"))).otherwise(out)
    return out


def risk(level: Column, gap: Column, factors: dict[str, float] | None = None) -> Column:
    """Struct (residual, priority) of an inherent level and a gap type."""
    table = GAP_FACTORS if factors is None else factors
    product = choose(level, LEVELS).cast("double") * choose(gap, table, F.lit(table["unspecified"]))
    residual = F.lit("low")
    for name, bound in sorted(RESIDUAL_BOUNDS.items(), key=lambda x: x[1]):
        residual = F.when(product >= bound, name).otherwise(residual)
    return F.struct(residual.alias("residual"), F.round(product / 4, 3).alias("priority"))


def tier(kind: Column, weaker: Column, has_gap: Column, technical: Column, overlap: Column, level: Column) -> Column:
    """Struct (tier, gap_type, rule) of a text comparison and the judge's finding; the first rule that holds decides."""
    out = lambda t, g, r: F.struct(F.lit(t).alias("tier"), F.lit(g).cast("string").alias("gap_type"), F.lit(r).alias("rule"))
    return (
        F.when((kind == "number_differs") & weaker, out("high", "weak_threshold", "number"))
        .when(kind == "number_differs", out("review", "weak_threshold", "number"))
        .when(has_gap & (kind == "same"), out("review", None, "same_text"))
        .when(has_gap & technical, out("review", None, "technical"))
        .when(~has_gap & (kind == "adds_words"), out("review", "narrow_scope", "adds_words"))
        .when(~has_gap & (kind == "optional") & (overlap >= 0.8), out("high", "weak_modality", "optional"))
        .when(~has_gap & (kind == "optional"), out("review", "weak_modality", "optional"))
        .when(has_gap & (level != "policy"), out("review", None, "level"))
        .when(has_gap, out("high", None, "judge"))
        .otherwise(out("none", None, "none"))
    )


def confidence_basis(verdict: Column, gap: Column, kind: Column, check: Column, direction: Column, has_test: Column) -> Column:
    """Which checks a finding rests on."""
    differs = kind.isin("number_differs", "optional", "adds_words")
    return (
        F.when(has_test | gap.eqNullSafe(F.lit("operating_failure")), "evidence_test")
        .when(check == "level", "procedure_level")
        .when(check == "technical", "technical_requirement")
        .when(differs & (check == "number") & ~direction.eqNullSafe(F.lit("weaker")), "number_not_weaker")
        .when(differs & (verdict != "covered"), "judge_and_text")
        .when(differs, "text_only")
        .when(kind == "same", "judge_contradicted")
        .otherwise("judge_only")
    )


def confidence_band(confidence: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, low in reversed(BANDS):
        out = F.when(confidence >= low, name).otherwise(out)
    return out


def due_date(residual: Column, today: Column) -> Column:
    return F.date_add(today, choose(residual, DUE_DAYS).cast("int"))


def owner(gap: Column) -> Column:
    return choose(gap, OWNERS, F.lit("2LoD"))


def review(gaps: DataFrame, decisions: DataFrame, gap_id: str = "gap_id") -> DataFrame:
    """``gaps`` (id, status, tier, verdict) after ``decisions`` (id, decision, reviewer, reason); outcome says why one did not count."""
    both = gaps.join(decisions, gap_id, "left")
    known = F.col("decision").isin(*DECISIONS)
    named = (F.trim(F.coalesce("reviewer", F.lit(""))) != "") & (F.trim(F.coalesce("reason", F.lit(""))) != "")
    outcome = F.when(F.col("decision").isNull(), "none").when(~known, "unknown decision").when(~named, "reviewer and reason required").when(F.col("status") != "open", "not open").otherwise("applied")
    done = F.col("outcome") == "applied"
    field = lambda i: choose(F.col("decision"), {k: v[i] for k, v in DECISIONS.items() if v[i] is not None}, F.lit(None).cast("string"))
    after = {"status_after": (0, "status"), "tier_after": (1, "tier"), "verdict_after": (2, "verdict")}
    return both.withColumn("outcome", outcome).withColumns({name: F.when(done, F.coalesce(field(i), F.col(old))).otherwise(F.col(old)) for name, (i, old) in after.items()})


# applicability


def vocabulary_hits(texts: DataFrame, vocabulary: DataFrame, key: str, text: str, least_vocab_rows: int = 10_000) -> DataFrame:
    """Rows (key, attribute, value, at): the first whole-word mention of each vocabulary term; ``vocabulary``: ord, attribute, value, pattern.

    The vocabulary is a rule table; it is unrolled into the query after a check of its size.
    """
    rules = vocabulary.orderBy("ord").limit(least_vocab_rows + 1).collect()
    if len(rules) > least_vocab_rows:
        raise ValueError(f"the vocabulary has more than {least_vocab_rows} rows")
    found = F.filter(F.array(*[F.struct(F.lit(r["ord"]).alias("ord"), F.lit(r["attribute"]).alias("attribute"), F.lit(r["value"]).alias("value"), F.regexp_instr(F.col(text), F.lit(r["pattern"])).alias("at")) for r in rules]), lambda x: x["at"] > 0)
    return texts.select(key, F.explode(found).alias("h")).select(key, "h.ord", "h.attribute", "h.value", "h.at")


def profile(documents: DataFrame, vocabulary: DataFrame, owner_column: str, key: str, text: str, window: int = 160) -> DataFrame:
    """For each owner and vocabulary value, the first document that mentions it and ``window`` characters around."""
    hits = vocabulary_hits(documents, vocabulary, key, text).join(documents.select(key, owner_column, text), key)
    rank = W.partitionBy(owner_column, "attribute", "value").orderBy(key, "at")
    start = F.greatest(F.col("at") - window // 2, F.lit(1))
    return hits.withColumn("__n", F.row_number().over(rank)).where("__n = 1").select(owner_column, "attribute", "value", key, F.substring(F.col(text), start, F.lit(window)).alias("evidence"))


def applicable(hits: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Rows (key, answer, reason): yes where the profile has every value that a rule mentions, no where it offers none, else conditional.

    ``hits``: key, ord, attribute, value. ``facts``: attribute, value, state (has or not_offered).
    """
    known = hits.join(facts, ["attribute", "value"], "left").withColumn("state", F.coalesce("state", F.lit("unknown")))
    has = F.col("state") == "has"
    open_value = F.min_by(F.when(~has, F.concat_ws("=", "attribute", "value")), F.when(~has, F.col("ord")))
    grouped = known.groupBy(key).agg(F.every(has).alias("all_has"), F.every(F.col("state") == "not_offered").alias("none_offered"), open_value.alias("first_open"))
    answer = F.when(F.col("all_has"), "yes").when(F.col("none_offered"), "no").otherwise("conditional")
    return grouped.select(key, answer.alias("answer"), F.coalesce("first_open", F.lit("")).alias("reason"))


def without(facts: DataFrame, attribute: str, value: str) -> DataFrame:
    """The facts as they would be if one value were no longer offered."""
    this = (F.col("attribute") == attribute) & (F.col("value") == value) & (F.col("state") == "has")
    return facts.withColumn("state", F.when(this, "not_offered").otherwise(F.col("state")))
