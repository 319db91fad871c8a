"""Scan for sentences that try to instruct an automated reader, and its merge with flags from elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import places

#: Who reads, how, and the rules' names and patterns.
READER = r"(?:ai|a\.i\.|artificial intelligence|(?:large )?language model|llm|chatbot|assistant|model|bot|agent|algorithm|automated\s+(?:\w+\s+)?(?:checker|reviewer|reader|tool|agent|system|assessor|analy[sz]er|process|pipeline)|(?:compliance|review|audit)\s+(?:tool|software|engine))"
READING = r"(?:reading|processing|reviewing|analy[sz]ing|assessing|checking|evaluating|parsing|scanning)"
RULES = {
    "override": r"(?i)\b(?:ignore|disregard|forget|override)\b[^.\n]{0,40}\b(?:previous|prior|above|earlier|all|any|your)\b[^.\n]{0,30}\b(?:instruction|prompt|rule|guideline|direction)s?\b",
    "addressed_reader": rf"(?i)\b{READER}\b[^.\n]{{0,80}}\b{READING}\s+this\b",
    "instruction_label": rf"(?i)\b(?:instruction|note|message|directive|command|attention)s?\s*(?:for|to|:)\s*(?:any|the|an?|all)?\s*{READER}\b",
    "steer_verdict": r"(?i)\b(?:mark|treat|classify|rate|report|consider|deem|score|label|record|certify)\b[^.\n]{0,80}\bas\s+(?:fully\s+|being\s+)?(?:compliant|covered|satisfied|met|passed|complete|no\s+gaps?)\b",
    "suppress": r"(?i)\bdo\s+not\s+(?:flag|raise|list|report|mention|record|identify)\b[^.\n]{0,60}\b(?:gap|exception|finding|issue|deficienc\w*|non-?compliance|violation)s?\b",
    "role": r"(?i)\b(?:system prompt|you are now|as an ai\b|new instructions?\s*:)",
}


def scan(documents: DataFrame, key: list[str], text: str, rules: dict[str, str] | None = None) -> DataFrame:
    """Rows (key..., char_start, sentence, rules): one for each sentence that a rule matches, rule names in order joined by +.

    A sentence reaches from behind the last full stop or line break before the match to the first after it.
    """
    table = RULES if rules is None else rules
    content = F.coalesce(F.col(text), F.lit(""))

    def hits_of(name: str, pattern: str) -> Column:
        return F.transform(places(content, pattern), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.lit(name).alias("rule")))

    hits = F.flatten(F.array(*[hits_of(*rule) for rule in table.items()]))
    each = documents.where(content.rlike("|".join(f"(?:{p})" for p in table.values()))).select(*key, content.alias("__text"), F.explode(hits).alias("m"))
    before = F.substring("__text", F.lit(1), F.col("m.s"))
    a = F.col("m.s") - F.length(F.regexp_extract(before, r"[^.\n]*\z", 0))
    rest = F.substring(F.col("__text"), F.col("m.e") + 1, F.length("__text"))
    b = F.col("m.e") + F.length(F.regexp_extract(rest, r"\A[^.\n]*[.\n]?", 0))
    placed = each.select(*key, F.substring(F.col("__text"), a + 1, b - a).alias("raw"), a.alias("a"), F.col("m.rule").alias("rule"))
    indent = F.length(F.regexp_extract("raw", r"\A\s*", 0))
    named = placed.select(*key, (F.col("a") + indent).cast("bigint").alias("char_start"), F.regexp_replace("raw", r"\A\s+|\s+\z", "").alias("sentence"), "rule")
    return named.groupBy(*key, "char_start", "sentence").agg(F.array_join(F.array_sort(F.collect_set("rule")), "+").alias("rules"))


def merged_flags(flags: DataFrame, scanned: DataFrame, key: list[str]) -> DataFrame:
    """``flags`` (key..., s, e, text) and those of ``scanned`` (key..., char_start, sentence) that overlap none of them, with by = model or scan."""
    found = scanned.select(*key, F.col("char_start").cast("bigint").alias("s"), (F.col("char_start") + F.length("sentence")).cast("bigint").alias("e"), F.col("sentence").alias("text"))
    a, b = found.alias("a"), flags.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key] + [F.col("a.s") < F.col("b.e"), F.col("b.s") < F.col("a.e")]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    extra = a.join(b, condition, "left_anti")
    return flags.select(*key, F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"), "text", F.lit("model").alias("by")).unionByName(extra.withColumn("by", F.lit("scan")))
