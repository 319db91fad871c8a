"""Scoring of findings against answer keys, sampling, and reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rules import confidence_band
from .spans import overlap_join, overlaps


def matches(keys: DataFrame, findings: DataFrame) -> DataFrame:
    """Rows (key_id, strict, near, tier): how each key row is met by the findings.

    ``keys``: key_id, refs, spans (array of struct s, e), gap_types, verdicts. ``findings``: id, ref, gap_type,
    verdict, s, e, tier. A finding of one of the key's references is near; it is strict when it also overlaps
    an edit, or the key has none, and its type or verdict is accepted.
    """
    wanted = keys.select("key_id", F.explode("refs").alias("ref"), "spans", "gap_types", "verdicts")
    pairs = wanted.join(findings, "ref", "left")
    placed = (F.size("spans") == 0) | F.exists("spans", lambda x: overlaps(x["s"], x["e"], F.col("s"), F.col("e")))
    accepted = F.array_contains("gap_types", F.col("gap_type")) | F.array_contains("verdicts", F.col("verdict"))
    near = F.col("id").isNotNull()
    strict = near & F.coalesce(placed & accepted, F.lit(False))
    return pairs.groupBy("key_id").agg(F.bool_or(strict).alias("strict"), F.bool_or(near).alias("near"), F.coalesce(F.bool_or(strict & (F.col("tier") == "high")), F.lit(False)).alias("high"))


def unkeyed(findings: DataFrame, keys: DataFrame) -> DataFrame:
    """Findings whose reference no key names."""
    return findings.join(keys.select(F.explode("refs").alias("ref")).distinct(), "ref", "left_anti")


def rates(rows: DataFrame, by: list[str], hit: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count("*").alias("total"))


def blind_sample(rows: DataFrame, key: str, n: int, seed: str, by: list[str] | None = None) -> DataFrame:
    """``n`` rows of each group in an order that depends on the seed and the key alone."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    rank = F.row_number().over(W.partitionBy(*(by or [])).orderBy(order, key))
    return rows.withColumn("sample_rank", rank).where(F.col("sample_rank") <= n)


def reliability(rows: DataFrame, confidence: Column, right: Column) -> DataFrame:
    """How often each band of confidence was right."""
    return rows.groupBy(confidence_band(confidence).alias("band")).agg(F.count_if(right).alias("right"), F.count("*").alias("known"))


def found_missed_extra(truth: DataFrame, found: DataFrame, by: str, ref: str) -> DataFrame:
    a = truth.select(by, ref).distinct().withColumn("in_truth", F.lit(True))
    b = found.select(by, ref).distinct().withColumn("in_found", F.lit(True))
    both = a.join(b, [by, ref], "full_outer")
    t, f = F.coalesce("in_truth", F.lit(False)), F.coalesce("in_found", F.lit(False))
    return both.groupBy(by).agg(F.count_if(t & f).alias("found"), F.count_if(t & ~f).alias("missed"), F.count_if(~t & f).alias("extra"))


# answer keys


def _own(keys: DataFrame) -> DataFrame:
    """A row for each of a key row's references."""
    return keys.select("policy", "key_id", "kind", "rule", F.explode(F.array_distinct("refs")).alias("ref"), "spans", "gap_types", "verdicts")


def _over(some: Column | str) -> Column:
    """Whether a finding (s, e) shares a character with one of some spans."""
    return F.coalesce(F.exists(some, lambda x: overlaps(F.col("s"), F.col("e"), x["s"], x["e"])), F.lit(False))


def _in_edit(spans: str) -> Column:
    edits = F.filter(spans, lambda x: x["e"] > x["s"])
    return (F.size(edits) == 0) | _over(edits)


def _met(findings: DataFrame, keys: DataFrame, how: Column) -> DataFrame:
    """The findings (policy, id) with a gap that meet a key row at one of its references so that ``how`` holds, each once."""
    own = _own(keys).select(F.col("policy").alias("__policy"), F.col("ref").alias("__ref"), "kind", "rule", "spans")
    at = (F.col("policy") == F.col("__policy")) & (F.col("ref") == F.col("__ref"))
    return findings.where("gap_type IS NOT NULL").join(own, at & how, "left_semi").select("policy", "id").distinct()


def _pairs(keys: DataFrame, findings: DataFrame) -> DataFrame:
    """Each key row with each finding at one of its references, of one policy, once: what they say and whether they meet in an edit or in any span.

    known: the finding, or one of the same id, is on a gap that is known to be real and counts neither way. Only
    findings are looked through for that, no pair is shuffled.
    """
    own = _own(keys)
    gap = F.col("gap_type").isNotNull()
    real = (F.col("kind") == "real_finding") & (F.col("rule") == "known_gap") & _over("spans")
    known = _met(findings, keys, real).withColumn("known", F.lit(True))
    marked = findings.join(known, ["policy", "id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return own.join(marked, ["policy", "ref"]).select(
        "policy", "key_id", "kind", "rule", "id", "known", gap.alias("gap"), F.coalesce("tier", F.lit("high")).alias("tier"), "gap_type",
        _in_edit("spans").alias("in_edit"), _over("spans").alias("in_span"),
        F.coalesce(F.array_contains("verdicts", F.col("verdict")), F.lit(False)).alias("verdict_ok"),
        F.coalesce(F.array_contains("gap_types", F.col("gap_type")) | F.array_contains("verdicts", F.col("verdict")), F.array_contains("gap_types", F.col("gap_type")), F.array_contains("verdicts", F.col("verdict")), F.lit(False)).alias("accepted"),
    )


def scored(keys: DataFrame, findings: DataFrame, flags: DataFrame) -> DataFrame:
    """One row for each key row: policy, key_id, kind, detected, typed, near_miss, tier, reported, outcome.

    ``keys``: policy, key_id, kind (mutation, decoy, injection, real_finding), rule, refs, spans (array of struct s,
    e), gap_types, verdicts. ``findings``: policy, id, ref, gap_type, verdict, s, e, tier. ``flags``: policy, s, e.
    Only findings with a gap meet planted rows: in an edit they are hits (anywhere, where the row has no edit),
    else near misses. Those on known real gaps are left out of all other rows. tier is the best of the hits, or of
    the near misses of a planted row. Injections are caught by a flag that overlaps an edit. Real findings have an outcome by rule.
    """
    pairs = _pairs(keys, findings)
    rest = ~F.col("known")
    strict, near = rest & F.col("gap") & F.col("in_edit"), rest & F.col("gap") & ~F.col("in_edit")
    best = lambda which: F.when(F.bool_or(which & (F.col("tier") == "high")), "high").when(F.bool_or(which), "review")
    seen = pairs.groupBy("policy", "key_id").agg(
        F.bool_or(strict).alias("strict"), F.bool_or(near).alias("near"), F.bool_or(strict & F.col("accepted")).alias("typed"), best(strict).alias("strict_tier"), best(near).alias("near_tier"),
        F.array_sort(F.collect_set(F.when(rest & F.col("gap"), F.col("gap_type")))).alias("reported"), F.bool_or(rest & F.col("gap")).alias("any_gap"), F.bool_and(F.when(rest, F.col("verdict_ok"))).alias("all_ok"), F.bool_or(rest).alias("assessed"),
        F.bool_or((F.col("rule") == "known_gap") & F.col("gap") & F.col("in_span")).alias("known"),
    )
    spots = keys.where("kind = 'injection'").select("policy", "key_id", F.explode("spans").alias("x")).select("policy", "key_id", F.col("x.s").alias("s"), F.col("x.e").alias("e")).where("e > s")
    caught = overlap_join(spots, flags.select("policy", "s", "e"), ["policy"]).select("policy", "key_id").distinct().withColumn("caught", F.lit(True))
    both = keys.select("policy", "key_id", "kind", "rule").join(seen, ["policy", "key_id"], "left").join(caught, ["policy", "key_id"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind, rule = F.col("kind"), F.col("rule")
    outcome = (
        F.when(kind != "real_finding", F.lit(None))
        .when(rule == "known_gap", F.when(yes("known"), "known gap reported").otherwise("not flagged"))
        .when(rule == "excluded", "excluded")
        .when(~yes("assessed"), "not assessed")
        .when(rule == "no_gap", F.when(yes("any_gap"), "false positive").otherwise("correct"))
        .when(rule == "accept_set", F.when(yes("all_ok"), "correct").otherwise("wrong"))
        .otherwise("pending")
    )
    planted = kind == "mutation"
    detected = F.when(planted | (kind == "decoy"), yes("strict")).when(kind == "injection", yes("caught"))
    tier = F.when(planted, F.coalesce("strict_tier", "near_tier")).when(kind == "decoy", F.col("strict_tier"))
    return both.select("policy", "key_id", "kind", detected.alias("detected"), F.when(planted, yes("typed")).alias("typed"), F.when(planted, yes("near") & ~yes("strict")).alias("near_miss"), tier.alias("tier"), F.when(planted, F.coalesce("reported", F.array())).alias("reported"), outcome.alias("outcome"))


def unkeyed_gaps(keys: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings with a gap that no key row accounts for: to be judged blind."""
    kind = F.col("kind")
    real = (kind == "real_finding") & (~F.col("rule").eqNullSafe("known_gap") | _over("spans"))
    counted = (kind == "mutation") | ((kind == "decoy") & _in_edit("spans")) | real
    return findings.where("gap_type IS NOT NULL").join(_met(findings, keys, counted), ["policy", "id"], "left_anti")


def score_card(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """One row a policy of counts over the rows of ``scored`` and ``unkeyed_gaps``: planted, found, typed and near ones, decoys, injections, real findings, and each by tier."""
    is_ = lambda kind: F.col("kind") == kind
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    tiers = [n(is_(k) & hit & (F.col("tier") == t)).alias(f"{name}_{t}") for t in ("high", "review") for k, name, hit in (("mutation", "planted", F.col("detected") | F.col("near_miss")), ("decoy", "decoys", F.col("detected")))]
    card = rows.groupBy("policy").agg(
        n(is_("mutation")).alias("planted"), n(is_("mutation") & F.col("detected")).alias("found"), n(F.col("typed")).alias("typed"), n(F.col("near_miss")).alias("near"),
        n(is_("decoy")).alias("decoys"), n(is_("decoy") & F.col("detected")).alias("decoys_flagged"), n(is_("injection")).alias("injections"), n(is_("injection") & F.col("detected")).alias("injections_caught"),
        n(F.col("outcome") == "correct").alias("real_correct"), n(is_("real_finding") & ~F.col("outcome").isin("excluded", "known gap reported", "not flagged")).alias("real"), *tiers,
    )
    left = extra.groupBy("policy").agg(F.count("*").alias("unkeyed"))
    return card.join(left, "policy", "left").na.fill(0, ["unkeyed"])


def evidence_scored(keys: DataFrame, results: DataFrame, failing: DataFrame) -> DataFrame:
    """Rows (key_id, got, has_gap, right): the result of the first reference that was tested, and whether any has an operating failure.

    ``keys``: key_id, kind, refs, expected; rows of kind evidence must have a gap, others none. ``results``: ref,
    result, one row each; ``failing``: ref.
    """
    each = keys.select("key_id", F.posexplode("refs").alias("place", "ref")).join(results.select("ref", "result"), "ref", "left").join(failing.select("ref").distinct().withColumn("failed", F.lit(True)), "ref", "left")
    got = each.groupBy("key_id").agg(F.min_by("result", F.when(F.col("result").isNotNull(), F.col("place"))).alias("got"), F.coalesce(F.bool_or("failed"), F.lit(False)).alias("has_gap"))
    both = keys.select("key_id", "kind", "expected").join(got, "key_id", "left")
    named = both.select("key_id", F.coalesce("got", F.lit("not tested")).alias("got"), F.coalesce("has_gap", F.lit(False)).alias("has_gap"), "kind", "expected")
    return named.select("key_id", "got", "has_gap", ((F.col("got") == F.col("expected")) & (F.col("has_gap") == (F.col("kind") == "evidence"))).alias("right"))
