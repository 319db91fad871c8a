"""Comparison of obligations with the policy sentences that restate them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.text import SENTENCE, body, content_words, force, light_stem, places, sentences, unordered_pairs
from ..session import settled
from .retrieve import windows, wording_matches
from .spans import deepest_at

#: Shares of word pairs that count as near verbatim, close and absent.
NEAR, CLOSE, ABSENT = 0.6, 0.5, 0.35


def compare(obligations: DataFrame, policies: DataFrame, key: str, stop: list[str] | None = None) -> DataFrame:
    """Rows (id, kind, share, window, missing, added): how the closest window of ``policies`` (key, text) differs from each obligation (id, quote, modality).

    In this order: no_similar_text, adds_words or loose below near verbatim, number_differs, optional,
    adds_words, same.
    """
    # one row an obligation: only the documents that hold these windows are cut into windows again
    best = settled(wording_matches(obligations, policies, "id", "quote", key, "text", 1, stop))
    text = windows(policies.join(best.select(key).distinct(), key, "left_semi"), key, "text").join(best.select(key, "ordinal").distinct(), [key, "ordinal"], "left_semi")
    paired = obligations.join(best, "id", "left").join(text, [key, "ordinal"], "left")
    sentence, window, share = body(F.col("quote")), F.coalesce("window", F.lit("")), F.coalesce("share", F.lit(0.0))
    own = paired.select("id", "modality", share.alias("share"), window.alias("window"), sentence.alias("sentence"))
    # numbers and phrases are worked out only where the wording is close
    near = own.where(F.col("share") >= CLOSE).withColumns({"required": N.numbers_of("sentence"), "stated": N.numbers_of("window"), "same_as": N.equivalents_of("window"), "added": N.inserted_between("sentence", "window")})
    far = own.where(F.col("share") < CLOSE)
    missing = F.array_except(F.array_except("required", "stated"), "same_as")
    optional = ~F.col("modality").eqNullSafe(F.lit("may")) & force(F.col("sentence")).eqNullSafe(F.lit("must")) & force(F.col("window")).eqNullSafe(F.lit("may"))
    grows = F.size("added") > 0
    kind = (
        F.when((F.col("share") < NEAR) & grows, "adds_words")
        .when(F.col("share") < NEAR, "loose")
        .when(F.size("missing") > 0, "number_differs")
        .when(optional, "optional")
        .when(grows, "adds_words")
        .otherwise("same")
    )
    close = near.withColumn("missing", missing).withColumn("kind", kind).select("id", "kind", "share", "window", "missing", "added")
    none = F.array().cast("array<string>")
    rest = far.select("id", F.when(F.col("share") < ABSENT, "no_similar_text").otherwise("loose").alias("kind"), "share", "window", none.alias("missing"), none.alias("added"))
    return close.unionByName(rest)


def swept(regulations: DataFrame, clauses: DataFrame, policies: DataFrame, key: str, stop: list[str] | None = None) -> DataFrame:
    """Rows (doc, s, e, ref, share, window, missing): every sentence of ``regulations`` (doc, text) that states a number which the closest policy window doesn't.

    Sentences of 40 characters, 6 content words and a number or more; ref is the deepest clause (``clauses``:
    doc, ref, s, e, depth) that holds the sentence's start.
    """
    each = regulations.select("doc", F.explode(places(F.coalesce("text", F.lit("")), SENTENCE)).alias("m")).select("doc", F.col("m.s").cast("bigint").alias("s"), F.col("m.e").cast("bigint").alias("e"), F.trim("m.m").alias("quote"))
    words = F.filter(content_words(F.col("quote"), stop), lambda w: w != "#")
    long = each.where((F.length("quote") >= 40) & (F.size(words) >= 6))
    stated = long.withColumn("n", F.size(N.numbers_of("quote"))).where("n > 0").drop("n")
    asked = stated.withColumns({"id": F.concat_ws(":", F.col("doc").cast("string"), F.col("s").cast("string")), "modality": F.lit("must")})
    differs = compare(asked.select("id", "quote", "modality"), policies, key, stop).where("kind = 'number_differs'")
    found = asked.select("id", "doc", "s", "e").join(differs, "id").select("doc", "s", "e", "share", "window", "missing")
    at = deepest_at(found.select("doc", F.col("s").alias("at")), clauses.select("doc", "ref", "s", "e", "depth"), ["doc"], "at", "at")
    return found.join(at.select("doc", F.col("at").alias("s"), "ref"), ["doc", "s"], "left")


def stated_quantities(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, ordinal, sentence, lead, dimension, value, grade, entity): periods and percentages, with the sentence before."""
    each = documents.select(key, F.posexplode(sentences(F.col(text))).alias("ordinal", "sentence"))
    led = each.withColumn("lead", F.coalesce(F.lag("sentence").over(W.partitionBy(key).orderBy("ordinal")), F.lit("")))
    return led.where(F.col("sentence").rlike(r"(?i)[0-9]|day|week|month|year|annual|quarterly|per\s*cent")).withColumn("all", N.quantities_of("sentence")).withColumn("q", F.explode("all")).select(key, "ordinal", "sentence", "lead", "q.*")


def conflicts(rules: DataFrame, policies: DataFrame, key: str, generic: list[str]) -> DataFrame:
    """Rows (rule_id, key, dimension, grade, entity, values): a policy gives a rule's quantity two or more values.

    A sentence restates a rule (rule_id, text) that shares a pair of neighbouring distinctive words with it or
    its lead-in, and half its own words.
    """
    words = lambda t: F.transform(F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0)), light_stem)
    own = lambda t: F.filter(words(t), lambda w: ~w.isin(generic))
    measured = rules.select("rule_id", "text", N.quantities_of("text").alias("all"))
    wanted = measured.select("rule_id", words(F.col("text")).alias("rule_words"), F.explode(unordered_pairs(own(F.col("text")))).alias("pair"), F.array_distinct("all.dimension").alias("dims"))
    said = stated_quantities(policies, key, "text")
    pairs = said.withColumns({"own": F.array_distinct(own(F.col("sentence"))), "pair": F.explode(unordered_pairs(own(F.concat_ws(" ", "lead", "sentence"))))})
    met = pairs.join(wanted, "pair").where(F.array_contains("dims", F.col("dimension")) & (F.size("own") >= 2) & (F.size(F.array_intersect("own", "rule_words")) >= 0.5 * F.size("own")))
    grouped = met.groupBy("rule_id", key, "dimension", "grade", "entity").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return grouped.where(F.size("values") > 1)
