"""Change between two versions: clause alignment, effect, scope, plan and the difference in gaps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.text import defined_term, is_positional, under, uses_term

#: Least similarity of a renumbered clause and of an edited one in its place; the blast limit.
RENUMBERED, IN_PLACE, BLAST_LIMIT = 0.9, 0.6, 0.2
#: Words of duty and of permission, numbers.
DUTY = r"(?i)\b(shall|must|required to|is to|are to|not permitted|prohibited)\b"
MAY = r"(?i)\bmay\b(?!\s+not\b)"
NUMBER = r"(?i)\b\d[\d,.]*%?|\b(?:one|two|three|four|five|six|seven|eight|nine|ten|fifteen|twenty|thirty|fifty|hundred|thousand|lakh|crore)\b"


def same_place(old: DataFrame, new: DataFrame, key: Column | None = None) -> DataFrame:
    """First two phases of the alignment of ``old`` and ``new`` (doc, ref, pos, text): rows (doc, change, old_ref, new_ref, old_text, new_text).

    Clauses of one reference that says more than a place, then clauses known by place only whose comparison
    key is equal, in order. What is left comes as new or repealed.
    """
    make = (N.diff_key("text") if key is None else key).alias("key")
    old, new = (d.select("doc", "ref", "pos", "text", make) for d in (old, new))
    named = lambda d: d.where(~is_positional(F.col("ref"))).withColumn("by", F.concat(F.lit("r:"), "ref"))
    nth = F.row_number().over(W.partitionBy("doc", "key").orderBy("pos", "ref"))
    placed = lambda d: d.where(is_positional(F.col("ref"))).withColumn("by", F.concat_ws(":", F.lit("k"), F.sha2("key", 256), nth))
    a, b = named(old).unionByName(placed(old)), named(new).unionByName(placed(new))
    left = a.select("doc", "by", F.col("ref").alias("old_ref"), F.col("text").alias("old_text"), F.col("key").alias("old_key"), F.col("pos").alias("old_pos"))
    right = b.select("doc", "by", F.col("ref").alias("new_ref"), F.col("text").alias("new_text"), F.col("key").alias("new_key"), F.col("pos").alias("new_pos"))
    both = left.join(right, ["doc", "by"], "full_outer")
    change = (
        F.when(F.col("old_ref").isNull(), "new").when(F.col("new_ref").isNull(), "repealed").when(F.col("old_text") == F.col("new_text"), "unchanged").when(F.col("old_key") == F.col("new_key"), "cosmetic").otherwise("modified")
    )
    return both.select("doc", change.alias("change"), "old_ref", "new_ref", "old_text", "new_text", "old_key", "new_key", "old_pos", "new_pos")


def align(old: DataFrame, new: DataFrame) -> DataFrame:
    """The whole alignment: rows (doc, change, old_ref, new_ref, old_text, new_text, similarity).

    After same_place, what is left of a document is matched in the new version's order, each clause with the
    most similar one that is still free: 0.9 at least, or 0.6 between clauses known by place. Pairs too unlike
    in length to reach that are never compared.
    """
    first = same_place(old, new)
    settled = first.where("change NOT IN ('new', 'repealed')")
    score = F.when(F.col("change") == "modified", N.similarity("old_key", "new_key")).otherwise(F.lit(1.0))
    done = settled.select("doc", "change", "old_ref", "new_ref", "old_text", "new_text", score.alias("similarity"))
    gone = first.where("change = 'repealed'").select("doc", "old_ref", "old_text", "old_key", "old_pos")
    came = first.where("change = 'new'").select("doc", "new_ref", "new_text", "new_key", "new_pos")
    short, long = F.least(F.length("old_key"), F.length("new_key")), F.greatest(F.length("old_key"), F.length("new_key"))
    pairs = gone.join(came, "doc").where(2 * short >= IN_PLACE * (short + long)).withColumn("similarity", N.similarity("old_key", "new_key"))
    loose = is_positional(F.col("old_ref")) & is_positional(F.col("new_ref"))
    good = pairs.where((F.col("similarity") >= RENUMBERED) | (loose & (F.col("similarity") >= IN_PLACE))).select("doc", "old_ref", "new_ref", "old_pos", "new_pos", "similarity")

    def choose(batch: pd.DataFrame) -> pd.DataFrame:
        """Greedy, strict matches of all clauses before loose ones."""
        used_old, used_new, out = set(), set(), []
        for low, high in ((RENUMBERED, 2.0), (IN_PLACE, RENUMBERED)):
            part = batch[(batch.similarity >= low) & (batch.similarity < high)].sort_values(["new_pos", "similarity", "old_pos"], ascending=[True, False, True])
            for r in part.itertuples():
                if r.old_ref not in used_old and r.new_ref not in used_new:
                    used_old.add(r.old_ref)
                    used_new.add(r.new_ref)
                    out.append((r.doc, r.old_ref, r.new_ref, r.similarity))
        return pd.DataFrame(out, columns=["doc", "old_ref", "new_ref", "similarity"])

    kind = dict(gone.dtypes)["doc"]
    chosen = good.groupBy("doc").applyInPandas(choose, f"doc {kind}, old_ref string, new_ref string, similarity double")
    matched = chosen.join(gone, ["doc", "old_ref"]).join(came, ["doc", "new_ref"])
    renamed = matched.select("doc", F.when(F.col("old_key") == F.col("new_key"), "cosmetic").otherwise("modified").alias("change"), "old_ref", "new_ref", "old_text", "new_text", "similarity")
    none = F.lit(None).cast("string")
    repealed = gone.join(chosen, ["doc", "old_ref"], "left_anti").select("doc", F.lit("repealed").alias("change"), "old_ref", none.alias("new_ref"), "old_text", none.alias("new_text"), F.lit(0.0).alias("similarity"))
    new_ones = came.join(chosen, ["doc", "new_ref"], "left_anti").select("doc", F.lit("new").alias("change"), none.alias("old_ref"), "new_ref", none.alias("old_text"), "new_text", F.lit(0.0).alias("similarity"))
    return done.unionByName(renamed).unionByName(repealed).unionByName(new_ones)


def classify(changes: DataFrame) -> DataFrame:
    """``changes`` with added, removed, defined_term, effect and reanalyse."""
    d = N.delta(F.coalesce("old_text", F.lit("")), F.coalesce("new_text", F.lit("")))
    with_delta = changes.withColumn("d", d).withColumns({"added": F.when(F.col("change") == "repealed", "").otherwise(F.col("d.added")), "removed": F.col("d.removed")}).drop("d")
    found = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(NUMBER), F.lit(0))))
    # an insertion without a modal of its own takes that of its sentence
    holder = F.filter(F.split("new_text", r"\. |;"), lambda s: (F.col("added") != "") & s.contains(F.split("added", " … ")[0]))
    duty = F.col("added").rlike(DUTY) | (~F.col("added").rlike(MAY) & F.exists(holder, lambda s: s.rlike(DUTY)))
    may = F.col("added").rlike(MAY) | F.exists(holder, lambda s: s.rlike(MAY))
    numbers_changed = found(F.col("added")) != found(F.col("removed"))
    lost = F.col("removed").rlike(DUTY)
    effect = (
        F.when(F.col("change") == "repealed", "repealed")
        .when(lost & (F.trim("added") == ""), "relaxed")
        .when(F.coalesce(duty, F.lit(False)), F.when(numbers_changed & (F.col("removed") != ""), "threshold").otherwise("new_duty"))
        .when(F.coalesce(may, F.lit(False)) & ~lost, "advisory")
        .when(numbers_changed, "threshold")
        .otherwise("wording")
    )
    out = with_delta.withColumns({"effect": effect, "defined_term": defined_term(F.coalesce("new_text", "old_text"))})
    return out.withColumn("reanalyse", F.col("effect") != "advisory")


def scope(changes: DataFrame, obligations: DataFrame) -> DataFrame:
    """Rows (id, reason, change_no): obligations that a change reaches, directly or by a defined term; the first change in order counts.

    ``changes``: change_no, ref, defined_term. ``obligations``: id, ref, text. References are joined by their
    ancestors, and terms are met by texts that have their first word, in one of its forms: no pair is compared
    without an equal key.
    """
    parts = F.transform(F.sequence(F.lit(1), F.size(F.split("ref", r"\("))), lambda i: F.array_join(F.slice(F.split("ref", r"\("), 1, i), "("))
    up = obligations.select("id", F.explode(parts).alias("ref"))
    direct = up.join(changes.select("change_no", "ref"), "ref").select("id", "change_no", F.lit("direct").alias("reason"))
    terms = changes.where("defined_term IS NOT NULL").select("change_no", "defined_term", F.col("ref").alias("c_ref"))
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    # a term's only word may stand in the plural
    forms = F.array_distinct(F.flatten(F.transform(words(F.col("text")), lambda w: F.array(w, F.regexp_replace(w, "s$", ""), F.regexp_replace(w, "es$", "")))))
    keyed = terms.withColumn("word", F.get(words(F.col("defined_term")), 0)).where("word IS NOT NULL")
    met = obligations.select("id", "ref", "text", F.explode(forms).alias("word")).join(keyed, "word")
    by_term = met.where(uses_term(F.col("text"), F.col("defined_term")) & ~under(F.col("ref"), F.col("c_ref"))).select("id", "change_no", F.lit("by_definition").alias("reason"))
    return direct.unionByName(by_term).groupBy("id").agg(F.min_by("reason", "change_no").alias("reason"), F.min("change_no").alias("change_no"))


def blast_radius(scoped: DataFrame, mappings: DataFrame, limit: float = BLAST_LIMIT) -> DataFrame:
    """One row (in_scope, total, blast_radius, needs_approval) over ``mappings`` (id, obligation_id)."""
    hit = mappings.join(scoped.select(F.col("id").alias("obligation_id"), F.lit(1).alias("hit")), "obligation_id", "left")
    counted = hit.agg(F.count("hit").alias("in_scope"), F.count("*").alias("total"))
    share = F.when(F.col("total") > 0, F.col("in_scope") / F.col("total")).otherwise(0.0)
    return counted.withColumn("blast_radius", F.round(share, 6)).withColumn("needs_approval", share > limit)


def plan(changes: DataFrame) -> DataFrame:
    """What each change asks for."""
    step = F.when(F.col("effect") == "advisory", "advise").when(F.col("effect") == "repealed", "retire").otherwise("re_extract")
    return changes.withColumn("step", step)


def gap_delta(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows (key..., outcome): gaps (key, gap_type, verdict) opened, closed, changed in type, the same, or to review."""
    a = before.select(*key, F.col("gap_type").alias("was"), F.lit(True).alias("had"))
    b = after.select(*key, F.col("gap_type").alias("now"), "verdict", F.lit(True).alias("has"))
    both = a.join(b, key, "full_outer")
    outcome = (
        F.when(F.col("has").isNull(), "retired")
        .when(F.col("verdict").isNull(), "review")
        .when(F.col("now").isNotNull() & F.col("was").isNull(), "opened")
        .when(F.col("now").isNull() & F.col("was").isNotNull(), F.when(F.col("verdict") == "covered", "closed").otherwise("review"))
        .when(F.col("now") != F.col("was"), "type_changed")
        .otherwise("same")
    )
    return both.select(*key, outcome.alias("outcome"))
