"""Planted edits: applied to documents, with an answer key of where they lie."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import before_each, canonical

#: Edits of one run: a parameter, since one pattern of all of them is looked for in every document. More are refused.
MOST = 1000


def _any_of(phrases: list[str]) -> str:
    """A pattern of any of the phrases, the longest first, grouped by their first character."""
    by_first: dict[str, list[str]] = {}
    for p in sorted(set(phrases), key=lambda p: (-len(p), p)):
        by_first.setdefault(p[0], []).append(p)
    return "(?:" + "|".join(re.escape(c) + "(?:" + "|".join(re.escape(p[1:]) for p in group) + ")" for c, group in by_first.items()) + ")"


def _wanted(edits: DataFrame, most: int) -> list[Row]:
    clean = edits.select("edit_id", canonical(F.col("find")).alias("find"), canonical(F.coalesce("replacement", F.lit(""))).alias("replacement"), F.coalesce("every", F.lit(False)).alias("every"))
    rows = clean.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edits")
    return sorted(rows, key=lambda r: str(r["edit_id"]))


def checked(documents: DataFrame, edits: DataFrame, most: int = MOST) -> DataFrame:
    """``edits`` (edit_id, find, replacement, every) with total, the times that ``find`` occurs over all documents, and whether it may be applied.

    A phrase must occur exactly once, or once or more where ``every`` is set; occurrences that overlap count
    each, and a phrase without characters occurs nowhere. Each document is gone through once, whatever the
    number of edits, ``most`` at most.
    """
    rules = _wanted(edits, most)
    finds = [r["find"] for r in rules if r["find"]]
    wanted = edits.withColumns({"find": canonical(F.col("find")), "replacement": canonical(F.coalesce("replacement", F.lit("")))})
    if finds:
        # one match a place, the longest; shorter phrases that begin it are there too
        starts = {f: [r["edit_id"] for r in rules if r["find"] and f.startswith(r["find"])] for f in set(finds)}
        of = F.create_map(*[x for f, ids in starts.items() for x in (F.lit(f), F.array(*map(F.lit, ids)))])
        each = documents.select(F.explode(F.regexp_extract_all(canonical(F.col("text")), F.lit(f"(?=({_any_of(finds)}))"), F.lit(1))).alias("m"))
        counts = each.groupBy("m").agg(F.count("*").alias("n")).select(F.explode(of[F.col("m")]).alias("edit_id"), "n").groupBy("edit_id").agg(F.sum("n").alias("total"))
        both = wanted.join(counts, "edit_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    else:
        both = wanted.withColumn("total", F.lit(0).cast("bigint"))
    return both.withColumn("applies", F.when(F.coalesce("every", F.lit(False)), F.col("total") >= 1).otherwise(F.col("total") == 1))


def mutated(documents: DataFrame, edits: DataFrame, most: int = MOST) -> DataFrame:
    """Rows (doc_id, text, locations): documents (doc_id, text) in canonical form with the edits that apply.

    All edits are made on the original text, in one pass; where two phrases overlap, the one that begins
    first is replaced, the longer of two that begin together. locations lists (edit_id, start, length) of the
    new text, in the final text; a deletion has length 0 and takes the white space around it along. Of edits
    of one phrase the first by edit_id is made.
    """
    rules = [r for r in _wanted(checked(documents, edits, most).where("applies"), most) if r["find"]]
    rules = list({r["find"]: r for r in reversed(rules)}.values())
    text = canonical(F.col("text"))
    kind = "array<struct<edit_id:string,start:int,length:int>>"
    if not rules:
        return documents.select("doc_id", text.alias("text"), F.array().cast(kind).alias("locations"))
    gone, new = [r["find"] for r in rules if not r["replacement"]], [r["find"] for r in rules if r["replacement"]]
    pattern = "|".join([rf"\s*{_any_of(gone)}\s*"] * bool(gone) + [_any_of(new)] * bool(new))
    rule = F.create_map(*[x for r in rules for x in (F.lit(r["find"]), F.struct(F.lit(str(r["edit_id"])).alias("id"), F.lit(r["replacement"]).alias("new")))])
    rows = documents.select("doc_id", text.alias("text")).withColumns({"gaps": F.split("text", pattern, -1), "found": F.regexp_extract_all("text", F.lit(pattern), F.lit(0))})
    named = F.transform("found", lambda m: rule[F.trim(m)])
    # gap i stands before match i; what has no text before or behind it needs no space
    filled = F.concat(F.transform("gaps", lambda g, i: F.when(g != "", i - 0.5)), F.transform("rule", lambda x, i: F.when(x["new"] != "", i.cast("double"))))

    def glue(x: Column, i: Column) -> Column:
        """What stands for a match: its replacement, or a space between what is left on both sides."""
        again = (F.get("gaps", i) == "") & (i > 0) & (F.get("rule", i - 1)["new"] == "")
        edge = ~F.coalesce((F.col("filled.s") < i) & (i < F.col("filled.e")), F.lit(False))
        return F.when(x["new"] != "", x["new"]).when(again | edge, "").otherwise(" ")

    put = rows.withColumn("rule", named).withColumn("filled", F.struct(F.array_min(filled).alias("s"), F.array_max(filled).alias("e"))).withColumn("put", F.transform("rule", glue))
    starts = before_each(F.transform("put", lambda x, i: F.length(F.get("gaps", i)) + F.length(x)))

    def place(x: Column, i: Column) -> Column:
        own = F.get("rule", i)
        start = x + F.length(F.get("gaps", i)) + F.when(own["new"] == "", F.length(F.get("put", i))).otherwise(0)
        return F.struct(own["id"].alias("edit_id"), start.cast("int").alias("start"), F.length(own["new"]).alias("length"))

    whole = F.concat(F.array_join(F.zip_with(F.slice("gaps", 1, F.size("put")), F.col("put"), lambda a, b: F.concat(a, b)), ""), F.element_at("gaps", -1))
    return put.select("doc_id", whole.alias("text"), F.transform(starts, place).cast(kind).alias("locations"))


def answer_key(changed: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows (edit_id, doc_id, start, end, deleted_text): where each edit lies."""
    each = changed.select("doc_id", F.explode("locations").alias("x")).select(F.col("x.edit_id").alias("edit_id"), "doc_id", F.col("x.start").alias("start"), (F.col("x.start") + F.col("x.length")).alias("end"))
    deleted = edits.select(F.col("edit_id").cast("string").alias("edit_id"), F.when(F.coalesce("replacement", F.lit("")) == "", F.col("find")).alias("deleted_text"))
    return each.join(deleted, "edit_id")
