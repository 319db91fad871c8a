"""Records around findings: citations of a text, catalogues of sources, links to key rows, truths by precedence, back-fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import small
from ..functions.text import action_key, before_each, folded, located, located_as, once

#: From a place in a text to its sentence's end: a full stop or semicolon before white space or the end, else the line's end.
SENTENCE_FROM = r"^[^.;\n]*(?:[.;]+[^ \t\n\r\f.;][^.;\n]*)*[.;]*"


def gated(items: DataFrame, document: str, item: str, text: str, quote: str, action: str) -> DataFrame:
    """``items`` with s, e and outcome: the sentence that the quote opens, verbatim in the text.

    rejected: the quote isn't in the text. duplicate: an earlier item of the document has the same span and
    action. kept: all others.
    """
    placed = items.withColumn("__at", located(F.col(text), F.col(quote)))
    tail = F.substring(F.col(text), F.col("__at.s") + 1, F.length(F.col(text)))
    spans = placed.withColumns({"s": F.col("__at.s").cast("bigint"), "e": (F.col("__at.s") + F.length(F.regexp_extract(tail, SENTENCE_FROM, 0))).cast("bigint")})
    n = F.row_number().over(W.partitionBy(document, "s", "e", action_key(F.col(action))).orderBy(item))
    return spans.withColumn("outcome", F.when(F.col("s").isNull(), "rejected").when(n > 1, "duplicate").otherwise("kept")).drop("__at")


def cited(items: DataFrame, document: str, item: str, text: str, quote: str, action: str) -> DataFrame:
    """``items`` with s, e, kind, lead_in and outcome: the sentence that the quote begins, to the first end of a sentence behind the quote.

    The quote is found as it is, or normalised (``located_as``). Where the sentence only leads in to a list,
    the citation moves to the line that states the action, and lead_in keeps the sentence. Outcomes are those of ``gated``.
    """
    placed = items.withColumn("__at", located_as(F.col(text), F.col(quote)))
    tail = F.substring(F.col(text), F.col("__at.e") + 1, F.length(F.col(text)))
    whole = placed.withColumns({"__s": F.col("__at.s"), "__e": F.col("__at.e") + F.length(F.regexp_extract(tail, SENTENCE_FROM, 0))})
    moved = whole.withColumn("__item", list_item_for(F.col(text), F.col("__s"), F.col("__e"), F.col(action)))
    sentence = F.substring(F.col(text), F.col("__s") + 1, F.col("__e") - F.col("__s"))
    spans = moved.withColumns({"s": F.coalesce("__item.s", "__s").cast("bigint"), "e": F.coalesce("__item.e", "__e").cast("bigint"), "kind": F.col("__at.kind"), "lead_in": F.when(F.col("__item").isNotNull(), sentence)})
    n = F.row_number().over(W.partitionBy(document, "s", "e", action_key(F.col(action))).orderBy(item))
    return spans.withColumn("outcome", F.when(F.col("s").isNull(), "rejected").when(n > 1, "duplicate").otherwise("kept")).drop("__at", "__s", "__e", "__item")


# sources


def inherited(entries: DataFrame, document: str, order: list[str], columns: list[str]) -> DataFrame:
    """``entries`` with what one leaves open taken from its document's first entry."""
    first = W.partitionBy(document).orderBy(*order)
    return entries.withColumns({c: F.coalesce(F.col(c), F.first(c).over(first)) for c in columns})


def preferred_file(files: Column, ending: str = ".html") -> Column:
    """The first file with this ending, else the first, else null."""
    return F.coalesce(F.get(F.filter(files, lambda f: F.endswith(f, F.lit(ending))), 0), F.get(files, 0))


def backfilled(table: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``table`` with the values that ``updates``, one row a key, brings for ``columns``; null brings none."""
    new = updates.select(key, *[F.col(c).alias(f"__new_{c}") for c in columns])
    value = lambda c: F.coalesce(f"__new_{c}", c).alias(c) if c in columns else F.col(c)
    return table.join(new, key, "left").select(*map(value, table.columns))


# links and truths


def linked(keys: DataFrame, rows: DataFrame, key_id: str, row_id: str, span: list[str], action: str, ref: str) -> DataFrame:
    """Rows (key_id, row_id, level): the row of a key's exact span and action, else the only one of its span, else the only one of its action and reference.

    Three groupings of ``rows``, each one row a key, so that no pair is enumerated.
    """
    exact = rows.groupBy(*span, action).agg(F.min(row_id).alias("__exact"))
    only = lambda by, name: rows.groupBy(*by).agg(F.count("*").alias("__n"), F.min(row_id).alias(name)).where("__n = 1").drop("__n")
    found = keys.join(exact, [*span, action], "left").join(only(span, "__span"), span, "left").join(only([action, ref], "__ref"), [action, ref], "left")
    level = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__span").isNotNull(), "span").when(F.col("__ref").isNotNull(), "action_ref").otherwise("none")
    return found.select(key_id, F.coalesce("__exact", "__span", "__ref").alias(row_id), level.alias("level"))


def truths(assignments: DataFrame, key: str, priority: Column, order: str, columns: list[str]) -> DataFrame:
    """One row a key: ``columns`` of the assignment with the smallest priority, of equal ones the first by ``order``."""
    best = F.min_by(F.struct(*columns), F.struct(priority.alias("p"), F.col(order).alias("o")))
    return assignments.groupBy(key).agg(best.alias("__best")).select(key, *[F.col(f"__best.{c}").alias(c) for c in columns])


def agreement(rows: DataFrame, by: list[str], first: Column, second: Column) -> DataFrame:
    """Counts of what two judges say alike and apart, and whether either ever says yes."""
    return rows.groupBy(*by).agg(
        F.count_if(first & second).alias("both"),
        F.count_if(first & ~second).alias("only_first"),
        F.count_if(~first & second).alias("only_second"),
        F.count_if(~first & ~second).alias("neither"),
        F.bool_or(first | second).alias("either"),
    )


def section_differences(before: DataFrame, after: DataFrame, section: str, value: str) -> DataFrame:
    """Rows (section, removed, added): how many values each section of a snapshot loses and gains, repeats counted."""
    n = lambda rows, name: rows.groupBy(section, value).agg(F.count("*").alias(name))
    both = n(before, "b").join(n(after, "a"), [section, value], "full_outer").na.fill(0, ["b", "a"])
    return both.groupBy(section).agg(F.sum(F.greatest(F.lit(0), F.col("b") - F.col("a"))).alias("removed"), F.sum(F.greatest(F.lit(0), F.col("a") - F.col("b"))).alias("added"))


def number_gaps(rows: DataFrame, by: str, number: str) -> DataFrame:
    """Rows (by, paragraphs, missing, repeated): the numbers that a document's paragraphs leave out of 1 to the last, in order, and how many come again."""
    grouped = rows.groupBy(by).agg(F.count("*").alias("paragraphs"), F.collect_set(number).alias("have"))
    missing = F.array_sort(F.array_except(F.sequence(F.lit(1), F.array_max("have")), F.col("have")))
    return grouped.select(by, "paragraphs", missing.alias("missing"), (F.col("paragraphs") - F.size("have")).alias("repeated"))


# quotes


def located_in(documents: DataFrame, quotes: DataFrame, document: str, text: str, quote_id: str, quote: str, words: int = 4, fold: bool = False, most: int = 100_000) -> DataFrame:
    """Rows (quote_id, document, s, e): the first place of each quote in each text that holds it; with ``fold`` also normalised, and the kind.

    A text that holds a quote holds ``words`` neighbouring words from within it, behind its first word, so that
    both meet in an equality join; shorter quotes, ``most`` of them at most, are looked for in every text.
    """
    same = folded if fold else (lambda c: c)
    cut = lambda c: F.filter(F.split(same(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    q = quotes.select(quote_id, quote, cut(F.col(quote)).alias("w"))
    # the last word may be part of a longer one in the text, or lose a full stop
    long = q.where(F.size("w") >= words + 2).select(quote_id, quote, F.array_join(F.slice("w", 2, words), " ").alias("key"))
    runs = lambda c: once(c, lambda w: F.when(F.size(w) >= words, F.transform(F.sequence(F.lit(1), F.size(w) - words + 1), lambda i: F.array_join(F.slice(w, i, words), " "))))
    keys = long.select("key").distinct()
    near = small(keys)
    d = documents.select(document, F.explode(F.array_distinct(runs(cut(F.col(text))))).alias("key")).join(keys if near is None else near, "key", "left_semi" if near is None else "inner")
    met = d.join(long, "key").select(document, quote_id, quote).join(documents.select(document, text), document)
    short = small(q.where(F.size("w") < words + 2).select(quote_id, quote), most)
    if short is None:
        raise ValueError(f"more than {most} quotes of a few words")
    both = met.select(quote_id, quote, document, text).unionByName(documents.select(document, text).join(short).select(quote_id, quote, document, text))
    place = located_as if fold else located
    at = both.select(quote_id, document, place(F.col(text), F.col(quote)).alias("x")).where("x IS NOT NULL")
    return at.select(quote_id, document, F.col("x.s").alias("s"), F.col("x.e").alias("e"), *([F.col("x.kind").alias("kind")] if fold else []))


def list_item_for(text: Column, start: Column, end: Column, action: Column) -> Column:
    """Struct (s, e) of the line behind a citation that ends in a colon which holds most of the action's words of four letters or more, half of them at least; the first of equal ones; null else."""
    tail = F.substring(text, end + 1, F.length(text))
    lines = F.split(tail, "\n")
    wanted = F.array_distinct(F.filter(F.split(F.lower(action), r"\W+"), lambda w: F.length(w) > 3))
    at = before_each(F.transform(lines, lambda x: F.length(x) + 1))
    bare = lambda x: F.regexp_replace(x, r"^\s+", "")
    start_of = lambda x, before: (end + before + F.length(x) - F.length(bare(x))).cast("int")
    scored = F.zip_with(lines, at, lambda x, before: F.struct((-F.size(F.array_intersect(wanted, F.split(F.lower(x), r"\W+")))).alias("missing"), start_of(x, before).alias("s"), (start_of(x, before) + F.length(F.regexp_replace(bare(x), r"\s+$", ""))).alias("e")))
    best = F.array_min(F.filter(scored, lambda x: (-2 * x["missing"] >= F.size(wanted)) & (x["e"] > x["s"])))
    opens = F.rtrim(F.substring(text, start + 1, end - start)).endswith(":") & (F.size(wanted) > 0)
    return F.when(opens & best.isNotNull(), F.struct(best["s"].alias("s"), best["e"].alias("e")))
