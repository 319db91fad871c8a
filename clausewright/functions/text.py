"""Text functions as Spark columns. Lexicons are parameters; the defaults are fixed values of the domain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content.
STOP = [
    "the", "a", "an", "of", "to", "and", "or", "in", "for", "by", "on", "with", "as", "is", "be", "shall", "such", "that", "this", "any", "at", "from", "it", "its", "their", "which", "bank", "banks", "re", "res", "regulated", "entity", "entities", "may", "will", "should", "must",
]
#: Number words and scales.
UNITS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "ninety": 90,
}
SCALES = {"hundred": 100, "thousand": 1_000, "lakh": 100_000, "lakhs": 100_000, "crore": 10_000_000}
#: Duty and permission words.
DUTY = r"(?i)\b(shall|must|should|is required to|are required to|has to|have to)\b"
MAY = r"(?i)\bmay\b"
#: Fixed value: a list marker at the start of a sentence.
MARKER = r"(?i)^\s*(?:\(?[0-9ivxlc]{1,5}\)|[0-9]{1,3}\.|[a-z]{1,2}\)|[ivxlc]{1,5}\.|[a-z]\.)\s*"
#: Characters that count as another where quotes are compared.
FOLDED = {"{": "(", "[": "(", "}": ")", "]": ")", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "‑": "-"}
#: White space in texts and quotes.
BLANK = r"[\s\u00A0]"
#: A sentence: up to a full stop, a semicolon or a line's end.
SENTENCE = r"[^\n.;]+[.;]?"


def canonical(text: Column) -> Column:
    """White space, no-break spaces included, as single spaces; none at the ends."""
    return F.trim(F.regexp_replace(text, "[\\s\\u00A0]+", " "))


def body(quote: Column) -> Column:
    """A sentence without its list marker."""
    return F.trim(F.regexp_replace(F.coalesce(quote, F.lit("")), MARKER, ""))


def sentences(text: Column, least: int = 26) -> Column:
    """Sentences of ``least`` characters or more, white space around them not counted."""
    return F.filter(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.length(F.trim(s)) >= least)


def content_words(text: Column, stop: list[str] | None = None) -> Column:
    """Lower-case words but for stop words; every number, in digits or as a word, is "#"."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    numbers = F.array(*[F.lit(w) for w in [*UNITS, *SCALES]])
    kept = F.filter(words, lambda w: ~w.isin(STOP if stop is None else stop))
    return F.transform(kept, lambda w: F.when(w.rlike("^[0-9]") | F.array_contains(numbers, w), "#").otherwise(w))


def word_pairs(words: Column) -> Column:
    """Distinct pairs of neighbouring words, each joined by a space."""
    before, after = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.array_distinct(F.zip_with(before, after, lambda a, b: F.concat_ws(" ", a, b)))


def unordered_pairs(words: Column) -> Column:
    """Distinct pairs of different neighbouring words in either order."""
    before, after = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(before, after, lambda a, b: F.when(a != b, F.concat_ws(" ", F.least(a, b), F.greatest(a, b))))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def force(text: Column, duty: str = DUTY, may: str = MAY) -> Column:
    """ "must" for a duty, "may" for a permission, else null."""
    return F.when(text.rlike(duty), "must").when(text.rlike(may), "may")


def light_stem(word: Column) -> Column:
    """One spelling of -isation and -ise, no plural s."""
    z = F.replace(F.replace(F.replace(word, F.lit("isation"), F.lit("ization")), F.lit("ised"), F.lit("ized")), F.lit("ise"), F.lit("ize"))
    return F.when((F.length(z) > 3) & z.rlike("[^s]s$"), F.substring(z, F.lit(1), F.length(z) - 1)).otherwise(z)


def action_key(text: Column) -> Column:
    """Lower-case words joined by one space."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0)), " ")


def defined_term(text: Column) -> Column:
    """The quoted phrase that a definition opens with."""
    term = F.trim(F.regexp_extract(text, r"""^\W*\(?[\w.]*\)?\s*[‘'"“]([^’'"”]{2,80})[’'"”]""", 1))
    return F.when(term != "", term)


def marker_date(text: Column) -> Column:
    """The date of "with effect from <Month d, yyyy>", or null."""
    return F.try_to_date(F.regexp_extract(text, r"(?i)with effect from\s+([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})", 1), "MMMM d, yyyy")


def uses_term(text: Column, term: Column) -> Column:
    """Whether the text has the term as whole words, plural included, with any white space in it."""
    pattern = F.concat(F.lit(r"(?i)\b"), F.regexp_replace(F.regexp_replace(term, r"([\\.^$|?*+()\[\]{}])", r"\\$1"), r"\s+", r"\\s+"), F.lit(r"(s|es)?\b"))
    return F.regexp_like(F.coalesce(text, F.lit("")), pattern)


def is_positional(ref: Column) -> Column:
    """References that only say where a clause stands."""
    return ref.contains("~") | ref.rlike("^U[0-9]+$")


def under(ref: Column, clause: Column) -> Column:
    """Whether ``ref`` is ``clause`` or one of its bracketed sub-clauses."""
    return (ref == clause) | F.startswith(ref, F.concat(clause, F.lit("(")))


def no_condition(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("", "null", "none", "n/a", "nil"), F.lit(True))


def days_in_words(days: Column) -> Column:
    """730 as "2 years", 30 as "1 month", others in days."""
    unit = lambda n, name: F.concat(F.floor(days / n).cast("string"), F.lit(" "), F.when(days == n, name).otherwise(name + "s"))
    return F.when((days > 0) & (days % 365 == 0), unit(365, "year")).when((days > 0) & (days % 30 == 0), unit(30, "month")).otherwise(unit(1, "day"))


def located(text: Column, quote: Column, least: int = 12) -> Column:
    """Struct (s, e) of the quote's first place, or null; quotes shorter than ``least`` without a last full stop aren't looked up."""
    wanted = F.regexp_replace(F.trim(quote), r"\.+\z", "")
    at = F.call_function("instr", text, wanted)
    return F.when((F.length(wanted) >= least) & (at > 0), F.struct((at - 1).alias("s"), (at - 1 + F.length(wanted)).alias("e")))


def folded(text: Column) -> Column:
    """The text for comparison: small letters, one kind of bracket, quote and dash, runs of white space as one space.

    Only white space changes the length (small letters of another length stay as they are), so that ``unfolded``
    needs the runs' places alone.
    """
    small = F.lower(text)
    cased = F.when(F.length(small) == F.length(text), small).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.regexp_replace(F.translate(cased, "".join(FOLDED), "".join(FOLDED.values())), BLANK + "+", " ")


def unfolded(text: Column, at: Column) -> Column:
    """The places in the text of characters of ``folded(text)``, an array; a run of white space counts at its start."""

    def found(runs: Column) -> Column:
        # where each run stands in the folded text, and what it takes from places behind it
        return F.zip_with(runs, before_each(F.transform(runs, lambda r: r["e"] - r["s"] - 1)), lambda r, before: F.struct((r["s"] - before).alias("at"), (r["e"] - r["s"] - 1).alias("lost")))

    def shifted(taken: Column) -> Column:
        return F.transform(at, lambda k: (k + F.aggregate(taken, F.lit(0).cast("bigint"), lambda total, x: total + F.when(x["at"] < k, x["lost"]).otherwise(0))).cast("int"))

    return once(once(places(text, BLANK + "{2,}"), found), shifted)


def located_as(text: Column, quote: Column, least: int = 12) -> Column:
    """Struct (s, e, kind) of the quote's first place: exact, or else normalised, where it is there after ``folded``; null else."""
    wanted = F.regexp_replace(F.trim(quote), r"\.+\z", "")
    exact = located(text, quote, least)

    def near(found: Column) -> Column:
        ends = unfolded(text, F.array(found["at"] - 1, found["at"] + found["n"] - 2))
        place = once(ends, lambda x: F.struct(F.get(x, 0).alias("s"), (F.get(x, 1) + 1).alias("e"), F.lit("normalised").alias("kind")))
        return F.when((found["at"] > 0) & (found["n"] > 0), place)

    bare = once(F.trim(folded(wanted)), lambda x: F.struct(F.call_function("instr", folded(text), x).alias("at"), F.length(x).alias("n")))
    return once(exact, lambda x: F.when(x.isNotNull(), F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("exact").alias("kind"))).when(F.length(wanted) >= least, once(bare, near)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers, null where one has no length."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body, or a lambda in it, names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before_each(sizes: Column) -> Column:
    """For each number of an array, the sum of those before it.

    An array that grows by one element a step is copied at each; here blocks of about the root of the size
    are worked out apart, so that n elements cost n ** 1.5 at most.
    """
    none = F.array().cast("array<bigint>")

    def steps(start: Column, some: Column) -> Column:
        grown = F.aggregate(some, F.struct(start.alias("now"), none.alias("all")), lambda st, x: F.struct((st["now"] + x).alias("now"), F.array_append(st["all"], st["now"]).alias("all")))
        return grown["all"]

    def blocks(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1), lambda i: F.slice(v, i * width + 1, width))
        totals = F.transform(cut, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda x, y: x + y))
        return F.flatten(F.zip_with(cut, steps(F.lit(0).cast("bigint"), totals), lambda b, start: steps(start, b)))

    longs = sizes.cast("array<bigint>")
    return F.when(F.size(longs) > 0, once(longs, blocks)).otherwise(none)


def places(text: Column, pattern: str) -> Column:
    """Matches of a pattern as structs (s, e, m): code points, end exclusive, and the match."""
    gaps, all_ = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.transform(all_, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), m.alias("m")))

    def found(v: Column) -> Column:
        starts = before_each(F.transform(v, lambda x: x["gap"] + F.length(x["m"])))
        at = lambda x, start: (start + x["gap"]).cast("int")
        return F.zip_with(v, starts, lambda x, start: F.struct(at(x, start).alias("s"), (at(x, start) + F.length(x["m"])).alias("e"), x["m"].alias("m")))

    return F.when(text.rlike(pattern), once(sized, found)).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))
