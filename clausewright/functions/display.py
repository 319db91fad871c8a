"""Wording for readers: citations, tags, and checks of drafted wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import body

#: The tags that items have within a prompt, and words that a draft must keep.
TAG = r"\s*\(?\[?\b[OC][0-9]{1,2}\b\]?\)?"
TAG_PHRASE = r"(?i),?\s*(matching|as in|as per|per|in|of|under)\s+(the\s+)?(obligation|control|candidate|passage)\s+(in\s+)?\[?[OC][0-9]{1,2}\]?"
NUMBER = r"(?i)\d[\d,]*(?:\.\d+)?|\b(?:one|two|three|four|five|six|seven|eight|nine|ten|twelve|fifteen|twenty|thirty|fifty|hundred|thousand|lakh|crore)\b"
PROHIBITION, DUTY = r"(?i)\b(shall|must|should|will)\s+not\b|\bprohibit", r"(?i)\b(shall|must)\b"


def day(date: Column) -> Column:
    """3 Feb 2026; empty for null."""
    return F.coalesce(F.date_format(date, "d MMM yyyy"), F.lit(""))


def without_tags(text: Column) -> Column:
    """Text without the tags of prompt items; one without tags stays as it is."""
    cleaned = F.regexp_replace(F.regexp_replace(text, TAG_PHRASE, ""), TAG, "")
    tidy = F.regexp_replace(F.regexp_replace(cleaned, r"[ \t]{2,}", " "), r"\s+([.,;])", "$1")
    return F.trim(F.when(cleaned == text, text).otherwise(tidy))


def unfaithful(obligation: Column, wording: Column) -> Column:
    """Why drafted wording cannot stand for the obligation; empty where it can."""
    said = lambda t: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)), lambda n: F.replace(F.lower(n), F.lit(","), F.lit("")))))
    want, have = said(body(obligation)), said(wording)
    listed = lambda label, xs: F.when(F.size(xs) > 0, F.concat(F.lit(label), F.array_join(xs, ", ")))
    problems = F.array(
        listed("drops: ", F.array_except(want, have)),
        listed("adds: ", F.array_except(have, want)),
        F.when(obligation.rlike(PROHIBITION) & ~wording.rlike(PROHIBITION), "the prohibition is lost"),
        F.when(obligation.rlike(DUTY) & ~wording.rlike(DUTY), "the duty is no longer mandatory"),
    )
    return F.filter(problems, lambda p: p.isNotNull())


def predates(stated: Column, kind: Column, amended: Column) -> Column:
    """A sentence where the policy's own date lies before the amendment of the paragraph, else null."""
    text = F.concat(F.lit("The policy's own date ("), kind, F.lit(" "), day(stated), F.lit(") is earlier than the amendment to this paragraph (in effect from "), day(amended), F.lit(")."))
    return F.when(stated < amended, text)


def confidence_note(right: Column, known: Column, least: int = 30) -> Column:
    """How often checked findings of a band were right; a percentage only from ``least`` of them on."""
    share = F.concat(F.round(100 * right / known).cast("bigint"), F.lit(" % of "), known, F.lit(" checked findings in this band were right"))
    return F.when(known >= least, share).otherwise(F.concat(right, F.lit(" of "), known, F.lit(" checked findings in this band were right; too few for a percentage")))
