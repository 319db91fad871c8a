"""Blocks that hold several numbered paragraphs, split where the next expected number begins."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: A paragraph's number at the start of a block, one within it, and a sub-clause's number within a paragraph.
LEAD = re.compile(r"^(\d{1,3})\.\s")
WITHIN = re.compile(r"(?<=[.:;\]])\s+(?=(\d{1,3})\.\s+[A-Z‘'\"(])")
SUB = re.compile(r"(?:(?<=[:;])|(?<=\band)|(?<=\bor))\s+(?=\((\d{1,2})\)\s)")


def cut_in_sequence(text: str, mark: re.Pattern, following: int) -> tuple[list[str], int]:
    """The text cut at those marks whose number is the next one, starting with ``following``; and the number after the last."""
    starts, ends = [0], []
    for m in mark.finditer(text):
        if int(m[1]) == following:
            ends.append(m.start())
            starts.append(m.end())
            following += 1
    return [text[a:b].strip() for a, b in zip(starts, [*ends, len(text)])], following


class Paragraphs:
    """A table function over the blocks of a document in order; between them only the next number is kept."""

    def __init__(self) -> None:
        self.following = 1

    def eval(self, row: Row) -> Iterator[tuple]:
        text = (row["text"] or "").strip()
        own = LEAD.match(text)
        parts, self.following = cut_in_sequence(text, WITHIN, int(own[1]) + 1 if own else self.following)
        pieces = [piece for p in parts for piece in cut_in_sequence(p, SUB, 1)[0] if piece]
        for n, piece in enumerate(pieces):
            yield row["doc"], row["pos"], n, piece


def paragraphs(blocks: DataFrame) -> DataFrame:
    """Rows (doc, pos, part, text) of blocks (doc, pos, text) split at inline paragraph and sub-clause numbers.

    Only the next expected number splits, so that a "5." within a sentence doesn't. A block that begins with a
    number sets what is expected after it. Blocks of a document stream by in order of pos: a document of any
    length needs no memory. Blocks without text give no rows.
    """
    split = F.udtf(Paragraphs, returnType="doc string, pos bigint, part int, text string")
    rows = blocks.select(F.col("doc").cast("string").alias("doc"), F.col("pos").cast("bigint").alias("pos"), "text")
    return split(rows.asTable().partitionBy("doc").orderBy("pos"))
