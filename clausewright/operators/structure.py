"""Structure of documents: clause trees with exact spans, unnumbered runs, units and passages.

Numbering is read in order within a document, so the tree is built per document; all that follows from the
tree is relational.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import canonical
from ..session import dealt_by, settled
from .spans import own_segments

#: The marks that open a clause, and words that say a text sets a rule or defines a term.
DECIMAL = re.compile(r"^(\d{1,2}(?:\.\d{1,2})+)\.?\s+")
PARAGRAPH = re.compile(r"^(\d{1,3}[A-Z]?)\.\s+")
BRACKET = re.compile(r"^(?:\(([0-9]{1,2}|[a-z]{1,2}|[ivxl]{1,6})\)\s*|([0-9]{1,2}|[a-z]{1,2}|[ivxl]{1,6})\)\s+|([a-z]{1,2}|[ivxl]{1,6})\.\s+)")
NORMATIVE = r"(?i)\b(shall|must|may|should|will|is to be|are to be|has to|have to|required|responsible|not permitted|prohibited|ensure)\b"
DEFINES = r"(?i)\b(means|mean|includes?|shall include|is the|are the)\b"
LEAST_RUN, UNIT_CHARS, CONTEXT_CHARS, PASSAGE_CHARS, LEAST_PASSAGE, COVERED = 80, 2500, 600, 700, 40, 0.8


def roman(label: str) -> int:
    """Value of a small Roman number."""
    values = [{"i": 1, "v": 5, "x": 10, "l": 50}[c] for c in label]
    return sum(-a if a < b else a for a, b in zip(values, [*values[1:], 0]))


def mark_kind(label: str, path: list[tuple[str, str]]) -> str:
    """Whether a bracketed label counts in numbers, Roman numbers or letters, by what is open on the path."""
    if label.isdigit():
        return "num"
    last = dict(path)
    if len(label) > 1 and last.get("roman") == label[:-1]:
        return "roman"  # inserted after its namesake: (ia) after (i)
    if not set(label) <= set("ivxl"):
        return "alpha"
    letter, number = last.get("alpha"), last.get("roman")
    if letter and len(label) == 1 and ord(label) == ord(letter) + 1:
        return "alpha"
    follows = number is not None and set(number) <= set("ivxl") and roman(label) == roman(number) + 1
    return "roman" if follows or len(label) > 1 or label == "i" or not letter else "alpha"


def trees_of(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Clauses that blocks open; ``rows``: (doc, text in canonical form, is_heading, amended_by), a document's together and in order.

    A clause ends before the next one of its depth or less, or the next heading, and is given out then: only
    what is open and the references of one document are held. Runs of 80 characters or more outside all
    clauses of depth one come as U1, U2 and so on.
    """
    first, doc = True, None
    path: list[dict] = []
    open_: list[dict] = []  # depths grow
    used: dict[str, int] = {}
    waiting: list[str] = []
    chapter = section = run = None
    at = runs = 0

    def named(ref: str) -> str:
        used[ref] = used.get(ref, 0) + 1
        return ref if used[ref] == 1 else f"{ref}~{used[ref]}"

    def closed(depth: int, end: int) -> Iterator[tuple]:
        while open_ and open_[-1]["depth"] >= depth:
            n = open_.pop()
            yield doc, n["ref"], n["label"], n["kind"], n["depth"], n["parent_ref"], n["chapter"], n["section"], n["s"], end, n["amended_by"]

    def run_ended() -> Iterator[tuple]:
        nonlocal run, runs
        if run and run[2] >= LEAST_RUN:
            runs += 1
            yield doc, f"U{runs}", f"U{runs}", "unnumbered", 1, None, None, None, run[0], run[1], None
        run = None

    for key, text, is_heading, amended_by in rows:
        if first or key != doc:
            yield from closed(0, at - 1)
            yield from run_ended()
            first, doc, path, used, waiting, chapter, section, at, runs = False, key, [], {}, [], None, None, 0, 0
        s, at = at, at + len(text) + 1
        marks = list(amended_by or [])
        if is_heading:
            yield from closed(0, s - 1)
            yield from run_ended()
            waiting += marks
            path = []
            chapter, section = (text, None) if text.lower().startswith("chapter") else (chapter, text)
            continue
        number = (DECIMAL.match(text) or PARAGRAPH.match(text)) if text[0].isdecimal() else None
        bracket = None if number or not path else BRACKET.match(text)
        node = None
        if number:
            label = number.group(1)
            prefixes = [label.rsplit(".", i)[0] for i in range(1, label.count(".") + 1)]
            node = {"ref": "", "label": label, "kind": "dec" if "." in label else "para", "depth": label.count(".") + 1, "parent_ref": next((p for p in prefixes if p in used), None)}
            node["ref"] = named(label)
            path = []
        elif bracket:
            label = next(g for g in bracket.groups() if g)
            kind = mark_kind(label, [(n["kind"], n["label"]) for n in path])
            open_at = next((i for i, n in enumerate(path) if i and n["kind"] == kind), len(path))
            path = path[:open_at]
            node = {"ref": named(f"{path[-1]['ref']}({label})"), "label": label, "kind": kind, "depth": path[0]["depth"] + len(path), "parent_ref": path[-1]["ref"]}
        if node:
            if open_ and open_[-1]["depth"] >= node["depth"]:
                yield from closed(node["depth"], s - 1)
            node |= {"chapter": chapter, "section": section, "s": s, "amended_by": waiting}
            waiting = []
            path = [*path, node]
            open_.append(node)
        if marks:
            if path:
                path[-1]["amended_by"] = path[-1]["amended_by"] + marks
            else:
                waiting += marks
        if open_ and open_[0]["depth"] == 1:
            if run:
                yield from run_ended()
        else:
            run = (run[0], at - 1, run[2] + len(text)) if run else (s, at - 1, len(text))
    yield from closed(0, at - 1)
    yield from run_ended()


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` in canonical form; empty ones go."""
    return blocks.where(F.col("text").rlike(r"[^\s\u00A0]")).withColumn("text", canonical(F.col("text")))


def placed_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` (doc, pos, text, is_heading, amended_by) in canonical form with their span (s, e) in the document's text; empty ones go."""
    clean = clean_blocks(blocks)
    order = W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0))
    return clean.withColumn("s", start.cast("bigint")).withColumn("e", F.col("s") + F.length("text"))


def clause_tree(blocks: DataFrame) -> DataFrame:
    """Clauses of each document: doc, ref, label, kind, depth, parent_ref, chapter, section, s, e, amended_by.

    A clause ends before the next one of its depth or less, or the next heading. Text outside all clauses, 80
    characters or more of it in a row, becomes clauses U1, U2 and so on. Documents are dealt to tasks, and each
    task reads its blocks in order once.
    """
    kind = dict(blocks.dtypes)["doc"]
    schema = f"doc {kind}, ref string, label string, kind string, depth int, parent_ref string, chapter string, section string, s bigint, e bigint, amended_by array<string>"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = lambda c: c.to_pylist() if c.null_count < len(c) else repeat(None, len(c))
        rows = trees_of((doc, text, head, marks and json.loads(marks)) for b in batches for doc, text, head, marks in zip(*map(cells, b.columns)))
        while part := list(islice(rows, 5000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), form.types)], schema=form)

    # as text: the size of a batch is taken at each row, which reads a list column's batch through
    marks = F.when(F.size("amended_by") > 0, F.to_json("amended_by"))
    dealt = dealt_by(clean_blocks(blocks), "doc").sortWithinPartitions("doc", "pos").select("doc", "text", "is_heading", marks.alias("marks"))
    form = to_arrow_schema(dealt.sparkSession.createDataFrame([], schema).schema)
    return dealt.mapInArrow(build, schema)


def document_text(blocks: DataFrame) -> DataFrame:
    """Rows (doc, text): blocks joined by line ends."""
    placed = placed_blocks(blocks)
    parts = F.array_sort(F.collect_list(F.struct("s", "text")))
    return placed.groupBy("doc").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def quoted(clauses: DataFrame, texts: DataFrame) -> DataFrame:
    """``clauses`` with their quote, a slice of the document's text."""
    both = clauses.join(texts, "doc")
    return both.withColumn("quote", F.substring("text", F.col("s").cast("int") + 1, (F.col("e") - F.col("s")).cast("int"))).drop("text")


def own_text(clauses: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (doc, ref, own): a clause's text before its first child."""
    child = clauses.select("doc", F.col("parent_ref").alias("ref"), F.col("s").alias("child_s"))
    first = clauses.select("doc", "ref", "s", "e").join(child, ["doc", "ref"], "left").groupBy("doc", "ref", "s", "e").agg(F.min(F.when(F.col("child_s") > F.col("s"), F.col("child_s"))).alias("first"))
    cut = first.join(texts, "doc")
    own = F.substring("text", F.col("s").cast("int") + 1, (F.coalesce("first", "e") - F.col("s")).cast("int"))
    return cut.select("doc", "ref", F.regexp_replace(own, r"^\s+|\s+$", "").alias("own"))


def units(clauses: DataFrame, texts: DataFrame) -> DataFrame:
    """Extraction units: rows (doc, ref, kind, start, text, cut, context), whole clauses of 2,500 characters at most, else lead-ins and children.

    A definition is split down to its leaves. Goes down the tree a level at a time, until a level is empty. A
    clause without children that is longer than 2,500 characters is cut there; cut says how many it lost. What
    is split is told by spans, which lie within the texts, so that only units are held against these.
    """
    unit_kind = F.when(F.coalesce("section", F.lit("")).rlike(r"(?i)\bdefinitions?\b"), "definition").otherwise("provision")
    nodes = settled(clauses.select("doc", "ref", "parent_ref", unit_kind.alias("unit_kind"), "s", "e"))
    long = nodes.where((F.col("e") - F.col("s") > UNIT_CHARS) | (F.col("unit_kind") == "definition")).select("doc", "ref", "s", "e")
    child = nodes.where("parent_ref IS NOT NULL").select("doc", F.col("parent_ref").alias("ref"))
    split = settled(long.join(child, ["doc", "ref"], "left_semi"))
    level = nodes.where("parent_ref IS NULL").withColumn("context", F.lit(""))
    whole, leads = level, []
    if not split.isEmpty():
        some = nodes.join(split.select("doc").distinct(), "doc", "left_semi")
        opened = settled(own_text(some, texts).join(split.select("doc", "ref"), ["doc", "ref"], "left_semi"))
        whole = None
        while whole is None or not level.isEmpty():
            leaf = level.join(opened, ["doc", "ref"], "left_anti")
            whole = leaf if whole is None else whole.unionByName(leaf)
            open_ = settled(level.join(opened, ["doc", "ref"]))
            leads.append(open_.where("own <> ''").select("doc", F.concat("ref", F.lit("#lead")).alias("ref"), "unit_kind", "s", F.col("own").alias("text"), F.lit(0).alias("cut"), "context"))
            context = F.trim(F.concat_ws(" ", "context", "own"))
            tail = F.substring(context, F.greatest(F.length(context) - CONTEXT_CHARS + 1, F.lit(1)), F.lit(CONTEXT_CHARS))
            level = settled(nodes.join(open_.select("doc", F.col("ref").alias("parent_ref"), tail.alias("context")), ["doc", "parent_ref"]))
    quotes = quoted(whole, texts)
    out = quotes.select("doc", "ref", "unit_kind", "s", F.substring("quote", 1, UNIT_CHARS).alias("text"), F.greatest(F.length("quote") - UNIT_CHARS, F.lit(0)).alias("cut"), "context")
    for lead in leads:
        out = out.unionByName(lead)
    asks = F.col("text").rlike(NORMATIVE) | ((F.col("unit_kind") == "definition") & (F.length("text") >= 50) & F.col("text").rlike(DEFINES))
    return out.where(asks).select("doc", "ref", F.col("unit_kind").alias("kind"), F.col("s").alias("start"), "text", "cut", "context")


def packed_sentences(text: Column, limit: int = PASSAGE_CHARS) -> Column:
    """Verbatim pieces of a text as structs (s, e): sentences taken together while they stay within ``limit`` characters."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s).*?(?:[.;:]\s+|\n+|\z)"), F.lit(0))

    def step(state: Column, x: Column) -> Column:
        cut = state["at"] + F.length(x)
        full = (cut - state["s"] > limit) & (state["at"] > state["s"])
        done = F.when(full, F.array_append(state["out"], F.struct(state["s"].alias("s"), state["at"].alias("e")))).otherwise(state["out"])
        return F.struct(F.when(full, state["at"]).otherwise(state["s"]).alias("s"), cut.alias("at"), done.alias("out"))

    empty = F.array().cast("array<struct<s:int,e:int>>")
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("at"), empty.alias("out"))
    packed = F.aggregate(parts, start, step, lambda st: F.when(st["at"] > st["s"], F.array_append(st["out"], F.struct(st["s"].alias("s"), st["at"].alias("e")))).otherwise(st["out"]))
    # a text within the limit is one piece
    alone = F.when(F.length(text) > 0, F.array(F.struct(F.lit(0).alias("s"), F.length(text).alias("e")))).otherwise(empty)
    return F.when(F.length(text) <= limit, alone).otherwise(packed)


def passages(clauses: DataFrame, texts: DataFrame, covered: DataFrame) -> DataFrame:
    """Rows (doc, ref, s, e, text): pieces of clauses' own text, 40 characters or more, that ``covered`` (doc, s, e) spans cover less than 80 % of."""
    segments = own_segments(clauses.select("doc", "ref", "s", "e"), ["doc"]).join(texts, "doc")
    body = F.substring("text", F.col("s").cast("int") + 1, (F.col("e") - F.col("s")).cast("int"))
    each = segments.withColumn("body", body).select("doc", "ref", "s", "body", F.explode(packed_sentences(F.col("body"))).alias("p"))
    piece = F.substring("body", F.col("p.s") + 1, F.col("p.e") - F.col("p.s"))
    strip = lambda c: F.regexp_replace(c, r"^\s+", "")
    lead = F.length(piece) - F.length(strip(piece))
    text = F.regexp_replace(strip(piece), r"\s+$", "")
    found = each.select("doc", "ref", (F.col("s") + F.col("p.s") + lead).alias("s"), text.alias("text")).withColumn("e", F.col("s") + F.length("text")).where(F.length("text") >= LEAST_PASSAGE)
    if covered.isEmpty():
        return found.select("doc", "ref", "s", "e", "text")
    # what lies covered before a place, a span as often as it is given, follows from the starts and ends before it
    spans = covered.where("s < e AND doc IS NOT NULL").select("doc", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("n")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("n")))).alias("x")).select("doc", "x.*")
    both = found.unionByName(spans.withColumns({"s": F.col("at"), "e": F.col("at")}).drop("at"), allowMissingColumns=True)

    def before(place: str) -> Column:
        order = W.partitionBy("doc").orderBy(place).rangeBetween(W.unboundedPreceding, W.currentRow)
        return F.coalesce(F.col(place) * F.sum("n").over(order) - F.sum(F.col("n") * F.col(place)).over(order), F.lit(0))

    inside = both.withColumn("__s", before("s")).withColumn("__e", before("e")).where("n IS NULL")
    return inside.where(F.col("__e") - F.col("__s") < COVERED * (F.col("e") - F.col("s"))).select("doc", "ref", "s", "e", "text")


def ancestors(clauses: DataFrame) -> DataFrame:
    """Rows (doc, ref, ancestor, steps) for every clause and what it lies under, a step up at a time until nothing lies higher.

    However many rows a step has: a recursive query stops at a million (spark.sql.cteRecursionRowLimit).
    """
    up = settled(clauses.where("parent_ref IS NOT NULL").select("doc", "ref", F.col("parent_ref").alias("ancestor")))
    above = up.select("doc", F.col("ref").alias("ancestor"), F.col("ancestor").alias("__next"))
    level = out = up.withColumn("steps", F.lit(1))
    while not level.isEmpty():
        level = settled(level.join(above, ["doc", "ancestor"]).select("doc", "ref", F.col("__next").alias("ancestor"), (F.col("steps") + 1).alias("steps")))
        out = out.unionByName(level)
    return out
