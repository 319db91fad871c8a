"""Exact deduplication by recipes of content-defined chunks; DataFrame functions only.

A text is cut where its own content says so, each distinct chunk gets a verified identifier, and texts are
compared by their ordered identifier lists. A chunk's text is moved once, to verify identifiers; documents
never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: A chunk may end behind three characters whose last byte in UTF-8 has these lower bits: (mask, values) of each.
#: They are the same share of any script's letters and of digits, so that about one place in 128 qualifies.
ENDS = ((7, {1}), (3, {2}), (3, {0}))
LEAST, MOST = 128, 4096


def _bytes(low: int, high: int, mask: int, values: set[int]) -> str:
    """A pattern's class of the bytes from ``low`` to below ``high`` with these lower bits."""
    return "[" + "".join(f"\\x{b:02x}" for b in range(low, high) if b & mask in values) + "]"


def _pattern(wide: bool) -> str:
    """Texts of one byte a character, or any text as its bytes: there a character ends where no continuation byte follows."""
    part = r"(?:{0}|[\xc2-\xf4][\x80-\xbf]{{0,2}}{1})" if wide else "{0}"
    first = _bytes(0, 0xC0 if wide else 0x80, *ENDS[0])
    rest = "".join(part.format(_bytes(0, 0x80, *x), _bytes(0x80, 0xC0, *x)) for x in ENDS[1:])
    end = r"(?![\x80-\xbf])" if wide else ""
    return f"(?s).{{{LEAST - 3},{MOST - 12}}}?{first}{rest}{end}|.{{1,{MOST}}}{end}"


def normalised(text: Column) -> Column:
    """Null counts as empty; A-Z are lower-cased."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def chunks(text: Column) -> Column:
    """The text cut into chunks. Where one may end follows from three characters, so that texts are cut alike again soon behind an edit.

    Chunks of a text with longer characters are its bytes, one character each; ``spelled`` turns one back.
    """
    wide = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.when(F.length(text) == F.octet_length(text), F.regexp_extract_all(text, F.lit(_pattern(False)), F.lit(0))).otherwise(F.regexp_extract_all(wide, F.lit(_pattern(True)), F.lit(0)))


def spelled(chunk: Column) -> Column:
    """The text of a chunk."""
    return F.when(F.length(chunk) == F.octet_length(chunk), chunk).otherwise(F.decode(F.encode(chunk, "ISO-8859-1"), "UTF-8"))


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def clashing(docs: DataFrame, text: str = "text", key=chunk_hash) -> DataFrame:
    """Hashes that two different chunks of the corpus share: rows (hash, chunk, ordinal), one for each such chunk.

    Distinct chunks are found by hash and full text, so that equal hash and one text proves the hash an
    identifier. Copies of a chunk are combined before the shuffle.
    """
    each = docs.select(F.explode(chunks(normalised(F.col(text)))).alias("chunk"))
    distinct = each.select(key(F.col("chunk")).alias("hash"), "chunk").distinct()
    shared = written(distinct.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "shared-hashes")
    if shared.isEmpty():
        return shared.select("hash", F.lit("").alias("chunk"), F.lit(0).alias("ordinal"))
    rows = distinct.join(shared, "hash", "left_semi")
    # texts of one hash are few: they got there by a clash of 64-bit hashes
    by_hash = rows.groupBy("hash").agg(F.array_sort(F.collect_set("chunk")).alias("all"))
    return by_hash.select("hash", F.posexplode("all").alias("ordinal", "chunk"))


def recipes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", key=chunk_hash) -> DataFrame:
    """Rows (doc_id, recipe, text_sha256), one for each row of ``docs``; recipe lists the text's chunk identifiers in order.

    Equal recipes mean equal normalised texts: an identifier is a chunk's hash where one chunk has it, and
    the hash with an ordinal where several share it.
    """
    clash = clashing(docs, text, key)
    norm = normalised(F.col(text))
    plain = docs.select(F.col(doc_id).alias("doc_id"), norm.alias("norm"))
    parts = chunks(F.col("norm"))
    ids = F.transform(parts, lambda c: key(c))
    if clash.isEmpty():
        return plain.select("doc_id", ids.alias("recipe"), F.sha2("norm", 256).alias("text_sha256"))
    # texts with a shared hash get (hash, ordinal) for each chunk by a join; others keep the plain list, marked apart
    rows = plain.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("norm", 256).alias("text_sha256"), parts.alias("parts"))
    each = rows.select("row", "doc_id", "text_sha256", F.posexplode_outer("parts").alias("pos", "chunk")).withColumn("hash", key(F.col("chunk")))
    found = each.join(clash, ["hash", "chunk"], "left")
    item = F.struct("pos", "hash", F.coalesce("ordinal", F.lit(0)).cast("bigint").alias("ordinal"))
    listed = found.groupBy("row", "doc_id", "text_sha256").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), item))).alias("items"))
    return listed.select("doc_id", F.flatten(F.transform("items", lambda x: F.array(x["hash"], x["ordinal"]))).alias("recipe"), "text_sha256")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with
    the largest doc_id stays; rows that share doc_id and text stay or go together. A null doc_id is smaller
    than any other and stays only in a group without others. No rows give no rows; other columns are ignored.
    """
    table = written(recipes(docs, text, doc_id), "recipes")
    # copies are combined before the shuffle; groups of one need no partner
    groups = table.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    # written, so that both sides of the join are plain shuffles and adaptive execution splits a hot recipe
    groups = written(groups, "recipe-groups")
    joined = table.join(groups, "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that exact_groups drops, columns as they were."""
    gone = exact_groups(docs, text, doc_id).where("not kept").select(F.col("doc_id").alias("__gone_id"), F.col("text_sha256").alias("__gone_text"))
    same_row = docs[doc_id].eqNullSafe(gone["__gone_id"]) & (F.sha2(normalised(docs[text]), 256) == gone["__gone_text"])
    return docs.join(gone, same_row, "left_anti")
