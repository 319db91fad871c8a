"""Readers and block builders for pages, logs, rule tables and answer keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import canonical


def csv_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows with a header in files of lines that end in a line feed."""
    rows.write.option("header", True).option("lineSep", "\n").csv(path)


def demoted_headings(blocks: DataFrame, text: str, is_heading: str, marker: str = r"^\s*(?:\(?[0-9a-z]{1,5}\)|[0-9]{1,3}[A-Z]?\.)\s") -> DataFrame:
    """``blocks`` in which what carries a clause's marker is no heading."""
    return blocks.withColumn(is_heading, F.col(is_heading) & ~F.coalesce(F.col(text).rlike(marker), F.lit(False)))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, sha256, text): whole files as UTF-8, with the hash of their bytes as cache key."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))


def rule_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small ordered rule table; ``ord`` keeps the order of the file."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"ord int, {schema}")


def yaml_rules(spark: SparkSession, path: str, section: str, schema: str, columns: list[str]) -> DataFrame:
    """A list of mappings in a YAML file as a rule table."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path).collect())  # a configuration file
    return rule_table(spark, [tuple(item.get(c) for c in columns) for item in yaml.safe_load(text)[section]], schema)


def page_blocks(pages: DataFrame, key: str, html: str, tags: tuple[str, ...] = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6")) -> DataFrame:
    """Rows (key, pos, tag, text): the blocks of each page in order, mark-up within them removed; empty ones are left out.

    A block reaches from a tag, attributes or not, to the next end of the same tag; footnote marks in <sup> go.
    """
    pattern = "(?s)<(" + "|".join(tags) + r")\b[^>]*>(.*?)</\1>"
    at = lambda i: F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(i))
    each = pages.select(key, F.posexplode(F.arrays_zip(at(1).alias("tag"), at(2).alias("body"))).alias("pos", "x"))
    clean = canonical(F.regexp_replace(F.regexp_replace(F.col("x.body"), r"(?s)<sup\b[^>]*>.*?</sup>", ""), "<[^>]*>", " "))
    return each.select(key, "pos", F.col("x.tag").alias("tag"), clean.alias("text")).where("text <> ''")


def lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def without_furniture(rows: DataFrame, line: str, least: int = 8) -> DataFrame:
    """``rows`` without the lines that occur ``least`` times or more, white space collapsed: page heads and feet."""
    keyed = rows.withColumn("__line", canonical(F.col(line)))
    often = keyed.groupBy("__line").count().where(F.col("count") >= least).select("__line")
    return keyed.join(often, "__line", "left_anti").drop("__line")


def joined_blocks(blocks: DataFrame, key: str, pos: str, text: str, is_heading: Column) -> DataFrame:
    """Blocks with broken ones joined: one that begins in lower case goes to the block before it unless that ends a sentence or is a heading."""
    order = W.partitionBy(key).orderBy(pos)
    before = F.lag(text).over(order)
    new = before.isNull() | ~F.col(text).rlike("^[a-z]") | F.coalesce(before.rlike("[.:;?!]$"), F.lit(True)) | is_heading | F.coalesce(F.lag(is_heading).over(order), F.lit(True))
    numbered = blocks.withColumn("__new", new.cast("int")).withColumn("block", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    return numbered.groupBy(key, "block").agg(F.min(pos).alias("pos"), F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"))


def selected_blocks(blocks: DataFrame, key: str, pos: str, opens: Column, numbered: Column, closes: Column) -> DataFrame:
    """The blocks of each document's body: from the last opening before the first numbered block up to the next closing one, which is left out."""
    whole, at = W.partitionBy(key), F.col(pos)
    found = blocks.withColumn("__numbered", F.min(F.when(numbered, at)).over(whole))
    found = found.withColumn("__opened", F.max(F.when(opens & (at < F.col("__numbered")), at)).over(whole))
    found = found.withColumn("__closed", F.min(F.when(closes & (at > F.col("__opened")), at)).over(whole))
    return found.where((at >= F.col("__opened")) & (F.col("__closed").isNull() | (at < F.col("__closed")))).drop("__numbered", "__opened", "__closed")


def capture_before(captures: DataFrame, key: str, captured: str, limit: str) -> DataFrame:
    """For each key, the latest capture strictly before its limit date."""
    return captures.where(F.col(captured) < F.col(limit)).groupBy(key).agg(F.max(captured).alias(captured))
