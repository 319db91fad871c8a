"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio; DataFrame functions only.

Words and pairs of neighbouring words are hashed into buckets. Two multinomials over the buckets, one of
trusted documents and one of all documents, give each document its mean log-likelihood ratio, and a fixed
threshold decides on every document, without sampling.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, words_of

#: Buckets of the multinomials; what is added to each bucket's count.
BUCKETS, SMOOTHING = 1 << 14, 1.0
#: Documents below this mean log-likelihood ratio go.
LEAST_RATIO = -0.1


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words; all that follows works on these."""
    return F.transform(words_of(text), lambda x: F.xxhash64(x))


def buckets(h: Column, n: int) -> Column:
    """Buckets of the words and of the pairs of neighbours, from an array of word hashes."""
    ones = F.transform(h, lambda x: F.pmod(x, F.lit(n)).cast("int"))
    short = F.greatest(F.size(h) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(h, 1, short), F.slice(h, 2, short), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(n)).cast("int"))
    return F.concat(ones, pairs)


def log_ratios(docs: DataFrame, labels: DataFrame, n: int = BUCKETS) -> list[float]:
    """For each bucket, log of its share in trusted documents over its share in all documents.

    All documents are counted. Trusted ones are all with label quality 1. Without any, every ratio is 0.
    """
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("trusted_id"), F.lit(0).cast("bigint").alias("trusted_part")).distinct()
    # rows without doc_id find no label and are dealt out by their text; a shuffle whatever the size, since labels grow with the documents
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).alias("part"), "text")
    marked = rows.join(good.hint("merge"), (rows["id"] == good["trusted_id"]) & (rows["part"] == good["trusted_part"]), "left")
    each = marked.select(good["trusted_id"].isNotNull().cast("bigint").alias("good"), F.explode(let(word_hashes(F.col("text")), lambda h: buckets(h, n))).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good")).collect()  # one row for each bucket
    raw, target = [SMOOTHING] * n, [SMOOTHING] * n
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["good"]
    if sum(target) == n * SMOOTHING:
        return [0.0] * n
    a, b = math.log(sum(target)), math.log(sum(raw))
    return [math.log(t) - a - math.log(r) + b for t, r in zip(target, raw)]


def repeated_words(w: Column, width: int = 8) -> Column:
    """Words that lie in windows of ``width`` words found twice or more, from an array of word hashes."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))

    def covered(ordered: Column) -> Column:
        # neighbours in hash order with one hash are repeats; then the gaps between their places, at most a window each
        same = lambda i, j: F.get(ordered, i)["h"] == F.get(ordered, j)["h"]
        twice = F.filter(ordered, lambda x, i: F.coalesce((i > 0) & same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(width)), F.lit(width))), F.lit(0), lambda a, b: a + b))

    def of(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, covered))

    return F.when(F.size(w) < width, F.lit(0)).otherwise(let(hashes, of)).cast("bigint")


def rate(docs: DataFrame, labels: DataFrame, least_ratio: float = LEAST_RATIO, n: int = BUCKETS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio.

    base_failed: under 20 words, or over 30 % of the words in repeated windows of 8. kept: not base_failed, and
    a mean log-likelihood ratio of ``least_ratio`` or more. Null and empty texts have no words, a ratio of 0
    and fail. Repeated rows are rated alike; no rows give no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    table = F.from_json(F.lit(json.dumps(log_ratios(docs, labels, n))), "array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    no_space = F.translate(text, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    rows = docs.select("doc_id", F.struct(
        F.length(no_space).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        let(word_hashes(text), lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            let(buckets(w, n), lambda b: F.when(F.size(b) == 0, 0.0).otherwise(F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(table, x)) / F.size(b))).alias("ratio"),
        )).alias("w"),
    ).alias("r"))
    out = rows.select("doc_id", "r.w.n_words", "r.word_chars", "r.n_symbols", "r.n_dup_lines", "r.w.n_repeat_words", "r.w.ratio")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= least_ratio))
