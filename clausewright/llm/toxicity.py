"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; documents without a usable label are the unlabelled text. Words
and word beginnings are hashed into buckets, each of which weighs for or against. A linear classifier is
trained in numpy with the non-negative risk estimator of Kiryo et al. (2017), corrected by the class prior. That
is the toxic share of the labels, unless the least ratio of the two score tails (Blanchard, Lee and Scott
2010), an estimate from above, is below half of that, as where labels were not drawn at random.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import small_batches

#: The fit's bounds on rows: confirmed toxic documents, unlabelled documents.
POSITIVES, UNLABELLED = 3000, 6000
#: Buckets of the features, and the characters of a word's beginning that is one.
BUCKETS, BEGINNING = 1 << 18, 5
#: A feature counts as far as its likelihood ratio exceeds that of one more parameter by Akaike's criterion; in the
#: prior, about that of the greatest of all buckets by chance (2 * log of their number, at half the documents).
FREE, STRICT = 2.0, 12.0
#: Share of the positives that a score tail must hold for its ratio to count in the prior; the prior's bounds.
LEAST_TAIL, PRIORS = 0.3, (0.001, 0.5)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, bucket), each once: the hash of each lower-case word without marks around it, and of its beginning."""
    codes, at, distinct = words.split(texts)
    rows = np.repeat(np.arange(len(texts)), np.diff(at))
    low = pc.utf8_lower(pc.utf8_trim(distinct, characters=".,;:!?\"'()[]{}<>|*#$%&-"))
    size = np.asarray(pc.utf8_length(low)) if len(low) else np.zeros(0, np.int32)
    hits = []
    for seed, values, fits in ((0, low, size > 0), (BEGINNING, pc.utf8_slice_codeunits(low, 0, BEGINNING), size > BEGINNING)):
        bucket = np.fromiter((xxhash.xxh64_intdigest(w, seed) % BUCKETS for w in values.cast(pa.binary()).to_pylist()), np.int64, len(values))
        keep = fits[codes]
        hits.append(rows[keep] * BUCKETS + bucket[codes][keep])
    both = np.unique(np.concatenate(hits))
    return both // BUCKETS, both % BUCKETS


@dataclass
class Model:
    """A weight for each bucket, a bias."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, bucket = features(texts)
        z = self.bias + np.bincount(row, self.weights[bucket], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


@dataclass
class Sample:
    """The fit's documents: pairs (row, bucket) by row, positives first, unlabelled after them."""

    row: np.ndarray
    bucket: np.ndarray
    positives: int
    unlabelled: int

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Positives and unlabelled documents with each bucket."""
        p = self.row < self.positives
        return np.bincount(self.bucket[p], minlength=BUCKETS), np.bincount(self.bucket[~p], minlength=BUCKETS)

    def half(self, which: int) -> "Sample":
        """Every second document."""
        n = self.positives
        own = np.where(self.row < n, self.row, self.row - n) % 2 == which
        shift = np.where(self.row < n, self.row // 2, (self.row - n) // 2 + (n + 1 - which) // 2)
        return Sample(shift[own], self.bucket[own], (n + 1 - which) // 2, (self.unlabelled + 1 - which) // 2)


def evidence(p: np.ndarray, u: np.ndarray, n: int, m: int, prior: float, free: float = FREE) -> np.ndarray:
    """For each bucket, the log ratio of its share in the positives to that in the negatives, shrunk by its likelihood ratio.

    The negatives' counts are the unlabelled ones less those of the ``prior`` share of positives among them. The
    likelihood ratio G of one share for both sides against two leaves 1 - free / G, 0 at least.
    """
    rate = (p + u) / (n + m)
    part = lambda k, e: np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / np.maximum(e, 1e-12)), 0)
    g = 2 * (part(p, rate * n) + part(n - p, (1 - rate) * n) + part(u, rate * m) + part(m - u, (1 - rate) * m))
    rest = np.maximum(u - prior * m / n * p, 0)
    ratio = np.log((p + 0.5) / (n + 1)) - np.log((rest + 0.5) / ((1 - prior) * m + 1))
    return ratio * np.maximum(0, 1 - free / np.maximum(g, 1e-9))


def estimated_prior(sample: Sample) -> float:
    """Share of positives among the unlabelled documents: the least ratio of unlabelled to positives above a score.

    Scores are the evidence of one half's documents, taken on the other half, and the other way round.
    """
    least = []
    for which in (0, 1):
        fit_on, on = sample.half(which), sample.half(1 - which)
        if min(fit_on.positives, fit_on.unlabelled, on.positives, on.unlabelled) < 1:
            return PRIORS[1]
        w = evidence(*fit_on.counts(), fit_on.positives, fit_on.unlabelled, 0.0, STRICT)
        z = np.bincount(on.row, w[on.bucket], minlength=on.positives + on.unlabelled)
        above = lambda own, at: 1 - np.searchsorted(np.sort(own), at) / len(own)
        at = np.unique(z[: on.positives])
        p, u = above(z[: on.positives], at), above(z[on.positives :], at)
        least.append(np.min(u[p >= LEAST_TAIL] / p[p >= LEAST_TAIL]))
    return float(np.clip(np.mean(least), *PRIORS))


def slopes(z: np.ndarray, n: int, prior: float) -> np.ndarray:
    """Derivative of the non-negative risk by each score; the first ``n`` are positives.

    The risk is prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) with the logistic loss l. Where the
    negative part is below 0, the step goes up its slope alone, as in the published algorithm.
    """
    s, m = 1 / (1 + np.exp(-np.clip(z, -60, 60))), len(z) - n
    negative = np.concatenate([-prior / n * s[:n], s[n:] / m])
    part = np.mean(np.logaddexp(0, z[n:])) - prior * np.mean(np.logaddexp(0, z[:n]))
    return np.concatenate([prior / n * (s[:n] - 1), np.zeros(m)]) + negative if part >= 0 else -negative


def nnpu(sample: Sample, scale: np.ndarray, prior: float, steps: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """A linear model over buckets scaled by ``scale`` that lessens the non-negative risk; Adam over all rows."""
    used = scale[sample.bucket] != 0
    own, at = np.unique(sample.bucket[used], return_inverse=True)
    row, value, size = sample.row[used], scale[sample.bucket[used]], sample.positives + sample.unlabelled
    w = np.zeros(len(own) + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        slope = slopes(np.bincount(row, value * w[at], minlength=size) + w[-1], sample.positives, prior)
        g = np.append(np.bincount(at, value * slope[row], minlength=len(own)) + decay * w[:-1], slope.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[own] = w[:-1] * scale[own]
    return Model(weights, float(w[-1]))


def sampled(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """Rows (doc_id, text_hash, text, is_p) for the fit, ``positives`` + ``unlabelled`` at most, those of the smallest hashes.

    Positives have a toxic label that isn't held out. Unlabelled are documents without any label but held out
    ones, which are never read; where each document has one, all documents are, and their labels aren't read.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    order = [F.xxhash64("doc_id", "text_hash"), F.col("doc_id"), F.col("text_hash")]
    first = lambda some, n: some.distinct().orderBy(order).limit(n)
    p = first(rows.join(known.where("toxic = 1").select("doc_id"), "doc_id", "left_semi"), positives)
    others = first(rows.join(known.select("doc_id"), "doc_id", "left_anti"), unlabelled)
    if others.isEmpty():
        others = first(rows, unlabelled)
    chosen = p.withColumn("is_p", F.lit(1)).union(others.withColumn("is_p", F.lit(0))).withColumnsRenamed({"doc_id": "s_id", "text_hash": "s_hash"})
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    # a bounded number of small rows; equal rows of ``docs`` count once
    met = texts.join(F.broadcast(chosen), texts["doc_id"].eqNullSafe(F.col("s_id")) & (texts["text_hash"] == F.col("s_hash")))
    return met.groupBy("doc_id", "text_hash", "is_p").agg(F.first("text").alias("text"))


def label_share(labels: DataFrame) -> float | None:
    """Toxic share of the labels that aren't held out, or None where they don't hold both kinds."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    share = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).agg(F.avg((F.col("toxic") == 1).cast("int"))).first()[0]
    return float(np.clip(share, *PRIORS)) if share and share < 1 else None


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from the labels whose documents aren't held out.

    Labels of documents that aren't toxic count in the class prior and nowhere else. Without a toxic label, or without other documents, the model has no weights and scores every text 0.001.
    """
    small_batches(docs.sparkSession)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in words.slices(batch):
                row, bucket = features(some["text"])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=some.num_rows))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([some["doc_id"], some["text_hash"], some["is_p"], lists], ["doc_id", "text_hash", "is_p", "buckets"])

    found = sampled(docs, labels, positives, unlabelled).mapInArrow(listed, "doc_id bigint, text_hash bigint, is_p int, buckets array<int>").toArrow()  # the bounded sample
    found = found.sort_by([("is_p", "descending"), ("doc_id", "ascending"), ("text_hash", "ascending")])
    n = int(pc.sum(found["is_p"]).as_py() or 0)
    m = found.num_rows - n
    if not n or not m:
        return Model(np.zeros(BUCKETS), float(np.log(PRIORS[0] / (1 - PRIORS[0]))))
    size = np.asarray(pc.list_value_length(found["buckets"])).astype(np.int64)
    sample = Sample(np.repeat(np.arange(n + m), size), np.asarray(pc.list_flatten(found["buckets"])).astype(np.int64), n, m)
    share, tails = label_share(labels), estimated_prior(sample)
    prior = tails if share is None or tails < share / 2 else share
    return nnpu(sample, evidence(*sample.counts(), n, m, prior), prior)


def toxicity_score(model: Model, text: Column) -> Column:
    """Score of each whole text, 0 to 1, by ``model``; null and empty texts get the score of no features."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [model.scores(some["text"]) for some in words.slices(batch)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    held_out is true where crc32 of doc_id as text leaves 0 modulo 5; such labels are never read. A null doc_id
    is not held out. The score depends on the text alone: repeated rows score alike, null counts as empty.
    No rows give no rows; other columns are ignored.
    """
    model = fit(docs, labels, **bounds)
    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), toxicity_score(model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more, columns as they were."""
    return docs.where(toxicity_score(fit(docs, labels, **bounds), docs["text"]) < 0.5)
