"""Every operator on very long texts: 12 MB of words, one word of megabytes, 10**5 secrets in one text."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.llm import bpe, chat, exact, near, packing, quality, secret_scan, simhash, substring, toxicity, warc
from clausewright.llm.queries import tokenizer_path

from .test_operators import base_expected, fingerprint_expected, quality_expected, repeats_expected

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    words = " ".join(rng.choice(vocabulary) for _ in range(1_900_000)) + " " + passage
    return {1: words, 2: "x" * 10_000_000, 3: passage, 4: "é1" * 500_000, 5: passage + " end"}


@pytest.fixture(scope="module")
def long_docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(2, "doc_id")


@pytest.fixture(scope="module")
def short_of(long_docs):
    """Without the longest word, for what is tokenized symbol by symbol."""
    return long_docs.where("doc_id <> 2")


def test_exact(long_docs, texts):
    got = {r.doc_id: (r.kept, r.text_sha256) for r in exact.exact_groups(long_docs).collect()}
    assert got == {i: (True, sha(t)) for i, t in texts.items()}


def test_simhash_and_near(long_docs, texts):
    got = {r.doc_id: r.fp for r in simhash.fingerprints(long_docs).collect()}
    assert {i: f & (1 << 64) - 1 for i, f in got.items()} == {i: fingerprint_expected(t) for i, t in texts.items()}
    assert sorted(r.doc_id for r in near.drop_near_copies(long_docs).collect()) == [1, 2, 3, 4]


def test_packing(short_of, texts):
    n = {r.doc_id: r.n for r in packing.pack(short_of, tokenizer_path("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    assert n == {i: len(coder.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items() if i != 2}


def test_bpe(short_of, texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for r in bpe.encode_decode(short_of, tokenizer_path("byte_bpe_50k.json")).collect():
        assert r.decoded == texts[r.doc_id] and np.frombuffer(r.ids, "<u4").tolist() == coder.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_quality(spark, long_docs, texts):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.rate(long_docs, labels).collect()}
    assert got == {i: quality_expected(t) for i, t in texts.items()}


def test_substring(long_docs, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, sha(r.kept)) for r in substring.remove_repeats(long_docs).collect()}
    assert got == {i: (n, gone, sha(kept)) for i, n, gone, kept in repeats_expected(list(texts.items()), 20)}
    assert got[3][1] == 60


def test_toxicity(spark, long_docs):
    labels = spark.createDataFrame([(3, 1), (1, 0)], "doc_id bigint, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score_documents(long_docs, labels).collect())


def test_secrets(spark):
    rng = random.Random(6)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(100_000)]
    text = " é ".join(f"token={h} and {h}" if i % 2 else h for i, h in enumerate(hexes))
    docs = spark.createDataFrame([(1, text), (2, "y" * 10_000_000)], "doc_id bigint, text string")
    began = time.time()
    got = {r.doc_id: r for r in secret_scan.scan_documents(docs).collect()}
    spans = base_expected(text)
    assert (got[1].n_assign, got[1].n_hex) == (50_000, 150_000) and got[1].base_sha256 == sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)) and got[2].spans == ""
    clean = {r.doc_id: r.text for r in secret_scan.redact_documents(docs).collect()}
    assert clean[1] == " é ".join("[SECRET] and [SECRET]" if i % 2 else "[SECRET]" for i in range(100_000)) and clean[2] == "y" * 10_000_000
    assert time.time() - began < 240


def test_chat_and_pages(spark, texts):
    turns = spark.createDataFrame([(1, 0, "a", texts[1]), (1, 1, "b", "short")], "conv_id bigint, turn bigint, role string, text string")
    rows = chat.rotate(turns).collect()
    assert len(rows) == 4 and all(r.char_end - r.char_start == len(r.segment) for r in rows)
    pages = spark.createDataFrame([(1, "u", texts[1]), (2, "v", texts[2]), (3, "w", texts[1])], "page_id bigint, url string, html string")
    got = {r.page_id: (r.record_type, r.payload_bytes) for r in warc.archive(pages).collect()}
    assert got == {1: ("response", len(texts[1])), 2: ("response", 10_000_000), 3: ("revisit", len(texts[1]))}
