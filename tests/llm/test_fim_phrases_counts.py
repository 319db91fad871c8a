"""Fill-in-middle, phrases and token counts against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.llm import fim, phrases, token_counts
from clausewright.llm import quotient_filter as qf
from clausewright.llm.queries import tokenizer_path

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
PATH = tokenizer_path("byte_bpe_50k.json")


# fill-in-middle


def fim_expected(i, text):
    t = text or ""
    w = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    h = hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (i, len(w), "plain", None, None, sha(t), sha(t))
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (i, len(w), form, len(p), len(m), sha(out), sha(t))


def test_fill_in_middle(spark, docs, doc_rows, no_docs):
    got = fim.transform(docs).drop("pieces", "output").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(fim_expected(i, t)) for i, t in doc_rows)
    assert sorted(map(repr, map(tuple, fim.transform(docs, outputs=False).drop("pieces", "output").collect()))) == sorted(map(repr, map(tuple, got)))
    assert fim.transform(no_docs).count() == 0


def test_forms_and_restoring(spark):
    rng = random.Random(2)
    bits = ["<", "<P", "P>", "<S", "é", " ", "\n", "日本", "word", "<M", ">", "\t\t", "x" * 50]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(400)] + [(400, "has <P> in it"), (401, " \n "), (402, "one"), (402, "one")]
    out = fim.transform(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(repr, (tuple(r) for r in out.drop("pieces", "output").collect()))) == sorted(repr(fim_expected(i, t)) for i, t in rows)
    assert {r.form for r in out.collect()} == {"plain", "psm", "spm"}
    back = fim.restore(out.withColumn("restored", F.lit("clash")))
    assert sorted((r.doc_id, r.restored) for r in back.collect()) == sorted(rows)
    for r in out.collect():
        text = dict(rows)[r.doc_id].encode()
        assert b"".join((text, fim.SENTINELS)[p.buffer][p.start : p.start + p.length] for p in r.pieces).decode() == r.output


def test_pieces_of_a_long_text(spark):
    text = "word é\n" * 1_500_000
    rows = [(i, text) for i in range(4)]
    got = fim.transform(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), outputs=False).drop("pieces", "output").collect()
    assert sorted(map(tuple, got)) == sorted(fim_expected(i, t) for i, t in rows)


def test_piece_table_cuts_and_permutes():
    table = fim.PieceTable("abécd".encode()).cut(1, 4)
    assert [bytes(x).decode() for x in table.stream()] == ["a", "bé", "cd"] and table.cut(1, 4, 4).spelled() == "abécd".encode()
    for form in fim.FORMS:
        assert table.arranged(form).restored(form).pieces == table.pieces


# phrases


def phrases_expected(rows, least, longest, top, share=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i : i + m]] = max(held[p[i : i + m]], a)
        scored = []
        for p, a in cand.items():
            if p in held and 100 * held[p] >= share * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, lo, hi, n[lang], -s) for i, (s, a, p, lo, hi) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(8)
    words = ["a", "b", "C", "dd", "É", "日本", "x-1", "the", "\x00", "\x1c", "\xa0"]
    fixed = ["the quick brown fox jumps over", "New York City", "state of the art"]
    def text(n):  # noqa: E306
        return "".join(rng.choice([*words, *fixed]) + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\r\n", " : "]) for _ in range(n))
    rows = [(rng.choice(["en", "en", "en", "fr", None, "und"]), text(rng.randint(0, 60))) for _ in range(300)]
    return [*rows, ("en", None), ("de", ""), ("de", "  ,, "), ("en", "the " * 3000), ("en", text(3000)), ("fr", rows[0][1]), ("fr", rows[0][1])]


@pytest.mark.parametrize("least,longest,top,share", [(5, 5, 2000, 100), (2, 3, 7, 100), (20, 5, 50, 60), (10**9, 5, 10, 100)])
def test_phrases(spark, talk, monkeypatch, least, longest, top, share):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 3000)
    monkeypatch.setattr(phrases, "SHARE_KEYS", 50)
    rows = [(i, t, lang, "s", 1, "n", 2) for i, (lang, t) in enumerate(talk)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, phrase string, a int, slice string, score int").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least, longest, top, share).collect())
    assert got == phrases_expected(talk, least, longest, top, share)


def test_phrases_of_no_rows(spark, no_docs):
    assert phrases.collocations(no_docs).count() == 0


@pytest.mark.parametrize("width", [1, 2, 7, 8, 9, 31, 34, 40, 56, 63, 64])
def test_quotient_filters(width):
    rng = np.random.default_rng(width)
    seen, parts = Counter(), []
    for n in (0, 1, 40, 3000):
        keys = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
        keys = np.concatenate([keys, np.repeat(keys[:1], 70_000 if n == 40 else 300)]) & np.uint64((1 << width) - 1)
        assert (qf.restored(qf.permuted(keys, width), width) == keys).all()
        seen.update(keys.tolist())
        parts.append(qf.Filter.from_bytes(qf.Filter.counting(keys, width).to_bytes()))
    whole = qf.merged(parts)
    mixed, counts = whole.entries()
    assert (np.diff(mixed.astype(object)) > 0).all() and dict(zip(qf.restored(mixed, width).tolist(), counts.tolist())) == seen
    for key in [*list(seen)[:30], *range(min(30, 1 << width))]:
        assert whole.count(int(qf.permuted(np.array([key], np.uint64), width)[0])) == seen[key]


# token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(PATH)
    return lambda t: len(coder.encode(t, add_special_tokens=False).ids)


def test_every_prefix(library):
    counter, rng = token_counts.prefix_counts(PATH), random.Random(3)
    bits = ["'re", "'ll", "'s", "'", "!", "don't", " ", "  ", "\n", "\n\n", "\t", "the", "ing", "tion", "日本", "é", " hello", "xxxx", "12", "<|endoftext|>", "<|endo", "...", "　", "\xa0", "'v", "\x1c"]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert counter.prefixes(text).tolist() == [library(text[:i]) for i in range(1, len(text) + 1)], text
        assert counter.totals([text, None, ""]).tolist() == [library(text), 0, 0]


def test_counts(spark, docs, doc_rows, no_docs, library):
    got = token_counts.count_tokens(docs, PATH, limit=50).collect()
    want = [(i, len((t or "").encode()), library(t or ""), library(t or "") > 50) for i, t in doc_rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert token_counts.count_tokens(no_docs, PATH).count() == 0 and token_counts.stored(no_docs, PATH).count() == 0


def test_budgets_without_encoding_again(spark, monkeypatch, library):
    monkeypatch.setattr(token_counts, "BLOCK", 64)
    rng = random.Random(4)
    texts = {i: "".join(rng.choice(["don't ", "we'll", " the", "\n\n", "日本", "  ", "tokens"]) for _ in range(n)) for i, n in enumerate([0, 1, 30, 120, 400])}
    store = token_counts.stored(spark.createDataFrame([*texts.items(), (9, None)], "doc_id bigint, text string"), PATH)
    asked = [(i, k) for i, t in texts.items() for k in {0, 1, 63, 64, 65, len(t) // 2, len(t), len(t) + 1}]
    got = {(r.doc_id, r.chars): r.tokens for r in token_counts.counts_at(store, spark.createDataFrame(asked, "doc_id bigint, chars bigint")).collect()}
    assert got == {(i, k): library(texts[i][:k]) if k <= len(texts[i]) else None for i, k in asked}
    for budget in (0, 1, 10, 10**6):
        want = {i: max(k for k in range(len(t) + 1) if library(t[:k]) <= budget) for i, t in texts.items() if t}
        assert {r.doc_id: r.chars for r in token_counts.truncation(store, budget).collect()} == want
        assert all(r.tokens == library(texts[r.doc_id][: r.chars]) for r in token_counts.truncation(store, budget).collect())


def test_one_very_long_word(library):
    word = "x" * 3_000_000
    assert token_counts.prefix_counts(PATH).totals([word, "ab" * 200_000]).tolist() == [library(word), library("ab" * 200_000)]
