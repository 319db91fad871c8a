"""The queries of the training-data operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact, fim, packing, phrases, quality, secret_scan, simhash, substring, token_counts, toxicity, warc


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A vocabulary file: in ``folder``, or where the public_tokenizers package has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


OP2_SQL = """
WITH t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
v AS (SELECT DISTINCT conv_id, own, speaker AS view FROM t),
s AS (SELECT t.conv_id, t.own, v.view, t.turn, t.speaker, t.text, t.speaker = v.view AS loss,
  CASE WHEN t.speaker = v.view THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>user name=' || t.speaker || chr(10) END || t.text || '<|im_end|>' || chr(10) AS segment
  FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id AND t.own IS NOT DISTINCT FROM v.own),
p AS (SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(segment)) OVER w - length(segment) AS BIGINT) AS char_start FROM s
  WINDOW w AS (PARTITION BY conv_id, own, view ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, view, turn, position, speaker, segment, loss, char_start, char_start + length(segment) AS char_end,
  CASE WHEN loss THEN char_start + 22 ELSE char_start END AS mask_start, CASE WHEN loss THEN char_start + length(segment) - 1 ELSE char_start END AS mask_end FROM p
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).drop("url", "payload")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, list_reduce(list_transform(string_split(lower(sha1(html)), ''), lambda x: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', x) - 1)::INT + 1, 4)), lambda a, b: a || b) AS bits FROM p),
g AS (SELECT html, min(page_id) AS least FROM p GROUP BY html)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT + 1)::INT, 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM least THEN NULL ELSE least END AS refers_to
FROM h JOIN g USING (html)
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    n = (F.octet_length("ids") / 4).cast("bigint")
    return rows.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents")).drop("found")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
a AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS start, words FROM w WHERE len(words) >= 20),
k AS (SELECT doc_id, start, row_number() OVER (PARTITION BY array_to_string(words[start:start + 19], ' ') ORDER BY doc_id, start) AS nth FROM a),
r AS (SELECT doc_id, list(start) AS starts FROM k WHERE nth > 1 GROUP BY doc_id),
p AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM (SELECT doc_id, unnest(starts) AS s FROM r)),
n AS (SELECT p.doc_id, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY p.i) FILTER (WHERE c.i IS NULL) AS kept FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id)
"""


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transform(table(spark, sf_dir, "documents"), outputs=False).drop("pieces", "output")


OP11_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w,
  sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
d AS (SELECT doc_id, t, w, len(w) AS n, list_transform([1, 9, 17, 25], lambda i: list_reduce(list_transform(range(0, 8), lambda j: instr('0123456789abcdef', substr(h, i::INT + j::INT, 1)) - 1), lambda a, b: a * 16 + b)) AS x FROM t),
c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1))::INT AS p, greatest(x[1] % (n + 1), x[2] % (n + 1))::INT AS q,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
s AS (SELECT *, array_to_string(w[1:p], '') AS a, array_to_string(w[p + 1:q], '') AS b, array_to_string(w[q + 1:], '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM s
"""


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\\x20\\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m) GROUP BY ALL HAVING count(*) >= 100),
k AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (SELECT k.lang, k.m, k.phrase, k.a, k.k, l.a AS l, r.a AS r, n, (1000::HUGEINT * k.a * n) // (l.a::HUGEINT * r.a) AS score FROM k JOIN t ON t.lang = k.lang
  JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:], ' ')),
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[j:j + m - 1], ' ') AS phrase, max(a) AS longer FROM
  (SELECT f.lang, string_split(phrase, ' ') AS w, a, x.m, unnest(range(1, f.m - x.m + 2)) AS j FROM f, (SELECT unnest([2, 3, 4]) AS m) x WHERE x.m < f.m) GROUP BY ALL),
o AS (SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank FROM c LEFT JOIN i ON i.lang = c.lang AND i.phrase = c.phrase WHERE longer IS NULL OR longer < a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_chat_rotation": op2_chat_rotation,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_simhash": op5_simhash,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_bpe": op7_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_secret_scan": op9_secret_scan,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_phrases": op12_phrases,
    "op13_token_counts": op13_token_counts,
}
SQL: dict[str, str] = {"op2_chat_rotation": OP2_SQL, "op4_warc": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op10_substring_dedup": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_phrases": OP12_SQL}
