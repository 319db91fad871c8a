"""Queries on citations, catalogues, links, truths, snapshots and reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display
from ..operators import evaluate, retrieve
from ..operators import records as R
from ..operators.rules import choose
from ..session import table
from ..sources import readers
from .rules import KNN_SQL, nearest

QUERIES, SQL = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


@query(r"""WITH q AS (SELECT doc_id, text, lang, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS item, regexp_replace(trim(unnest(string_split(text, chr(10)))), '\.+$', '') AS quote FROM documents),
a AS (SELECT *, CASE WHEN length(quote) >= 12 AND strpos(text, quote) > 0 THEN strpos(text, quote) - 1 END AS s FROM q),
b AS (SELECT *, s + length(regexp_extract(substr(text, s + 1), '^[^.;\n]*(?:[.;]+[^ \t\n\r\f.;][^.;\n]*)*[.;]*')) AS e FROM a)
SELECT doc_id, item, s, e, CASE WHEN s IS NULL THEN 'rejected' WHEN row_number() OVER (PARTITION BY doc_id, s, e, lang ORDER BY item) > 1 THEN 'duplicate' ELSE 'kept' END AS outcome FROM b""")
def citation_gate(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", F.posexplode(F.split("text", "\n")).alias("at", "quote"))
    items = docs.withColumn("item", F.col("at").cast("bigint") + 1)
    return R.gated(items, "doc_id", "item", "text", "quote", "lang").select("doc_id", "item", "s", "e", "outcome")


@query(r"""WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT *, min(CASE WHEN regexp_matches(line, '^[N-Z]') THEN pos END) OVER (PARTITION BY doc_id) AS numbered FROM l),
o AS (SELECT *, max(CASE WHEN regexp_matches(line, '^[A-M]') AND pos < numbered THEN pos END) OVER (PARTITION BY doc_id) AS opened FROM n), c AS (SELECT *, min(CASE WHEN regexp_matches(line, '[0-9]') AND pos > opened THEN pos END) OVER (PARTITION BY doc_id) AS closed FROM o)
SELECT doc_id, pos FROM c WHERE pos >= opened AND (closed IS NULL OR pos < closed)""")
def selected_lines(spark, sf):
    lines = readers.lines(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    chosen = readers.selected_blocks(lines, "doc_id", "pos", F.col("line").rlike("^[A-M]"), F.col("line").rlike("^[N-Z]"), F.col("line").rlike("[0-9]"))
    return chosen.select("doc_id", F.col("pos").cast("bigint").alias("pos"))


FILES = {"F": ["a.pdf", "b.html"], "O": ["c.pdf", "d.txt"]}


@query("""WITH e AS (SELECT *, nullif(o_orderpriority, '1-URGENT') AS t, CASE o_orderstatus WHEN 'F' THEN ['a.pdf', 'b.html'] WHEN 'O' THEN ['c.pdf', 'd.txt'] ELSE [] END AS files FROM orders)
SELECT o_orderkey, coalesce(t, first_value(t) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS title, coalesce(list_filter(files, lambda f: suffix(f, '.html'))[1], files[1]) AS file FROM e""")
def source_catalogue(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("title"), "o_orderstatus")
    files = F.array().cast("array<string>")
    for status, names in FILES.items():
        files = F.when(F.col("o_orderstatus") == status, F.array(*map(F.lit, names))).otherwise(files)
    entries = R.inherited(o, "o_custkey", ["o_orderdate", "o_orderkey"], ["title"])
    return entries.select("o_orderkey", "title", R.preferred_file(files).alias("file"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN nullif('N' || c_nationkey, 'N7') END, c_mktsegment) AS c_mktsegment, coalesce(CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 0.0::DOUBLE END, c_acctbal) AS c_acctbal FROM customer")
def metadata_backfill(spark, sf):
    c = table(spark, sf, "customer")
    updates = c.where("c_custkey % 3 = 0").select("c_custkey", F.nullif(F.concat(F.lit("N"), F.col("c_nationkey")), F.lit("N7")).alias("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, F.lit(0.0)).alias("c_acctbal"))
    return R.backfilled(c.select("c_custkey", "c_mktsegment", "c_acctbal"), updates, "c_custkey", ["c_mktsegment", "c_acctbal"])


@query("""WITH k AS (SELECT l_orderkey * 10 + l_linenumber AS key_id, l_quantity AS s, l_suppkey AS e, l_returnflag AS action, l_partkey AS ref FROM lineitem WHERE l_orderkey % 2 = 0), r AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_quantity AS s, l_suppkey AS e, l_returnflag AS action, l_partkey AS ref FROM lineitem WHERE l_orderkey % 2 = 1),
x AS (SELECT s, e, action, min(row_id) AS i FROM r GROUP BY s, e, action), y AS (SELECT s, e, min(row_id) AS i FROM r GROUP BY s, e HAVING count(*) = 1), z AS (SELECT action, ref, min(row_id) AS i FROM r GROUP BY action, ref HAVING count(*) = 1)
SELECT key_id, coalesce(x.i, y.i, z.i) AS row_id, CASE WHEN x.i IS NOT NULL THEN 'exact' WHEN y.i IS NOT NULL THEN 'span' WHEN z.i IS NOT NULL THEN 'action_ref' ELSE 'none' END AS level
FROM k LEFT JOIN x ON k.s = x.s AND k.e = x.e AND k.action = x.action LEFT JOIN y ON k.s = y.s AND k.e = y.e LEFT JOIN z ON k.action = z.action AND k.ref = z.ref""")
def three_level_match(spark, sf):
    lines = table(spark, sf, "lineitem")
    rows = lambda name: lines.select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias(name), F.col("l_quantity").alias("s"), F.col("l_suppkey").alias("e"), F.col("l_returnflag").alias("action"), F.col("l_partkey").alias("ref"))
    return R.linked(rows("key_id").where("l_orderkey % 2 = 0"), rows("row_id").where("l_orderkey % 2 = 1"), "key_id", "row_id", ["s", "e"], "action", "ref")


PRECEDENCE = {"2-HIGH": 1, "1-URGENT": 2, "5-LOW": 3}


@query("""WITH r AS (SELECT o_custkey, o_orderstatus AS label, o_orderpriority AS source, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 3 ELSE 9 END, o_orderkey) AS n FROM orders) SELECT o_custkey, label, source FROM r WHERE n = 1""")
def truth_precedence(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("source"))
    return R.truths(o, "o_custkey", choose(F.col("source"), PRECEDENCE, F.lit(9)), "o_orderkey", ["label", "source"])


@query("""SELECT source, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS "both", count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS only_first, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS only_second, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS neither, bool_or(quality = 1 OR toxic = 1) AS either FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def judge_agreement(spark, sf):
    both = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return R.agreement(both, ["source"], F.col("quality") == 1, F.col("toxic") == 1)


@query("""WITH b AS (SELECT o_orderpriority AS p, o_custkey AS v, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2), a AS (SELECT o_orderpriority AS p, o_custkey AS v, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(b.p, a.p) AS o_orderpriority, sum(greatest(0, coalesce(b.n, 0) - coalesce(a.n, 0)))::BIGINT AS removed, sum(greatest(0, coalesce(a.n, 0) - coalesce(b.n, 0)))::BIGINT AS added FROM b FULL JOIN a ON b.p = a.p AND b.v = a.v GROUP BY 1""")
def snapshot_sections(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    return R.section_differences(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_orderpriority", "o_custkey")


@query("""WITH g AS (SELECT l_orderkey, count(*) AS paragraphs, list(DISTINCT l_linenumber) AS have FROM lineitem GROUP BY 1)
SELECT l_orderkey, paragraphs, array_to_string(list_filter(range(1, list_max(have) + 1), lambda x: NOT list_contains(have, x::INT)), ',') AS missing, paragraphs - len(have) AS repeated FROM g""")
def paragraph_sequence(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return R.number_gaps(lines, "l_orderkey", "l_linenumber").withColumn("missing", F.array_join("missing", ","))


@query("""WITH b AS (SELECT CASE WHEN c >= 1.0 THEN '1.00' WHEN c >= 0.95 THEN '0.95 to 0.99' WHEN c >= 0.8 THEN '0.80 to 0.94' ELSE 'below 0.80' END AS band, quality FROM (SELECT (d.doc_id % 51 + 50) / 100.0 AS c, quality FROM documents d JOIN labels USING (doc_id))),
g AS (SELECT band, count(*) FILTER (WHERE quality = 1) AS r, count(*) AS k FROM b GROUP BY 1)
SELECT band, CASE WHEN k >= 30 THEN round(100 * r / k)::BIGINT || ' % of ' || k || ' checked findings in this band were right' ELSE r || ' of ' || k || ' checked findings in this band were right; too few for a percentage' END AS note FROM g""")
def confidence_notes(spark, sf):
    both = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id")
    bands = evaluate.reliability(both, (F.col("doc_id") % 51 + 50) / 100, F.col("quality") == 1)
    return bands.select("band", display.confidence_note(F.col("right"), F.col("known")).alias("note"))


@query(KNN_SQL + """, s2 AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY coalesce(CASE WHEN label % 3 <> 0 THEN label END, 0) DESC, rank) AS new_rank FROM r WHERE rank <= 20) SELECT q_id, i_id, distance, new_rank FROM s2 WHERE new_rank <= 5""")
def rerank_topk(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("i_id"), "label")
    ranked = nearest(spark, sf, 20).join(labels, "i_id")
    score = F.when(F.col("label") % 3 != 0, F.col("label").cast("double"))  # a scorer that fails gives null
    return retrieve.reranked(ranked, ["q_id"], score, ["distance", "i_id"], 5).select("q_id", "i_id", "distance", "new_rank")
