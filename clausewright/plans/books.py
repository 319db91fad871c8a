"""Queries on books of numbered paragraphs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table
from ..sources import inline

QUERIES, SQL = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


@query("""WITH o AS (SELECT o_custkey AS doc, o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
l AS (SELECT doc, n, unnest([0, 1, 2]) AS k, unnest([n || '. The customer settles order ' || o_orderkey || ' no later than 5. June, or 6. June, in this way:', '(1) by its priority ' || o_orderpriority || ', as (2) above; and', '(2) in the state ' || o_orderstatus || '.']) AS text FROM o)
SELECT doc::VARCHAR AS doc, ((n - 1) // 3)::BIGINT AS pos, (row_number() OVER (PARTITION BY doc, (n - 1) // 3 ORDER BY n, k) - 1)::INT AS part, text FROM l""")
def inline_paragraphs(spark, sf):
    """Every three orders of a customer run together in one block, and split into paragraphs and sub-clauses again."""
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = table(spark, sf, "orders").withColumn("n", n)
    text = F.concat(F.col("n").cast("string"), F.lit(". The customer settles order "), F.col("o_orderkey"), F.lit(" no later than 5. June, or 6. June, in this way: (1) by its priority "), F.col("o_orderpriority"), F.lit(", as (2) above; and (2) in the state "), F.col("o_orderstatus"), F.lit("."))
    each = o.select(F.col("o_custkey").alias("doc"), F.floor((F.col("n") - 1) / 3).cast("bigint").alias("pos"), "n", text.alias("text"))
    # three at most in a group
    blocks = each.groupBy("doc", "pos").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("all")).select("doc", "pos", F.array_join("all.text", " ").alias("text"))
    return inline.paragraphs(blocks)
