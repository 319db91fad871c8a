"""Queries on evidence, versions and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import versioned as V
from ..session import table
from ..streaming.evidence import windowed_rates

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


WEEKLY = """
WITH c AS (SELECT event_type, date_trunc('week', ts)::DATE AS week, count(*) FILTER (WHERE value > 100) AS exceptions, count(*) AS total FROM events GROUP BY 1, 2)
SELECT event_type, week, exceptions, total, round(exceptions / total, 4) AS rate, CASE WHEN exceptions / total <= 0.05 THEN 'effective' ELSE 'ineffective' END AS result FROM c
"""


def weekly(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.to_date(F.date_trunc("week", "ts")).alias("week"), "value")
    return E.operating_test(rows, ["event_type", "week"], F.col("value") > 100)


@query(WEEKLY)
def evidence_operating_test(spark, sf):
    return weekly(spark, sf)


@query(f"""
WITH r AS ({WEEKLY}), p AS (SELECT event_type, week, result, lag(result) OVER (PARTITION BY event_type ORDER BY week) AS previous FROM r)
SELECT event_type, week, previous, result, CASE WHEN result = 'cannot_assess' THEN 'cannot_assess' WHEN result = 'ineffective' AND previous = 'ineffective' THEN 'still_failing'
  WHEN result = 'ineffective' THEN 'newly_failing' WHEN previous = 'ineffective' THEN 'recovered' ELSE 'healthy' END AS transition FROM p
""")
def evidence_transitions(spark, sf):
    return E.transitions(weekly(spark, sf), ["event_type"], ["week"]).select("event_type", "week", "previous", "result", "transition")


@query("""
WITH c AS (SELECT event_type, to_timestamp(floor(epoch(ts) / 604800) * 604800) AT TIME ZONE 'UTC' AS window_start, count(*) FILTER (WHERE value > 100) AS exceptions, count(*) AS total FROM events GROUP BY 1, 2)
SELECT epoch(window_start)::BIGINT AS window_start, event_type, exceptions, total, round(exceptions / total, 4) AS rate, CASE WHEN exceptions / total <= 0.05 THEN 'effective' ELSE 'ineffective' END AS result FROM c
""")
def evidence_windows(spark, sf):
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed_rates(rows, ["event_type"], F.col("value") > 100)
    return out.drop("window_end").withColumn("window_start", F.unix_timestamp("window_start"))


@query("""
WITH m AS (SELECT o_orderpriority AS priority, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) > 30 AS late FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
c AS (SELECT priority, count(*) FILTER (WHERE late) AS exceptions, count(*) AS total FROM m GROUP BY 1)
SELECT priority, exceptions, total, round(exceptions / total, 4) AS rate, CASE WHEN exceptions / total <= 0.05 THEN 'effective' ELSE 'ineffective' END AS result FROM c
""")
def late_delivery_test(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("done"))
    both = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("begun")).join(lines, "o_orderkey")
    return E.operating_test(both, ["priority"], E.late(F.col("begun"), F.col("done"), 30))


GRADES = {"BUILDING": 2, "AUTOMOBILE": 8}


@query("""
WITH l AS (SELECT o_custkey, max(o_orderdate)::DATE AS last FROM orders GROUP BY 1),
c AS (SELECT c_mktsegment AS grade, count(*) FILTER (WHERE last < DATE '2001-01-01' - CASE c_mktsegment WHEN 'BUILDING' THEN 730 WHEN 'AUTOMOBILE' THEN 2920 END) AS exceptions, count(*) AS total FROM customer JOIN l ON c_custkey = o_custkey GROUP BY 1)
SELECT grade, exceptions, total, round(exceptions / total, 4) AS rate, CASE WHEN exceptions / total <= 0.05 THEN 'effective' ELSE 'ineffective' END AS result FROM c
""")
def overdue_by_grade(spark, sf):
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_date(F.max("o_orderdate")).alias("last"))
    both = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("grade")).join(last, "c_custkey")
    return E.operating_test(both, ["grade"], E.overdue(F.col("last"), F.col("grade"), F.lit("2001-01-01").cast("date"), GRADES))


@query("""
WITH p AS (SELECT p_partkey, nullif(p_brand, 'Brand#1') AS owner, CASE WHEN p_size % 2 = 0 THEN p_size END AS frequency, CASE WHEN p_size % 3 = 0 THEN p_size END AS threshold, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS evidence FROM part),
m AS (SELECT p_partkey, array_to_string(list_filter([CASE WHEN owner IS NULL THEN 'owner' END, CASE WHEN frequency IS NULL AND threshold IS NULL THEN 'frequency or threshold' END, CASE WHEN evidence IS NULL THEN 'evidence' END], lambda x: x IS NOT NULL), ', ') AS missing FROM p)
SELECT p_partkey, missing, CASE WHEN missing = '' THEN 'effective' ELSE 'not_effective' END AS result FROM m
""")
def design_test_missing(spark, sf):
    part = table(spark, sf, "part")
    missing = E.missing_parts(F.nullif(F.col("p_brand"), F.lit("Brand#1")), F.when(F.col("p_size") % 2 == 0, F.col("p_size")), F.when(F.col("p_size") % 3 == 0, F.col("p_size")), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")))
    return part.select("p_partkey", missing.alias("m")).select("p_partkey", F.array_join("m", ", ").alias("missing"), E.design_result(F.col("m")).alias("result"))


VERSIONS = "WITH v AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate AS effective_from, lead(o_orderdate) OVER w AS effective_to, row_number() OVER w AS version FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"


def order_versions(spark, sf):
    return V.history(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")


@query(VERSIONS + " SELECT o_custkey, o_orderkey, version, epoch(effective_from)::BIGINT AS valid_from, epoch(effective_to)::BIGINT AS valid_to FROM v")
def version_history(spark, sf):
    return order_versions(spark, sf).select("o_custkey", "o_orderkey", "version", F.unix_timestamp(F.col("effective_from").cast("timestamp")).alias("valid_from"), F.unix_timestamp(F.col("effective_to").cast("timestamp")).alias("valid_to"))


@query(VERSIONS + " SELECT o_custkey, o_orderkey, o_totalprice FROM v WHERE effective_from <= TIMESTAMP '1997-06-01' AND (effective_to IS NULL OR effective_to > TIMESTAMP '1997-06-01')")
def asof_orders(spark, sf):
    when = F.lit("1997-06-01").cast("timestamp_ntz")
    return order_versions(spark, sf).where(V.in_force(when)).select("o_custkey", "o_orderkey", "o_totalprice")


@query(VERSIONS + " SELECT o_custkey, o_orderkey, version FROM v WHERE effective_to IS NULL")
def current_orders(spark, sf):
    return V.current(order_versions(spark, sf).withColumn("superseded_at", F.col("effective_to"))).select("o_custkey", "o_orderkey", "version")


def bitemporal(spark, sf):
    closed = F.col("o_orderkey") % 3 == 0
    rows = order_versions(spark, sf)
    return rows.withColumns({"recorded_at": F.col("effective_from"), "superseded_at": F.when(closed, F.col("effective_to"))})


@query(VERSIONS + """, b AS (SELECT *, effective_from AS recorded_at, CASE WHEN o_orderkey % 3 = 0 THEN effective_to END AS superseded_at FROM v)
SELECT o_custkey, o_orderkey FROM b WHERE recorded_at <= TIMESTAMP '1997-01-01' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '1997-01-01') AND effective_from <= TIMESTAMP '1996-06-01' AND (effective_to IS NULL OR effective_to > TIMESTAMP '1996-06-01')""")
def asof_bitemporal(spark, sf):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return V.as_of(bitemporal(spark, sf), at("1996-06-01"), at("1997-01-01")).select("o_custkey", "o_orderkey")


@query(VERSIONS + """, b AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN effective_to END AS superseded_at FROM v)
SELECT o_custkey, o_orderkey FROM b WHERE superseded_at IS NULL AND effective_from <= TIMESTAMP '1996-06-01' AND (effective_to IS NULL OR effective_to > TIMESTAMP '1996-06-01')""")
def asof_current_belief(spark, sf):
    return V.as_of_current_belief(bitemporal(spark, sf), F.lit("1996-06-01").cast("timestamp_ntz")).select("o_custkey", "o_orderkey")


def two_snapshots(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    before = o.where("o_orderkey % 7 <> 1")
    after = o.where("o_orderkey % 11 <> 2").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return before, after


SNAPSHOTS = "WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 1), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 11 <> 2)"


@query(SNAPSHOTS + """, j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey IS NULL AS is_new, b.o_orderkey IS NULL AS is_gone,
  a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus AND a.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority AS same FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT o_orderkey, unnest(CASE WHEN is_new THEN ['insert'] WHEN is_gone THEN ['keep'] WHEN same THEN ['skip'] ELSE ['close', 'insert'] END) AS action FROM j""")
def upsert_if_changed(spark, sf):
    return V.upsert_changes(*two_snapshots(spark, sf), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query(SNAPSHOTS + " SELECT o_orderkey, o_orderstatus FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)")
def insert_new_only(spark, sf):
    before, after = two_snapshots(spark, sf)
    return V.insert_new(before, after, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("""WITH a AS (SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 1),
d AS (SELECT *, 'removed' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'added' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT l_returnflag, l_linestatus, l_linenumber, side, count(*) AS n FROM d GROUP BY ALL""")
def snapshot_diff(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber")
    part = lambda k: lines.where(f"l_orderkey % 2 = {k}").drop("l_orderkey")
    return V.multiset_difference(part(0), part(1)).groupBy("l_returnflag", "l_linestatus", "l_linenumber", "side").agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT sha256(concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority)) AS h FROM orders)
SELECT count(*) AS n, concat_ws('-', sum(('0x' || substr(h, 1, 13))::BIGINT), sum(('0x' || substr(h, 14, 13))::BIGINT), sum(('0x' || substr(h, 27, 13))::BIGINT), sum(('0x' || substr(h, 40, 13))::BIGINT)) AS digest FROM h""")
def snapshot_digest(spark, sf):
    return V.digest(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("SELECT c_custkey, o_orderkey, o_orderstatus FROM (SELECT o_custkey AS c_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_per_key(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_orderdate")
    return V.latest(o, ["c_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("c_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, max(o_orderdate)::DATE AS captured FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderdate < TIMESTAMP '1996-01-01' + to_days((c_custkey % 365)::INT) GROUP BY 1")
def capture_before_limit(spark, sf):
    from ..sources.readers import capture_before

    both = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("captured"))
    limit = both.withColumn("limit_date", F.date_add(F.lit("1996-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int")).cast("timestamp_ntz"))
    return capture_before(limit, "c_custkey", "captured", "limit_date").join(table(spark, sf, "customer").select("c_custkey"), "c_custkey", "left_semi").select("c_custkey", F.to_date("captured").alias("captured"))
