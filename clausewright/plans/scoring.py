"""Queries on answer keys: every order is a key row, every line a finding, errors of the customer are flags. And on evidence batches by a manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, monitor
from ..session import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def tables(spark, sf):
    o, lines, e = (table(spark, sf, t) for t in ("orders", "lineitem", "events"))
    k = F.col("o_orderkey")
    kind = F.element_at(F.create_map(*map(F.lit, ["1-URGENT", "mutation", "2-HIGH", "decoy", "3-MEDIUM", "injection"])), F.col("o_orderpriority"))
    rule = F.when(k % 4 == 0, "known_gap").when(k % 4 == 1, "no_gap").when(k % 4 == 2, "accept_set").otherwise("excluded")
    span = F.struct((k % 50).cast("bigint").alias("s"), (k % 50 + k % 9).cast("bigint").alias("e"))
    keys = o.select(F.col("o_custkey").alias("policy"), k.alias("key_id"), F.coalesce(kind, F.lit("real_finding")).alias("kind"), rule.alias("rule"), F.array(k % 7, k % 5).alias("refs"), F.array(span).alias("spans"), F.array(F.lit("R")).alias("gap_types"), F.array(F.lit("O")).alias("verdicts"))
    at = (F.col("l_suppkey") % 60).cast("bigint")
    tier = F.when(F.col("l_quantity") > 25, "high").when(F.col("l_quantity") > 10, "review")
    found = lines.join(o.select("o_orderkey", "o_custkey", "o_orderstatus"), lines["l_orderkey"] == o["o_orderkey"])
    findings = found.select(F.col("o_custkey").alias("policy"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 7).alias("ref"), F.nullif("l_returnflag", F.lit("N")).alias("gap_type"), F.col("o_orderstatus").alias("verdict"), at.alias("s"), (at + F.col("l_linenumber")).alias("e"), tier.alias("tier"))
    flags = e.where("event_type = 'error'").select(F.col("user_id").alias("policy"), (F.col("event_id") % 60).alias("s"), (F.col("event_id") % 60 + 5).alias("e"))
    return keys, findings, flags


PAIRS_SQL = """WITH k AS (SELECT o_custkey AS policy, o_orderkey AS key_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'mutation' WHEN '2-HIGH' THEN 'decoy' WHEN '3-MEDIUM' THEN 'injection' ELSE 'real_finding' END AS kind,
  CASE o_orderkey % 4 WHEN 0 THEN 'known_gap' WHEN 1 THEN 'no_gap' WHEN 2 THEN 'accept_set' ELSE 'excluded' END AS rule, list_distinct([o_orderkey % 7, o_orderkey % 5]) AS refs, o_orderkey % 50 AS ks, o_orderkey % 50 + o_orderkey % 9 AS ke FROM orders),
f AS (SELECT o_custkey AS policy, l_orderkey * 10 + l_linenumber AS id, l_partkey % 7 AS ref, nullif(l_returnflag, 'N') AS gap_type, o_orderstatus AS verdict, l_suppkey % 60 AS s, l_suppkey % 60 + l_linenumber AS e, CASE WHEN l_quantity > 25 OR l_quantity <= 10 THEN 'high' ELSE 'review' END AS tier FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT k.policy, key_id, kind, rule, id, gap_type IS NOT NULL AS gap, tier, gap_type, (ke = ks OR (s < ke AND ks < e)) AS in_edit, (s < ke AND ks < e) AS in_span, verdict = 'O' AS verdict_ok, coalesce(gap_type = 'R', false) OR verdict = 'O' AS accepted FROM k JOIN f ON f.policy = k.policy AND list_contains(refs, ref)),
n AS (SELECT DISTINCT policy, id FROM p WHERE kind = 'real_finding' AND rule = 'known_gap' AND gap AND in_span),
r AS (SELECT p.* FROM p ANTI JOIN n ON p.policy = n.policy AND p.id = n.id),
g AS (SELECT policy, key_id, bool_or(gap AND in_edit) AS strict, bool_or(gap AND NOT in_edit) AS near, bool_or(gap AND in_edit AND accepted) AS typed, max(CASE WHEN gap AND in_edit THEN CASE tier WHEN 'high' THEN 2 ELSE 1 END END) AS st, max(CASE WHEN gap AND NOT in_edit THEN CASE tier WHEN 'high' THEN 2 ELSE 1 END END) AS nt, bool_or(gap) AS any_gap, bool_and(verdict_ok) AS all_ok FROM r GROUP BY 1, 2),
h AS (SELECT DISTINCT policy, key_id FROM p WHERE rule = 'known_gap' AND gap AND in_span),
c AS (SELECT DISTINCT k.policy, key_id FROM k JOIN events ON user_id = k.policy AND event_type = 'error' AND event_id % 60 < ke AND ks < event_id % 60 + 5 WHERE kind = 'injection' AND ke > ks),
d AS (SELECT k.policy, k.key_id, k.kind, CASE WHEN k.kind IN ('mutation', 'decoy') THEN coalesce(strict, false) WHEN k.kind = 'injection' THEN c.key_id IS NOT NULL END AS detected, CASE WHEN k.kind = 'mutation' THEN coalesce(typed, false) END AS typed, CASE WHEN k.kind = 'mutation' THEN coalesce(near, false) AND NOT coalesce(strict, false) END AS near_miss,
  CASE CASE k.kind WHEN 'mutation' THEN coalesce(st, nt) WHEN 'decoy' THEN st END WHEN 2 THEN 'high' WHEN 1 THEN 'review' END AS tier,
  CASE WHEN k.kind <> 'real_finding' THEN NULL WHEN k.rule = 'known_gap' THEN CASE WHEN h.key_id IS NOT NULL THEN 'known gap reported' ELSE 'not flagged' END WHEN k.rule = 'excluded' THEN 'excluded' WHEN g.key_id IS NULL THEN 'not assessed' WHEN k.rule = 'no_gap' THEN CASE WHEN any_gap THEN 'false positive' ELSE 'correct' END WHEN all_ok THEN 'correct' ELSE 'wrong' END AS outcome
  FROM k LEFT JOIN g ON g.policy = k.policy AND g.key_id = k.key_id LEFT JOIN h ON h.policy = k.policy AND h.key_id = k.key_id LEFT JOIN c ON c.policy = k.policy AND c.key_id = k.key_id),
u AS (SELECT f.policy, f.id FROM f WHERE gap_type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.policy = f.policy AND n.id = f.id) AND NOT EXISTS (SELECT 1 FROM p WHERE p.policy = f.policy AND p.id = f.id AND p.gap AND (p.kind = 'mutation' OR p.kind = 'decoy' AND p.in_edit OR p.kind = 'real_finding' AND p.rule <> 'known_gap')))
"""


@query(PAIRS_SQL + "SELECT policy, key_id, kind, detected, typed, near_miss, tier, outcome FROM d")
def key_rows_scored(spark, sf):
    return evaluate.scored(*tables(spark, sf)).drop("reported")


@query(PAIRS_SQL + """SELECT d.policy, count(*) FILTER (WHERE kind = 'mutation') AS planted, count(*) FILTER (WHERE kind = 'mutation' AND detected) AS found, count(*) FILTER (WHERE typed) AS typed, count(*) FILTER (WHERE near_miss) AS near, count(*) FILTER (WHERE kind = 'decoy') AS decoys, count(*) FILTER (WHERE kind = 'decoy' AND detected) AS decoys_flagged, count(*) FILTER (WHERE kind = 'injection') AS injections, count(*) FILTER (WHERE kind = 'injection' AND detected) AS injections_caught,
 count(*) FILTER (WHERE outcome = 'correct') AS real_correct, count(*) FILTER (WHERE kind = 'real_finding' AND outcome NOT IN ('excluded', 'known gap reported', 'not flagged')) AS "real", count(*) FILTER (WHERE kind = 'mutation' AND tier = 'high') AS planted_high, count(*) FILTER (WHERE kind = 'mutation' AND tier = 'review') AS planted_review, count(*) FILTER (WHERE kind = 'decoy' AND tier = 'high') AS decoys_high, count(*) FILTER (WHERE kind = 'decoy' AND tier = 'review') AS decoys_review,
 coalesce(max(x.n), 0) AS unkeyed FROM d LEFT JOIN (SELECT policy, count(*) AS n FROM u GROUP BY 1) x ON x.policy = d.policy GROUP BY d.policy""")
def score_card(spark, sf):
    keys, findings, flags = tables(spark, sf)
    return evaluate.score_card(evaluate.scored(keys, findings, flags), evaluate.unkeyed_gaps(keys, findings))


@query("""WITH k AS (SELECT o_orderkey AS key_id, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'evidence' ELSE 'decoy' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'ineffective' ELSE 'effective' END AS expected FROM orders),
t AS (SELECT l_partkey % 40 AS ref, CASE WHEN avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0 END) <= 0.45 THEN 'effective' ELSE 'ineffective' END AS result FROM lineitem GROUP BY 1),
x AS (SELECT key_id, kind, expected, a.result AS ra, b.result AS rb FROM k LEFT JOIN t a ON a.ref = o_custkey % 45 LEFT JOIN t b ON b.ref = key_id % 43)
SELECT key_id, coalesce(ra, rb, 'not tested') AS got, coalesce(ra = 'ineffective', false) OR coalesce(rb = 'ineffective', false) AS has_gap, coalesce(ra, rb, 'not tested') = expected AND (coalesce(ra = 'ineffective', false) OR coalesce(rb = 'ineffective', false)) = (kind = 'evidence') AS "right" FROM x""")
def evidence_key_scored(spark, sf):
    o = table(spark, sf, "orders")
    failed = F.col("o_orderstatus") == "F"
    keys = o.select(F.col("o_orderkey").alias("key_id"), F.when(failed, "evidence").otherwise("decoy").alias("kind"), F.array(F.col("o_custkey") % 45, F.col("o_orderkey") % 43).alias("refs"), F.when(failed, "ineffective").otherwise("effective").alias("expected"))
    dear = F.avg(F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0))
    results = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 40).alias("ref")).agg(F.when(dear <= 0.45, "effective").otherwise("ineffective").alias("result"))
    return evaluate.evidence_scored(keys, results, results.where("result = 'ineffective'"))


@query("""WITH m(file, control, rule, tolerance, deadline) AS (VALUES ('AF', 'c1', 'late', 0.3, 60), ('NO', 'c2', 'late', 0.6, 60), ('RF', 'c3', 'overdue', 0.05, 0), ('AO', 'c4', 'late', 0.5, 10), ('zz', 'c5', 'late', 0.5, 10)),
l AS (SELECT l_returnflag || l_linestatus AS file, o_orderdate::DATE AS begun, l_shipdate::DATE AS done, o_orderdate::DATE AS last, CASE WHEN l_quantity > 25 THEN 'high' ELSE 'low' END AS risk FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
x AS (SELECT m.file, count(*) FILTER (WHERE CASE rule WHEN 'late' THEN done - begun > deadline ELSE last < DATE '2000-01-01' - CASE risk WHEN 'high' THEN 730 ELSE 3650 END END) AS exceptions, count(*) AS total, min(least(begun, done)) AS period_start, max(greatest(begun, done)) AS period_end FROM m JOIN l ON m.file = l.file GROUP BY 1)
SELECT control, m.file, coalesce(exceptions, 0) AS exceptions, coalesce(total, 0) AS total, round(exceptions / total, 4) AS rate, CASE WHEN total IS NULL THEN 'cannot_assess' WHEN exceptions / total <= tolerance THEN 'effective' ELSE 'ineffective' END AS result, period_start, period_end FROM m LEFT JOIN x ON x.file = m.file""")
def manifest_tests(spark, sf):
    """Orders and their lines as logs, a file for each flag and status, tested by what a manifest asks of each."""
    entries = [("AF", "c1", "late", 0.3, "2000-01-01", 60), ("NO", "c2", "late", 0.6, "2000-01-01", 60), ("RF", "c3", "overdue", 0.05, "2000-01-01", 0), ("AO", "c4", "late", 0.5, "2000-01-01", 10), ("zz", "c5", "late", 0.5, "2000-01-01", 10)]
    manifest = spark.createDataFrame(entries, "file string, control string, rule string, tolerance double, as_of string, deadline int")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("begun"))
    logs = table(spark, sf, "lineitem").join(o, "l_orderkey").select(F.concat("l_returnflag", "l_linestatus").alias("file"), F.when(F.col("l_quantity") > 25, "high").otherwise("low").alias("risk"), F.col("begun").alias("last"), "begun", F.col("l_shipdate").cast("date").alias("done"))
    return monitor.tested(logs, manifest).drop("tolerance")
