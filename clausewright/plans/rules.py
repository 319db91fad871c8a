"""Queries on decision tables, joins, aggregates and ranking."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import calls, evaluate, guard, judge, retrieve
from ..operators import rules as R
from ..operators import versioned as V
from ..session import settled, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def case(column, pairs, default="NULL"):
    return f"CASE {' '.join(f'WHEN {column} = {a} THEN {b}' for a, b in pairs)} ELSE {default} END"


# decision tables over rows of lineitem and part

VERDICTS = {"A": "missing", "N": "covered", "R": "partial"}
ISSUES = dict(enumerate([*R.GAP_BY_ISSUE, "other"]))
JUDGED_SQL = f"""WITH j AS (SELECT l_orderkey, l_linenumber, {case('l_returnflag', [(repr(a), repr(b)) for a, b in VERDICTS.items()])} AS verdict,
{case('l_partkey % 8', [(a, repr(b)) for a, b in ISSUES.items()])} AS issue, CASE WHEN l_linestatus = 'O' THEN 'may' ELSE 'must' END AS modality FROM lineitem),
g AS (SELECT *, CASE WHEN verdict = 'missing' THEN 'missing_control' WHEN issue = 'optional_not_mandatory' THEN CASE WHEN modality <> 'may' THEN 'weak_modality' END
WHEN verdict = 'partial' THEN {case('issue', [(repr(a), repr(b)) for a, b in R.GAP_BY_ISSUE.items()], "'unspecified'")} WHEN issue = 'no_owner_or_evidence' THEN 'design_deficiency' END AS gap_type FROM j)"""


def judged(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R.choose(F.col("l_returnflag"), VERDICTS).alias("verdict"), R.choose(F.col("l_partkey") % 8, ISSUES).alias("issue"), F.when(F.col("l_linestatus") == "O", "may").otherwise("must").alias("modality"))
    return lines.withColumn("gap_type", R.gap_type(F.col("verdict"), F.col("issue"), F.col("modality")))


@query(JUDGED_SQL + " SELECT verdict, issue, modality, gap_type, count(*) AS n FROM g GROUP BY ALL")
def gap_rules(spark, sf):
    return judged(spark, sf).groupBy("verdict", "issue", "modality", "gap_type").agg(F.count("*").alias("n"))


THEMES = [("steel", "critical", "STEEL"), ("brass", "high", "BRASS|COPPER"), ("small", "low", "SMALL")]
RISK_SQL = f"""WITH p AS (SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)STEEL') THEN 'critical' WHEN regexp_matches(p_type, '(?i)BRASS|COPPER') THEN 'high' WHEN regexp_matches(p_type, '(?i)SMALL') THEN 'low'
 WHEN regexp_matches(p_name, '(?i)STEEL') THEN 'critical' WHEN regexp_matches(p_name, '(?i)BRASS|COPPER') THEN 'high' WHEN regexp_matches(p_name, '(?i)SMALL') THEN 'low' ELSE 'medium' END AS inherent,
 {case('p_size % 10', [(i, repr(k)) for i, k in enumerate(R.GAP_FACTORS)], "'else'")} AS gap FROM part),
x AS (SELECT *, CAST({case('inherent', [(repr(a), b) for a, b in R.LEVELS.items()])} AS DOUBLE) * CAST({case('gap', [(repr(a), b) for a, b in R.GAP_FACTORS.items()], 0.5)} AS DOUBLE) AS product FROM p)
SELECT p_partkey, inherent, gap, CASE WHEN product >= 3.5 THEN 'critical' WHEN product >= 2.4 THEN 'high' WHEN product >= 1.4 THEN 'medium' ELSE 'low' END AS residual, round(product / 4, 3) AS priority,
 (DATE '2026-01-01' + to_days(CASE WHEN product >= 3.5 THEN 30 WHEN product >= 2.4 THEN 60 WHEN product >= 1.4 THEN 90 ELSE 180 END))::DATE AS due, CASE WHEN gap IN ('operating_failure', 'design_deficiency') THEN '1LoD' ELSE '2LoD' END AS owner FROM x"""


def risks(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", R.first_theme(F.col("p_type"), F.col("p_name"), THEMES)["level"].alias("inherent"), R.choose(F.col("p_size") % 10, dict(enumerate(R.GAP_FACTORS)), F.lit("else")).alias("gap"))
    scored = part.withColumn("risk", R.risk(F.col("inherent"), F.col("gap")))
    return scored.select("p_partkey", "inherent", "gap", "risk.residual", "risk.priority", R.due_date(F.col("risk.residual"), F.lit("2026-01-01").cast("date")).alias("due"), R.owner(F.col("gap")).alias("owner"))


@query(RISK_SQL)
def risk_rank(spark, sf):
    return risks(spark, sf)


@query(f"WITH r AS ({RISK_SQL}) SELECT p_partkey, priority, inherent FROM r ORDER BY priority DESC, p_partkey LIMIT 50")
def review_queue_topn(spark, sf):
    return risks(spark, sf).select("p_partkey", "priority", "inherent").orderBy(F.desc("priority"), "p_partkey").limit(50)


@query(f"WITH r AS ({RISK_SQL}) SELECT inherent, count(*) FILTER (WHERE residual = 'critical') AS critical, count(*) FILTER (WHERE residual = 'high') AS high, count(*) FILTER (WHERE residual = 'medium') AS medium, count(*) FILTER (WHERE residual = 'low') AS low FROM r GROUP BY 1")
def risk_tier_matrix(spark, sf):
    return risks(spark, sf).groupBy("inherent").pivot("residual", ["critical", "high", "medium", "low"]).agg(F.count(F.lit(1))).na.fill(0)


KINDS = ["number_differs", "same", "adds_words", "optional", "loose"]
TIER_IN_SQL = f"""WITH t AS (SELECT o_orderkey, {case('o_orderkey % 5', [(i, repr(k)) for i, k in enumerate(KINDS)])} AS kind, o_orderkey % 3 = 0 AS weaker, o_custkey % 2 = 0 AS has_gap, o_orderstatus = 'P' AS technical, (o_orderkey % 100) / 100.0 AS overlap,
 CASE WHEN o_orderpriority LIKE '1%' THEN 'sop_system' ELSE 'policy' END AS level FROM orders)"""


def tier_inputs(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", R.choose(F.col("o_orderkey") % 5, dict(enumerate(KINDS))).alias("kind"), (F.col("o_orderkey") % 3 == 0).alias("weaker"), (F.col("o_custkey") % 2 == 0).alias("has_gap"), (F.col("o_orderstatus") == "P").alias("technical"), (F.col("o_orderkey") % 100 / 100).alias("overlap"), F.when(F.col("o_orderpriority").like("1%"), "sop_system").otherwise("policy").alias("level"))


@query(TIER_IN_SQL + """ SELECT o_orderkey, CASE WHEN kind = 'number_differs' AND weaker THEN 'high' WHEN kind = 'number_differs' THEN 'review' WHEN has_gap AND kind = 'same' THEN 'review' WHEN has_gap AND technical THEN 'review'
 WHEN NOT has_gap AND kind = 'adds_words' THEN 'review' WHEN NOT has_gap AND kind = 'optional' AND overlap >= 0.8 THEN 'high' WHEN NOT has_gap AND kind = 'optional' THEN 'review' WHEN has_gap AND level <> 'policy' THEN 'review' WHEN has_gap THEN 'high' ELSE 'none' END AS tier FROM t""")
def tier_rules(spark, sf):
    t = tier_inputs(spark, sf)
    return t.select("o_orderkey", R.tier(*[F.col(c) for c in ("kind", "weaker", "has_gap", "technical", "overlap", "level")])["tier"].alias("tier"))


@query(TIER_IN_SQL + """, b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'evidence_test' WHEN level <> 'policy' THEN 'procedure_level' WHEN technical THEN 'technical_requirement'
 WHEN kind = 'number_differs' AND NOT weaker THEN 'number_not_weaker' WHEN kind IN ('number_differs', 'optional', 'adds_words') AND has_gap THEN 'judge_and_text' WHEN kind IN ('number_differs', 'optional', 'adds_words') THEN 'text_only'
 WHEN kind = 'same' THEN 'judge_contradicted' ELSE 'judge_only' END AS basis FROM t) SELECT basis, count(*) AS n FROM b GROUP BY 1""")
def confidence_basis(spark, sf):
    check = F.when(F.col("level") != "policy", "level").when(F.col("technical"), "technical").when(F.col("kind") == "number_differs", "number")
    verdict, direction = F.when(F.col("has_gap"), "partial").otherwise("covered"), F.when(F.col("weaker"), "weaker").otherwise("stricter")
    t = tier_inputs(spark, sf)
    return t.groupBy(R.confidence_basis(verdict, F.lit(None).cast("string"), F.col("kind"), check, direction, F.col("o_orderkey") % 17 == 0).alias("basis")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT CASE WHEN c >= 1.0 THEN '1.00' WHEN c >= 0.95 THEN '0.95 to 0.99' WHEN c >= 0.8 THEN '0.80 to 0.94' ELSE 'below 0.80' END AS band, quality FROM (SELECT (d.doc_id % 51 + 50) / 100.0 AS c, quality FROM documents d JOIN labels USING (doc_id)))
SELECT band, count(*) FILTER (WHERE quality = 1) AS "right", count(*) AS known FROM b GROUP BY 1""")
def reliability_bands(spark, sf):
    both = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id")
    return evaluate.reliability(both, (F.col("doc_id") % 51 + 50) / 100, F.col("quality") == 1)


@query("SELECT l_linestatus, CASE WHEN l_tax < 0.05 AND l_discount >= 0.07 THEN 'auto' ELSE 'escalated' END AS status, count(*) AS n FROM lineitem GROUP BY 1, 2")
def mapping_status(spark, sf):
    status = R.mapping_status(F.col("l_tax") < 0.05, F.col("l_discount"), 0.07)
    return table(spark, sf, "lineitem").groupBy("l_linestatus", status.alias("status")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT o_orderkey AS gap_id, CASE o_orderstatus WHEN 'F' THEN 'closed' ELSE 'open' END AS status, 'review' AS tier, 'partial' AS verdict FROM orders),
d AS (SELECT o_orderkey AS gap_id, CASE o_orderkey % 6 WHEN 0 THEN 'confirm' WHEN 1 THEN 'dismiss' WHEN 2 THEN 'resolve' WHEN 3 THEN 'accept' ELSE 'other' END AS decision, CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE 'r' END AS reviewer FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0),
o AS (SELECT g.*, decision, CASE WHEN decision IS NULL THEN 'none' WHEN decision = 'other' THEN 'unknown decision' WHEN trim(reviewer) = '' THEN 'reviewer and reason required' WHEN status <> 'open' THEN 'not open' ELSE 'applied' END AS outcome FROM g LEFT JOIN d USING (gap_id))
SELECT gap_id, outcome, CASE WHEN outcome <> 'applied' OR decision = 'confirm' THEN status WHEN decision = 'accept' THEN 'accepted' ELSE 'closed' END AS status_after,
 CASE WHEN outcome = 'applied' AND decision = 'confirm' THEN 'high' ELSE tier END AS tier_after, CASE WHEN outcome = 'applied' AND decision = 'dismiss' THEN 'covered' ELSE verdict END AS verdict_after FROM o""")
def review_decisions(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("gap_id"), "o_orderstatus")
    gaps = o.select("gap_id", F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"), F.lit("review").alias("tier"), F.lit("partial").alias("verdict"))
    made = o.where("gap_id % 2 = 0 OR gap_id % 3 = 0").select("gap_id", R.choose(F.col("gap_id") % 6, dict(enumerate(R.DECISIONS)), F.lit("other")).alias("decision"), F.when(F.col("gap_id") % 4 == 0, " ").otherwise("r").alias("reviewer"), F.lit("why").alias("reason"))
    return R.review(gaps, made).select("gap_id", "outcome", "status_after", "tier_after", "verdict_after")


# applicability: sources as owners, frequent words as vocabulary

WHOLE = r"(^|\s){}($|[\s,.])"  # the same in every regular expression dialect
VOCAB = [(i, a, v, WHOLE.format(v)) for i, (a, v) in enumerate([("kind", "with"), ("kind", "que"), ("scope", "sich"), ("scope", "para"), ("mode", "this")])]
VOCAB_SQL = "VALUES " + ", ".join(f"({o}, '{a}', '{v}', '{p}')" for o, a, v, p in VOCAB)
FACTS = [("kind", "with", "has"), ("kind", "que", "not_offered"), ("scope", "sich", "not_offered"), ("mode", "this", "has")]
FACTS_SQL = "VALUES " + ", ".join(str(f) for f in FACTS)


def vocabulary(spark):
    return spark.createDataFrame(VOCAB, "ord int, attribute string, value string, pattern string")


@query(f"""WITH v(ord, attribute, value, pattern) AS ({VOCAB_SQL}), h AS (SELECT source, attribute, value, doc_id, row_number() OVER (PARTITION BY source, attribute, value ORDER BY doc_id) AS n FROM documents, v WHERE regexp_matches(text, pattern))
SELECT source, attribute, value, doc_id FROM h WHERE n = 1""")
def vocab_profile(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return R.profile(docs, vocabulary(spark), "source", "doc_id", "text").select("source", "attribute", "value", "doc_id")


ANSWER_SQL = f"""WITH v(ord, attribute, value, pattern) AS ({VOCAB_SQL}), f0(attribute, value, state) AS ({FACTS_SQL}), h AS (SELECT doc_id, v.* FROM documents, v WHERE regexp_matches(text, pattern))"""
DECIDED_SQL = """ SELECT doc_id, CASE WHEN bool_and(s = 'has') THEN 'yes' WHEN bool_and(s = 'not_offered') THEN 'no' ELSE 'conditional' END AS answer, coalesce(arg_min(CASE WHEN s <> 'has' THEN attribute || '=' || value END, CASE WHEN s <> 'has' THEN ord END), '') AS reason
 FROM (SELECT h.*, coalesce(state, 'unknown') AS s FROM h LEFT JOIN f USING (attribute, value)) GROUP BY 1"""


def facts(spark):
    return spark.createDataFrame(FACTS, "attribute string, value string, state string")


@query(ANSWER_SQL + ", f AS (SELECT * FROM f0)" + DECIDED_SQL)
def applicability_decide(spark, sf):
    hits = R.vocabulary_hits(table(spark, sf, "documents"), vocabulary(spark), "doc_id", "text")
    return R.applicable(hits, facts(spark), "doc_id")


@query(ANSWER_SQL + ", a AS (WITH f AS (SELECT * FROM f0)" + DECIDED_SQL + "), b AS (WITH f AS (SELECT attribute, value, CASE WHEN value = 'with' THEN 'not_offered' ELSE state END AS state FROM f0)" + DECIDED_SQL + ") SELECT a.doc_id, a.answer AS before, b.answer AS after FROM a JOIN b USING (doc_id) WHERE a.answer <> b.answer")
def applicability_what_if(spark, sf):
    hits = R.vocabulary_hits(table(spark, sf, "documents"), vocabulary(spark), "doc_id", "text")
    a = R.applicable(hits, facts(spark), "doc_id").select("doc_id", F.col("answer").alias("before"))
    b = R.applicable(hits, R.without(facts(spark), "kind", "with"), "doc_id").select("doc_id", F.col("answer").alias("after"))
    return a.join(b, "doc_id").where("before <> after")


# joins

@query("SELECT o_orderkey, l_linenumber, l_quantity FROM (SELECT o_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY o_orderkey ORDER BY (l_returnflag = o_orderstatus) DESC, l_quantity DESC, l_linenumber) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND o_orderpriority LIKE '1%') WHERE n = 1")
def best_match_lateral(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    both = o.join(lines, (F.col("o_orderkey") == F.col("l_orderkey")) & F.col("o_orderpriority").like("1%"), "left")
    return V.latest(both, ["o_orderkey"], [F.desc_nulls_last(F.col("l_returnflag") == F.col("o_orderstatus")), F.desc("l_quantity"), F.asc("l_linenumber")]).select("o_orderkey", "l_linenumber", "l_quantity")


@query("WITH t AS (SELECT o_custkey, list(o_orderkey) AS ids FROM orders GROUP BY 1) SELECT t.o_custkey, l_linenumber, count(*) AS n FROM (SELECT o_custkey, unnest(ids) AS id FROM t) t JOIN lineitem ON id = l_orderkey GROUP BY 1, 2")
def array_any_join(spark, sf):
    held = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("ids"))
    return held.select("o_custkey", F.explode("ids").alias("l_orderkey")).join(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey").groupBy("o_custkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(max(o_totalprice), 0) AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus <> 'F' GROUP BY 1")
def residual_left_join(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    both = table(spark, sf, "customer").select("c_custkey").join(o, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderstatus") != "F"), "left")
    return both.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.coalesce(F.max("o_totalprice"), F.lit(0.0)).alias("top"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_anti_join(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice")
    kept = c.join(o, "c_custkey", "left_semi").join(o.where("o_totalprice > 400000"), "c_custkey", "left_anti")
    pending = o.where("o_orderstatus = 'P'").select("c_custkey").distinct().withColumn("p", F.lit(True))
    return kept.join(pending, "c_custkey", "left").select("c_custkey", F.coalesce("p", F.lit(False)).alias("pending"))


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON coalesce(nullif(s_nationkey, 3), 7) = n_nationkey")
def coalesce_join(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.coalesce(F.nullif(F.col("s_nationkey"), F.lit(3)), F.lit(7)).alias("n_nationkey"))
    return s.join(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", "left").select("s_suppkey", "n_name")


@query("""WITH a AS (SELECT o_custkey, nullif(o_orderstatus, 'F') AS st, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2), b AS (SELECT o_custkey, nullif(o_orderstatus, 'F') AS st, count(*) AS m FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2)
SELECT a.o_custkey, a.st, n, m FROM a JOIN b ON a.o_custkey = b.o_custkey AND a.st IS NOT DISTINCT FROM b.st""")
def null_safe_lookup(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("st"))
    part = lambda k, name: o.where(f"o_orderkey % 2 = {k}").groupBy("o_custkey", "st").agg(F.count("*").alias(name))
    a, b = part(0, "n"), part(1, "m").withColumnsRenamed({"o_custkey": "bc", "st": "bst"})
    return a.join(b, (F.col("o_custkey") == F.col("bc")) & F.col("st").eqNullSafe(F.col("bst"))).select("o_custkey", "st", "n", "m")


# aggregates

@query("SELECT 'orders' AS what, count(*) AS n FROM orders UNION ALL SELECT 'lines', count(*) FROM lineitem UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'events', count(*) FROM events")
def overview_counts(spark, sf):
    counts = [("orders", "orders", "true"), ("lines", "lineitem", "true"), ("customers", "customer", "true"), ("open", "orders", "o_orderstatus = 'O'"), ("events", "events", "true")]
    parts = [table(spark, sf, t).where(c).agg(F.count("*").alias("n")).select(F.lit(w).alias("what"), "n") for w, t, c in counts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT event_type, count(*) AS calls, round(sum(round(value * 100)::BIGINT) / 6000000, 6) AS minutes, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def stage_cost(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum(F.round(F.col("value") * 100).cast("bigint")) / 6000000, 6).alias("minutes"), F.countDistinct("user_id").alias("users"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount > 0.05 AND l_tax > 0.05) AS both_high, count(*) FILTER (WHERE l_linestatus = 'O') AS open_lines FROM lineitem")
def conditional_counts(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if((F.col("l_discount") > 0.05) & (F.col("l_tax") > 0.05)).alias("both_high"), F.count_if(F.col("l_linestatus") == "O").alias("open_lines"))


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '+') AS priorities, array_to_string(list_sort(list(o_orderkey))[1:8], ',') AS first_refs FROM orders GROUP BY 1")
def group_string_list(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "+").alias("priorities"), F.array_join(F.slice(F.array_sort(F.collect_list("o_orderkey")), 1, 8), ",").alias("first_refs"))


@query("SELECT user_id, max(event_type) FILTER (WHERE event_id = last_id) AS last_type, max(last_id) AS last_id FROM (SELECT *, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS last_id FROM events) GROUP BY 1")
def latest_profile(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))


@query("SELECT l_suppkey, l_linestatus, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS values FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_linenumber) >= 2")
def distinct_having(spark, sf):
    grouped = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.array_sort(F.collect_set("l_linenumber")).alias("values"))
    return grouped.where(F.size("values") >= 2).withColumn("values", F.array_join("values", ","))


# ranking

@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, (o_orderpriority LIKE '5%'), (o_orderstatus <> 'O'), o_orderkey) AS n FROM orders) WHERE n = 1")
def one_per_group(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    order = [F.desc("o_totalprice"), F.col("o_orderpriority").like("5%"), F.col("o_orderstatus") != "O", F.col("o_orderkey")]
    return V.latest(o, ["o_custkey"], order).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT doc_id, copies FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) - 1 AS copies, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def distinct_by_content(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"), (F.count("*") - 1).alias("copies")).drop("h")


@query("SELECT o_custkey, o_orderkey, concat('C', o_custkey, '-', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS key FROM orders")
def nth_per_group(spark, sf):
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("C"), "o_custkey", F.lit("-"), n).alias("key"))


@query("SELECT doc_id, lang, sample_rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('seed:' || doc_id), doc_id) AS sample_rank FROM documents) WHERE sample_rank <= 20")
def blind_sample(spark, sf):
    return evaluate.blind_sample(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 20, "seed", ["lang"])


# vectors

KNN_SQL = """WITH s AS (SELECT q.vec_id AS q_id, i.vec_id AS i_id, i.label, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS distance FROM embeddings q, embeddings i WHERE q.vec_id % 50 = 0 AND q.vec_id <> i.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, i_id) AS rank FROM s)"""


def nearest(spark, sf, k, asked="id % 50 = 0"):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return retrieve.nearest(vectors.where(asked), vectors, k)


@query(KNN_SQL.replace("q.vec_id % 50 = 0 AND ", "") + " SELECT q_id, i_id, distance, rank FROM r WHERE rank <= 5")
def knn_topk(spark, sf):
    """The five nearest vectors of every vector."""
    return nearest(spark, sf, 5, "true")


@query(KNN_SQL + """, f AS (SELECT *, row_number() OVER (PARTITION BY q_id, label ORDER BY rank) AS of_label FROM r WHERE rank <= 20), k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rank) AS kept_rank FROM f WHERE of_label = 1)
SELECT q_id, kept_rank, distance, i_id, label FROM k WHERE kept_rank <= 3""")
def knn_dedupe(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("i_id"), "label")
    ranked = nearest(spark, sf, 20).join(labels, "i_id").select("q_id", "distance", "i_id", "label")
    return retrieve.greedy_distinct(ranked, ["q_id"], ["distance", "i_id"], 3, lambda x, y: x["label"] == y["label"])


# calls and guard

@query("""WITH c AS (SELECT conv_id, turn, sha256(coalesce(role, '') || '|' || coalesce(text, '')) AS key FROM conversations)
SELECT conv_id, turn, key IN (SELECT key FROM c WHERE conv_id % 2 = 0) AS cached FROM c WHERE conv_id % 2 = 1""")
def cache_hit_miss(spark, sf):
    keyed = table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(F.concat_ws("|", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))), 256).alias("key"))
    return calls.split_by_cache(keyed.where("conv_id % 2 = 1"), keyed.where("conv_id % 2 = 0"), "key").select("conv_id", "turn", "cached")


GUARD = {"that_with": r"(?i)\bthat\b[^.\n]{0,40}\bwith\b", "for_this": r"(?i)\bfor\b[^.\n]{0,30}\bthis\b"}


@query("""WITH s AS (SELECT conv_id, turn, text, unnest(regexp_split_to_array(text, '[.\\n]')) AS sentence, generate_subscripts(regexp_split_to_array(text, '[.\\n]'), 1) AS position FROM conversations),
o AS (SELECT *, coalesce(sum(length(sentence) + 1) OVER (PARTITION BY conv_id, turn ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s),
m AS (SELECT *, array_to_string(list_filter([CASE WHEN regexp_matches(sentence, '(?i)\\bfor\\b[^.\\n]{0,30}\\bthis\\b') THEN 'for_this' END, CASE WHEN regexp_matches(sentence, '(?i)\\bthat\\b[^.\\n]{0,40}\\bwith\\b') THEN 'that_with' END], lambda x: x IS NOT NULL), '+') AS rules, substr(text, off::INT + 1, length(sentence) + 1) AS raw FROM o)
SELECT conv_id, turn, (off + length(raw) - length(ltrim(raw, ' ' || chr(9) || chr(10))))::BIGINT AS char_start, trim(raw, ' ' || chr(9) || chr(10)) AS sentence, rules FROM m WHERE rules <> ''""")
def guard_scan(spark, sf):
    return guard.scan(table(spark, sf, "conversations"), ["conv_id", "turn"], "text", GUARD)


@query("""WITH g AS (SELECT doc_id, source, text FROM documents), k AS (SELECT source, quality, count(*) FILTER (WHERE toxic = 0) AS hits, count(*) AS total FROM g JOIN labels USING (doc_id) GROUP BY 1, 2) SELECT * FROM k""")
def score_by_operator(spark, sf):
    both = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return evaluate.rates(both, ["source", "quality"], F.col("toxic") == 0)


@query("""WITH t AS (SELECT DISTINCT o_custkey, o_orderpriority AS ref FROM orders WHERE o_orderkey % 2 = 0), f AS (SELECT DISTINCT o_custkey, o_orderpriority AS ref FROM orders WHERE o_orderkey % 2 = 1)
SELECT coalesce(t.o_custkey, f.o_custkey) AS o_custkey, count(*) FILTER (WHERE t.ref IS NOT NULL AND f.ref IS NOT NULL) AS found, count(*) FILTER (WHERE f.ref IS NULL) AS missed, count(*) FILTER (WHERE t.ref IS NULL) AS extra FROM t FULL JOIN f ON t.o_custkey = f.o_custkey AND t.ref = f.ref GROUP BY 1""")
def change_found_missed(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("ref"))
    return evaluate.found_missed_extra(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey", "ref")


# judge

ANSWERS_SQL = """SELECT o_orderkey AS obligation, CASE o_orderkey % 5 WHEN 0 THEN 'covered' WHEN 1 THEN 'partial' WHEN 2 THEN 'missing' WHEN 3 THEN 'odd' END AS verdict, CASE WHEN o_orderkey % 5 < 4 THEN CASE o_custkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'no_owner_or_evidence' ELSE 'optional_not_mandatory' END END AS issue,
  CASE WHEN o_orderkey % 7 < 5 THEN 'k' || (o_custkey % 50) END AS control, (o_orderkey % 11) / 10.0 AS confidence, CASE WHEN o_orderkey % 2 = 0 THEN 'must' ELSE 'may' END AS modality, CASE WHEN o_orderkey % 13 > 0 THEN 'k' || (o_orderkey % 40) END AS top FROM orders"""
GATE_SQL = f"""WITH a AS ({ANSWERS_SQL}), b AS (SELECT *, CASE WHEN verdict IS NULL THEN 'no answer' WHEN verdict = 'odd' THEN 'verdict odd, issue ' || issue END AS unclear, control IS NOT NULL AND substr(control, 2)::INT < 40 AS known FROM a),
c AS (SELECT *, CASE WHEN unclear IS NOT NULL THEN top WHEN verdict = 'missing' THEN NULL WHEN known THEN control ELSE top END AS named FROM b), d AS (SELECT *, unclear IS NULL AND verdict <> 'missing' AND named IS NULL AS nothing FROM c),
e AS (SELECT obligation, modality, CASE WHEN unclear IS NOT NULL THEN 'partial' WHEN nothing THEN 'missing' ELSE verdict END AS verdict, CASE WHEN unclear IS NOT NULL THEN 'unclear' ELSE issue END AS issue, named AS control, CASE WHEN unclear IS NOT NULL THEN 0.0 ELSE least(1.0, confidence) END::DOUBLE AS confidence,
 CASE WHEN unclear IS NOT NULL OR nothing THEN false WHEN verdict = 'missing' THEN true ELSE known END AS citation_ok, unclear FROM d),
g AS (SELECT obligation, verdict, issue, control, confidence, citation_ok, CASE WHEN unclear IS NOT NULL THEN 'unspecified' WHEN verdict = 'missing' THEN 'missing_control' WHEN issue = 'optional_not_mandatory' THEN CASE WHEN modality <> 'may' THEN 'weak_modality' END WHEN verdict = 'partial' THEN CASE issue WHEN 'no_owner_or_evidence' THEN 'design_deficiency' ELSE 'unspecified' END WHEN issue = 'no_owner_or_evidence' THEN 'design_deficiency' END AS gap_type, unclear FROM e)"""


def gate(spark, sf):
    """A judge's answers on orders: some of other names, some left out, some naming controls that don't exist."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    verdict = F.when(key % 5 == 0, "covered").when(key % 5 == 1, "partial").when(key % 5 == 2, "missing").when(key % 5 == 3, "odd")
    issue = F.when(key % 5 < 4, F.when(cust % 3 == 0, "none").when(cust % 3 == 1, "no_owner_or_evidence").otherwise("optional_not_mandatory"))
    name = lambda n: F.concat(F.lit("k"), n.cast("string"))
    answers = o.select(key.alias("obligation"), verdict.alias("verdict"), issue.alias("issue"), F.when(key % 7 < 5, name(cust % 50)).alias("control"), F.lit("The bank keeps").alias("control_quote_start"), (key % 11 / 10.0).alias("confidence"))
    tops = F.when(key % 13 > 0, F.array(name(key % 40))).otherwise(F.array().cast("array<string>"))
    obligations = o.select(key.alias("id"), F.when(key % 2 == 0, "must").otherwise("may").alias("modality"), tops.alias("candidates"))
    controls = spark.range(40).select(name(F.col("id")).alias("control"), F.concat(F.lit("The bank keeps record "), F.col("id").cast("string"), F.lit(".")).alias("quote"))
    return judge.gated(answers.where("verdict IS NOT NULL"), obligations, controls)


@query(GATE_SQL + " SELECT * FROM g")
def judge_gate(spark, sf):
    return gate(spark, sf)


@query(GATE_SQL + """ SELECT obligation, control, gap_type, CASE WHEN unclear IS NOT NULL THEN 'medium' WHEN verdict = 'missing' THEN 'high' WHEN verdict = 'partial' THEN 'medium' ELSE 'low' END AS inherent, CASE WHEN unclear IS NOT NULL THEN 0.5 WHEN verdict = 'missing' THEN 0.8 WHEN verdict = 'partial' THEN 0.5 ELSE 0.2 END::DOUBLE AS priority, CASE WHEN unclear IS NOT NULL THEN 'review' END AS tier, CASE WHEN unclear IS NOT NULL THEN 'judge_unclear' END AS "check" FROM g WHERE gap_type IS NOT NULL AND obligation % 4 <> 1""")
def gap_emission(spark, sf):
    levels = table(spark, sf, "orders").select(F.col("o_orderkey").alias("obligation"), F.when(F.col("o_orderkey") % 4 == 1, "board").when(F.col("o_orderkey") % 4 == 2, "policy").alias("level"))
    return judge.emitted_gaps(gate(spark, sf), levels)


@query(GATE_SQL + " SELECT obligation, control, verdict, confidence, CASE WHEN citation_ok AND confidence >= 0.7 THEN 'auto' ELSE 'escalated' END AS status FROM g")
def judged_mappings(spark, sf):
    return judge.mappings(gate(spark, sf))


@query(KNN_SQL.replace("q.vec_id % 50 = 0", "q.vec_id IN (SELECT item_id FROM benchmark)") + """, w AS (SELECT DISTINCT item_id AS q_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), d AS (SELECT DISTINCT doc_id AS i_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
l AS (SELECT q_id, i_id, row_number() OVER (PARTITION BY q_id ORDER BY count(*) DESC, i_id) AS rank FROM w JOIN d USING (word) GROUP BY 1, 2), x AS (SELECT q_id, i_id, rank AS lexical_rank FROM l WHERE rank <= 3),
e AS (SELECT DISTINCT q_id, doc_id AS i_id FROM documents, (SELECT DISTINCT item_id AS q_id FROM benchmark) WHERE contains(text, '***')),
y AS (SELECT r.q_id, r.i_id, row_number() OVER (PARTITION BY r.q_id ORDER BY rank, r.i_id) AS semantic_rank FROM r ANTI JOIN e ON e.q_id = r.q_id AND e.i_id = r.i_id WHERE rank <= 50),
z AS (SELECT coalesce(x.q_id, y.q_id) AS q_id, coalesce(x.i_id, y.i_id) AS i_id, lexical_rank, semantic_rank FROM x FULL JOIN (SELECT * FROM y WHERE semantic_rank <= 5) y ON x.q_id = y.q_id AND x.i_id = y.i_id)
SELECT z.q_id, z.i_id, lexical_rank, semantic_rank, e.q_id IS NOT NULL AS edited FROM z LEFT JOIN e ON e.q_id = z.q_id AND e.i_id = z.i_id""")
def coverage_candidates(spark, sf):
    """For each benchmark text, documents near it by words or by vectors; documents with a row of three stars count as edited."""
    items, docs = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    ids = items.select(F.col("item_id").alias("id"))
    # both lists are short and used twice
    semantic = settled(retrieve.nearest(vectors.join(ids, "id", "left_semi"), vectors, 50))
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))).alias("word")
    met = items.select(F.col("item_id").alias("q_id"), words("text")).join(docs.select(F.col("doc_id").alias("i_id"), words("text")), "word").groupBy("q_id", "i_id").agg(F.count("*").alias("n"))
    lexical = settled(met.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("n"), "i_id"))).where("rank <= 3"))
    found = lexical.select("q_id", "i_id").union(semantic.select("q_id", "i_id")).distinct()
    edited = found.join(docs.where(F.col("text").contains("***")).select(F.col("doc_id").alias("i_id")), "i_id", "left_semi")
    return retrieve.coverage_candidates(lexical, semantic, edited)
