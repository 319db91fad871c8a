"""Answer keys and evidence batches by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clausewright.operators import evaluate, monitor, versioned
from clausewright.sources import generated

KEY = "policy string, key_id string, kind string, rule string, refs array<string>, spans array<struct<s:bigint,e:bigint>>, gap_types array<string>, verdicts array<string>"
FOUND = "policy string, id int, ref string, gap_type string, verdict string, s bigint, e bigint, tier string"


def test_key_rows(spark):
    key = [
        ("p", "hit", "mutation", None, ["1", "1"], [(10, 20)], ["missing"], []), ("p", "near", "mutation", None, ["2"], [(10, 20)], ["missing"], []), ("p", "gone", "mutation", None, ["3"], [(5, 5)], [], ["partial"]),
        ("p", "none", "mutation", None, ["9"], [(1, 2)], [], []), ("p", "decoy", "decoy", None, ["4"], [(0, 9)], [], []), ("p", "told", "injection", None, [], [(50, 60)], [], []), ("p", "untold", "injection", None, [], [(70, 80)], [], []),
        ("p", "known", "real_finding", "known_gap", ["1"], [(30, 40)], [], []), ("p", "clean", "real_finding", "no_gap", ["5"], [], [], []), ("p", "set", "real_finding", "accept_set", ["6"], [], [], ["covered"]), ("p", "unseen", "real_finding", "no_gap", ["8"], [], [], []), ("q", "other", "mutation", None, ["1"], [(10, 20)], [], []),
    ]
    found = [
        ("p", 1, "1", "missing", "missing", 15, 16, None), ("p", 2, "1", "missing", "missing", 30, 35, "high"), ("p", 3, "2", "weak", "partial", 90, 95, "review"), ("p", 4, "3", "weak", "partial", None, None, "review"), ("p", 5, "4", "weak", "x", 1, 2, "review"),
        ("p", 6, "4", "weak", "x", 20, 22, "high"), ("p", 7, "5", None, "covered", 1, 2, None), ("p", 8, "6", "weak", "covered", 1, 2, None), ("p", 9, "7", "weak", "x", 1, 2, None),
    ]
    keys, findings = spark.createDataFrame(key, KEY), spark.createDataFrame(found, FOUND)
    flags = spark.createDataFrame([("p", 55, 58), ("p", 60, 70)], "policy string, s bigint, e bigint")
    rows = evaluate.scored(keys, findings, flags)
    got = {r.key_id: (r.detected, r.typed, r.near_miss, r.tier, r.outcome) for r in rows.collect()}
    assert got == {
        "hit": (True, True, False, "high", None), "near": (False, False, True, "review", None), "gone": (True, True, False, "review", None), "none": (False, False, False, None, None), "other": (False, False, False, None, None),
        "decoy": (True, None, None, "review", None), "told": (True, None, None, None, None), "untold": (False, None, None, None, None), "known": (None, None, None, None, "known gap reported"), "clean": (None, None, None, None, "correct"), "set": (None, None, None, None, "correct"), "unseen": (None, None, None, None, "not assessed"),
    }
    assert {r.key_id: r.reported for r in rows.collect()}["hit"] == ["missing"]
    extra = evaluate.unkeyed_gaps(keys, findings)
    assert sorted(r.id for r in extra.collect()) == [6, 9]
    card = {r.policy: r for r in evaluate.score_card(rows, extra).collect()}
    assert (card["p"].planted, card["p"].found, card["p"].near, card["p"].planted_high, card["p"].planted_review, card["p"].decoys_review, card["p"].unkeyed, card["p"].real, card["p"].real_correct) == (4, 2, 1, 1, 2, 1, 2, 3, 2)
    assert (card["q"].planted, card["q"].unkeyed) == (1, 0)


def test_evidence_key(spark):
    keys = spark.createDataFrame([("a", "evidence", ["x", "1"], "ineffective"), ("b", "decoy", ["2", "1"], "effective"), ("c", "decoy", ["9"], "effective"), ("d", "decoy", ["2"], "effective")], "key_id string, kind string, refs array<string>, expected string")
    results = spark.createDataFrame([("1", "ineffective"), ("2", "effective")], "ref string, result string")
    got = {r.key_id: (r.got, r.has_gap, r.right) for r in evaluate.evidence_scored(keys, results, results.where("ref = '1'")).collect()}
    assert got == {"a": ("ineffective", True, True), "b": ("effective", True, False), "c": ("not tested", False, False), "d": ("effective", False, True)}


def test_the_four_published_figures(spark, tmp_path):
    """121 of 1,200, 13 of 600, 28 of 1,200 and 88 of 800 exceptions, as a first batch and the one after it."""
    review = lambda name, *a: generated.review_log(spark, *a).select(F.lit(name).alias("file"), F.col("risk_category").alias("risk"), F.col("last_kyc_update").alias("last"), F.lit(None).cast("string").alias("begun"), F.lit(None).cast("string").alias("done"))
    upload = lambda name, *a: generated.upload_log(spark, *a).select(F.lit(name).alias("file"), F.lit(None).cast("string").alias("risk"), F.lit(None).cast("string").alias("last"), F.col("opened_on").alias("begun"), F.col("ckycr_uploaded_on").alias("done"))
    entry = "file string, control string, rule string, tolerance double, as_of string, deadline int"
    day = lambda n: F.lit(dt.datetime(2026, 11, n))
    store = versioned.VersionStore(spark, f"file://{tmp_path}/store", monitor.STORED)
    history = lambda: versioned.current(store.view()).where("kind = 'test'").select("control", "result", F.col("recorded_at").alias("tested_at"))
    logs = review("r0", 1200, 28, 11, "2026-09-30").unionByName(upload("u0", 800, 88, 12, "2026-03-01"))
    manifest = spark.createDataFrame([("r0", "re-kyc", "overdue", 0.05, "2026-09-30", None), ("u0", "upload", "late", 0.05, "2026-09-30", 10), ("none", "other", "late", 0.05, "2026-09-30", 10)], entry)
    first = monitor.outcomes(monitor.tested(logs, manifest), history())
    assert {r.file: (r.exceptions, r.total, r.rate, r.result, r.change) for r in first.collect()} == {"r0": (28, 1200, 0.0233, "effective", "healthy"), "u0": (88, 800, 0.11, "ineffective", "newly_failing"), "none": (0, 0, None, "cannot_assess", "cannot_assess")}
    monitor.recorded(store, "batch 1", day(1), first)
    logs = review("r1", 1200, 121, 13, "2026-10-31").unionByName(upload("u1", 600, 13, 14, "2026-04-01"))
    manifest = spark.createDataFrame([("r1", "re-kyc", "overdue", 0.05, "2026-10-31", None), ("u1", "upload", "late", 0.05, "2026-10-31", 10)], entry)
    second = monitor.outcomes(monitor.tested(logs, manifest), history())
    assert {r.file: (r.exceptions, r.total, r.result, r.change) for r in second.collect()} == {"r1": (121, 1200, "ineffective", "newly_failing"), "u1": (13, 600, "effective", "recovered")}
    monitor.recorded(store, "batch 2", day(2), second)
    gaps = {r.control: (r.tier, r.rationale[:30]) for r in versioned.current(store.view()).where("kind = 'gap'").collect()}
    assert gaps == {"re-kyc": ("high", "121/1200 exceptions, tolerance"), "upload": ("review", "Latest evidence is within tole")}
    with pytest.raises(ValueError):
        monitor.recorded(store, "batch 2", day(3), second)


def test_logs_depend_on_the_seed_alone(spark):
    a, b = (generated.review_log(spark, 500, 37, 5, "2026-01-01", p).orderBy("account_id").collect() for p in (1, 7))
    assert a == b and a != generated.review_log(spark, 500, 37, 6, "2026-01-01").orderBy("account_id").collect()
    assert generated.upload_log(spark, 0, 0, 1, "2026-01-01").count() == 0


def test_pairs_of_keys_and_findings_are_made_once(spark):
    import re

    keys = spark.createDataFrame([("p", 1, "real_finding", "known_gap", [1], [(0, 9)], ["R"], ["O"]), ("p", 2, "mutation", None, [1, 2], [(5, 9)], ["R"], ["O"])], "policy string, key_id int, kind string, rule string, refs array<int>, spans array<struct<s:int,e:int>>, gap_types array<string>, verdicts array<string>")
    # one id on two rows: what is known of one holds for both
    findings = spark.createDataFrame([("p", 7, 1, "R", "O", 4, 6, "high"), ("p", 7, 2, "R", "O", 5, 6, "high"), ("p", 8, 2, "R", "O", 20, 26, "review")], "policy string, id int, ref int, gap_type string, verdict string, s int, e int, tier string")
    flags = spark.createDataFrame([], "policy string, s int, e int")
    rows = evaluate.scored(keys, findings, flags)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Join \[policy#\d+, ref#\d+\], \[policy#\d+, ref#\d+\], Inner", plan)) == 1
    got = {r.key_id: (r.detected, r.near_miss, r.tier, r.outcome) for r in rows.collect()}
    assert got == {1: (None, None, None, "known gap reported"), 2: (False, True, "review", None)}
    assert not evaluate.unkeyed_gaps(keys, findings).collect()
