"""Evidence batches by a manifest: which log tests which control, by what rule, and what a result means for the control's gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import late, overdue, transition, with_result
from .versioned import VersionStore

#: What a log's row needs for each rule.
RULES = ("overdue", "late")


def exception(rule: Column, risk: Column, last: Column, as_of: Column, begun: Column, done: Column, deadline: Column) -> Column:
    """Whether a log's row is an exception by its manifest entry's rule; null for an unknown rule."""
    return F.when(rule == "overdue", overdue(last, risk, as_of)).when(rule == "late", late(begun, done, deadline))


def tested(logs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows (file, control, exceptions, total, rate, tolerance, result, period_start, period_end), one for each entry of the manifest.

    ``manifest``: file, control, rule, tolerance, as_of, deadline. ``logs``: file, risk, last, begun, done, dates or
    nulls; the period is that of all its dates. A file without rows, or with an unknown rule, can't be assessed.
    Copies are combined before the shuffle, so that one large file is no hot key.
    """
    entries = manifest.select("file", "control", "rule", "tolerance", F.col("as_of").cast("date").alias("as_of"), "deadline")
    dates = [F.col(c).cast("date") for c in ("last", "begun", "done")]
    rows = logs.join(entries.select("file", "rule", "as_of", "deadline"), "file")
    found = exception(F.col("rule"), F.col("risk"), dates[0], F.col("as_of"), dates[1], dates[2], F.col("deadline"))
    lo, hi = F.array_min(F.array_compact(F.array(*dates))), F.array_max(F.array_compact(F.array(*dates)))
    counted = rows.groupBy("file").agg(F.count_if(found).alias("exceptions"), F.count(found).alias("total"), F.min(lo).alias("period_start"), F.max(hi).alias("period_end"))
    both = entries.select("file", "control", "tolerance").join(counted, "file", "left").na.fill(0, ["exceptions", "total"])
    return with_result(both, F.col("tolerance"))


def outcomes(tests: DataFrame, history: DataFrame) -> DataFrame:
    """``tests`` with previous and change: each control's result beside its latest in ``history`` (control, result, tested_at)."""
    last = history.groupBy("control").agg(F.max_by("result", "tested_at").alias("previous"))
    return tests.join(last, "control", "left").withColumn("change", transition(F.col("previous"), F.col("result")))


def gap_actions(seen: DataFrame, open_gaps: DataFrame) -> DataFrame:
    """Rows (control, action, tier, rationale): a failing control's gap is opened, or stays open in the high tier; one within tolerance goes to review, where a person closes it.

    ``seen`` are rows of ``outcomes``, ``open_gaps`` has the controls with an open gap. Controls that can't be assessed change nothing.
    """
    figures = F.concat(F.col("exceptions").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" exceptions, tolerance "), F.format_number(100 * F.col("tolerance"), 1), F.lit(" %"))
    both = seen.join(open_gaps.select("control").distinct().withColumn("open", F.lit(True)), "control", "left")
    failing, is_open = F.col("result") == "ineffective", F.coalesce("open", F.lit(False))
    action = F.when(failing & ~is_open, "open").when(failing, "update").when((F.col("result") == "effective") & is_open, "review")
    rationale = F.when(F.col("result") == "effective", F.concat(F.lit("Latest evidence is within tolerance ("), figures, F.lit("); a reviewer closes it."))).otherwise(figures)
    return both.withColumns({"action": action, "tier": F.when(failing, "high").otherwise("review"), "rationale": rationale}).where("action IS NOT NULL").select("control", "action", "tier", "rationale")


STORED = "id string, control string, kind string, result string, tier string, rationale string, file string, exceptions bigint, total bigint"


def recorded(store: VersionStore, event: str, at: Column, seen: DataFrame) -> None:
    """Appends a batch's tests and the gaps they open, update or send to review to the store (``STORED``), as one event.

    A gap that changes is closed and appended anew. A batch comes in once; a ``store`` opened for reading only previews nothing: use ``gap_actions``.
    """
    now = store.view().where("superseded_at IS NULL")
    gaps = now.where("kind = 'gap'")
    actions = gap_actions(seen, gaps)
    name = lambda kind: F.sha2(F.concat_ws("|", F.lit(event), F.lit(kind), "control"), 256).alias("id")
    none = lambda kind: F.lit(None).cast(kind)
    tests = seen.select(name("test"), "control", F.lit("test").alias("kind"), "result", none("string").alias("tier"), F.col("change").alias("rationale"), "file", F.col("exceptions").cast("bigint").alias("exceptions"), F.col("total").cast("bigint").alias("total"))
    opened = actions.select(name("gap"), "control", F.lit("gap").alias("kind"), none("string").alias("result"), "tier", "rationale", none("string").alias("file"), none("bigint").alias("exceptions"), none("bigint").alias("total"))
    closed = gaps.join(actions.select("control"), "control", "left_semi").select("id", at.cast("timestamp").alias("effective_to"))
    store.commit(event, at, tests.unionByName(opened).withColumn("effective_from", at.cast("timestamp")), closed)
