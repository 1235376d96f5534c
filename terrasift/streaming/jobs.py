"""The refinement job queue: eligibility, claim, and a state machine over transition events.

Batch replay and the stream apply the same fold; the stream keeps a job's state by
``applyInPandasWithState`` keyed by job_id, with the checkpoint as the durable state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrasift.operators.corpus import snapshot_diff
from terrasift.session import ship

# Legal transitions.
TRANSITIONS = {
    "PENDING": ("IN_PROGRESS", "SKIPPED"),
    "IN_PROGRESS": ("COMPLETED", "FAILED", "SKIPPED"),
    "FAILED": ("PENDING", "SKIPPED"),
    "SKIPPED": ("PENDING",),
    "COMPLETED": (),
}
STATE = "job_id string, status string, attempts int, accepted int, rejected int"


def job_id(path: Column, size: Column, mtime: Column) -> Column:
    return F.sha2(F.concat_ws("|", path, size.cast("string"), mtime.cast("string")), 256)


def eligibility(status: Column, completeness: Column, fallback_used: Column, deferred: Column) -> Column:
    """STR-01: the first reason against a job, or null if the result is eligible."""
    return F.when(status == "HATA", "PRIMARY_FAILED").when(completeness == "COMPLETE", "ALREADY_COMPLETE").when(F.coalesce(fallback_used, F.lit(False)), "FALLBACK_DONE").when(~F.coalesce(deferred, F.lit(False)), "NOT_DEFERRED").when(F.coalesce(completeness, F.lit("")) != "USEFUL_PARTIAL", "NOT_USEFUL")


def enqueued(results: DataFrame) -> DataFrame:
    """STR-01, STR-05: jobs of eligible results, one for each file identity, beside the reasons of the others."""
    marked = results.withColumn("job_id", job_id(F.col("path"), F.col("size"), F.col("mtime"))).withColumn("reason", eligibility(F.col("status"), F.col("completeness"), F.col("fallback_used"), F.col("deferred")))
    first = F.row_number().over(Window.partitionBy("job_id").orderBy("created_at", "path"))
    again = marked.withColumn("_rn", first)
    return again.withColumn("reason", F.coalesce("reason", F.when(F.col("_rn") > 1, "DUPLICATE"))).withColumn("enqueued", F.col("reason").isNull()).drop("_rn")


def claim(jobs: DataFrame) -> DataFrame:
    """TOP-08: the pending job that comes first by (created_at, job_id)."""
    return jobs.where("status = 'PENDING'").orderBy("created_at", "job_id").limit(1)


def advance(status: str | None, attempts: int, wanted: str) -> tuple[str | None, int, bool]:
    """One transition: the state after it and whether it was legal (else nothing changes)."""
    if status is None:
        return ("PENDING", 0, True) if wanted == "PENDING" else (None, 0, False)
    if wanted not in TRANSITIONS.get(status, ()):
        return status, attempts, False
    return wanted, attempts + (wanted == "IN_PROGRESS"), True


def _fold(state: tuple, wanted: Iterator[str]) -> tuple:
    status, attempts, good, bad = state
    for w in wanted:
        status, attempts, ok = advance(status, attempts, w)
        good, bad = good + ok, bad + (not ok)
    return status, attempts, good, bad


def replay(events: DataFrame) -> DataFrame:
    """STR-02: the state of every job after all its events in the order of ``seq``, as a fold over a job's history."""

    def step(state: Column, event: Column) -> Column:
        now, wanted = state["status"], event["wanted"]
        legal = now.isNull() & (wanted == "PENDING")
        for before, after in TRANSITIONS.items():
            legal = legal | ((now == before) & wanted.isin(*after)) if after else legal
        ok = F.coalesce(legal, F.lit(False))
        return F.struct(
            F.when(ok, wanted).otherwise(now).alias("status"),
            (state["attempts"] + (ok & (wanted == "IN_PROGRESS")).cast("int")).alias("attempts"),
            (state["accepted"] + ok.cast("int")).alias("accepted"),
            (state["rejected"] + (~ok).cast("int")).alias("rejected"),
        )

    start = F.struct(F.lit(None).cast("string").alias("status"), *[F.lit(0).alias(c) for c in ("attempts", "accepted", "rejected")])
    history = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "wanted"))).alias("history"))
    return history.select("job_id", F.aggregate("history", start, step).alias("s")).select(F.col("job_id").cast("string").alias("job_id"), "s.*")


def stream(events: DataFrame) -> DataFrame:
    """STR-02, STR-03: the same over a stream; a row for each job that a micro-batch touched."""
    ship(events.sparkSession)

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else ("", 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        status, attempts, good, bad = _fold((now[0] or None, *(int(x) for x in now[1:])), iter(rows["wanted"]))
        state.update((status or "", attempts, good, bad))
        yield pd.DataFrame([(key[0], status, attempts, good, bad)], columns=[c.split()[0] for c in STATE.split(", ")])

    return events.select("job_id", "seq", "wanted").groupBy("job_id").applyInPandasWithState(run, STATE, "status string, attempts int, accepted int, rejected int", "update", GroupStateTimeout.NoTimeout)


def recovered(jobs: DataFrame) -> DataFrame:
    """STR-02: jobs in progress after a crash go back to pending."""
    stuck = F.col("status") == "IN_PROGRESS"
    return jobs.withColumn("recovered", stuck).withColumn("status", F.when(stuck, "PENDING").otherwise(F.col("status")))


def refine_batches(events: DataFrame, apply, checkpoint: str):
    """STR-04: a worker over whatever has arrived: ``apply(batch, id)`` per micro-batch, then stop."""
    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcomes(claimed: DataFrame, primary: DataFrame, refined: DataFrame) -> DataFrame:
    """STR-04: a worker's verdict on its claimed jobs: FAILED without a refined snapshot or when the file has
    changed since it was queued, else COMPLETED with the class of the change (SET-01).

    Snapshots: (job_id, tokens array, rings array); claimed jobs and refined snapshots carry ``identity``.
    """
    before = primary.select("job_id", F.col("tokens").alias("_pt"), F.col("rings").alias("_pr"))
    after = refined.select("job_id", F.col("tokens").alias("_rt"), F.col("rings").alias("_rr"), F.col("identity").alias("_ri"))
    joined = claimed.select("job_id", "identity").join(before, "job_id", "left").join(after, "job_id", "left")
    none = F.array().cast("array<string>")
    change = snapshot_diff(F.col("_pt"), F.col("_rt"), F.coalesce("_pr", none), F.coalesce("_rr", none))
    reason = F.when(F.col("_rt").isNull(), "NO_RESULT").when(~F.col("_ri").eqNullSafe(F.col("identity")), "FILE_CHANGED")
    return joined.select("job_id", F.when(reason.isNull(), "COMPLETED").otherwise("FAILED").alias("status"), F.coalesce(reason, change).alias("reason"))


def province_states(provinces: DataFrame, attempts: DataFrame, retry_failed: bool = False) -> DataFrame:
    """STR-06: per province pending, completed, failed or in_progress from its last attempt, and what runs next."""
    last = Window.partitionBy("province").orderBy(F.col("seq").desc())
    latest = attempts.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").select("province", F.col("outcome").alias("state"))
    joined = provinces.join(latest, "province", "left").withColumn("state", F.coalesce("state", F.lit("pending")))
    due = F.col("state").isin("pending", "in_progress") | (F.lit(retry_failed) & (F.col("state") == "failed"))
    return joined.withColumn("due", due)
