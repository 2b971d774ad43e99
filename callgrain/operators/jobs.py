"""Job tables as data: what is ready, stale, failed, next, and how long stages took. No scheduling."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callgrain.functions.text import truncate_error
from callgrain.schemas import ACTIVE, PRECONDITIONS, STAGES, STATE_AFTER, STATE_EDGES

#: Fixed value.
STALE_MESSAGE = "Reclaimed stale running job after worker interruption"


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def stale_jobs(jobs: DataFrame, as_of: Column, threshold_s: int = 300) -> DataFrame:
    limit = as_of - F.make_dt_interval(secs=F.lit(threshold_s))
    return jobs.where((F.col("status") == "running") & F.col("started_at").isNotNull() & (F.col("started_at") <= limit))


def _resolved(again: Column) -> Column:
    return F.when(again, "queued").otherwise("failed")


def stale_resolution(jobs: DataFrame, as_of: Column, threshold_s: int = 300) -> DataFrame:
    """Stale jobs with their new status, finish time and message; attempts, priority and start stay."""
    again = F.col("attempt_count") < F.col("max_attempts")
    return stale_jobs(jobs, as_of, threshold_s).withColumns({"status": _resolved(again), "finished_at": as_of, "error_message": F.lit(STALE_MESSAGE)})


def failure_resolution(failures: DataFrame, as_of: Column) -> DataFrame:
    """failures(job columns, retryable, error): queued again if retryable and attempts are left, else failed."""
    again = F.col("retryable") & (F.col("attempt_count") < F.col("max_attempts"))
    return failures.withColumns({"status": _resolved(again), "finished_at": as_of, "error_message": truncate_error(F.col("error"))})


def retry_limit_lookup(df: DataFrame, limits: dict[str, int], default: int = 1) -> DataFrame:
    return df.withColumn("retry_limit", F.coalesce(F.try_element_at(_map(limits), F.col("stage")), F.lit(default)))


def exclude_active(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Candidates (call_id, stage) without a queued or running job."""
    active = jobs.where(F.col("status").isin(*ACTIVE)).select("call_id", "stage").distinct()
    return candidates.join(active, ["call_id", "stage"], "left_anti")


def next_stage_backlog(jobs: DataFrame) -> DataFrame:
    """(call_id, stage) to run after finished stages, unless already active."""
    after = _map(dict(zip(STAGES, STAGES[1:], strict=False)))
    nxt = jobs.where("status = 'done'").select("call_id", F.try_element_at(after, F.col("stage")).alias("stage")).where("stage is not null").distinct()
    return exclude_active(nxt, jobs)


def call_state_from_events(events: DataFrame) -> DataFrame:
    """Last state of each call from finished and failed events; failures also keep their errors in order."""
    ended = events.where(F.col("event").isin("finished", "failed"))
    state = F.when(F.col("event") == "failed", "failed").otherwise(F.try_element_at(_map(STATE_AFTER), F.col("stage")))
    errors = F.sort_array(F.collect_list(F.when(F.col("event") == "failed", F.struct("at", "event_id", F.coalesce("error", F.lit("")).alias("error")))))
    return ended.groupBy("call_id").agg(F.max_by(state, F.struct("at", "event_id")).alias("state"), F.transform(errors, lambda x: x["error"]).alias("errors"))


def transition_violations(events: DataFrame) -> DataFrame:
    """Steps of a call's states that are no allowed edge; the first state of a call is not a step."""
    e = events.where("event = 'finished'").withColumn("state", F.try_element_at(_map(STATE_AFTER), F.col("stage")))
    w = Window.partitionBy("call_id").orderBy("at", "event_id")
    steps = e.withColumn("previous", F.lag("state").over(w)).where("previous is not null")
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in STATE_EDGES])
    return steps.where(~F.array_contains(allowed, F.concat("previous", F.lit(">"), "state"))).select("call_id", "event_id", "previous", "state")


def missing_preconditions(states: DataFrame, artifacts: DataFrame) -> DataFrame:
    """states(call_id, state) against artifacts(call_id, kind): (call_id, state, kind) for each artifact that a state presupposes and that isn't there."""
    needed = F.explode(F.try_element_at(F.create_map(*[x for k, v in PRECONDITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("state")))
    return states.select("call_id", "state", needed.alias("kind")).join(artifacts.select("call_id", "kind").distinct(), ["call_id", "kind"], "left_anti").select("call_id", "state", "kind")


def ready_jobs_topk(jobs: DataFrame, k: int = 1) -> DataFrame:
    """The next k queued jobs: priority, then waiting time, then id."""
    return jobs.where("status = 'queued'").orderBy(F.desc("priority"), "available_at", "job_id").limit(k)


def job_list(jobs: DataFrame, statuses: tuple[str, ...] = ()) -> DataFrame:
    out = jobs.where(F.col("status").isin(*statuses)) if statuses else jobs
    return out.orderBy(F.desc("available_at"), "job_id")


def job_attempts(events: DataFrame) -> DataFrame:
    """Number every event with the attempt it belongs to: starts so far of its call and stage."""
    w = Window.partitionBy("call_id", "stage").orderBy("at", "event_id")
    return events.withColumn("attempt", F.count_if(F.col("event") == "started").over(w))


def stage_durations(events: DataFrame) -> DataFrame:
    """Start, finish, milliseconds and error of each attempt."""
    a = job_attempts(events).where("attempt > 0").groupBy("call_id", "stage", "attempt")
    ended = F.col("event").isin("finished", "failed")
    t = a.agg(
        F.min(F.when(F.col("event") == "started", F.col("at"))).alias("started_at"),
        F.min(F.when(ended, F.col("at"))).alias("finished_at"),
        F.max_by("error", F.when(F.col("event") == "failed", F.struct("at", "event_id"))).alias("error"),
    )
    ms = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000
    return t.withColumn("duration_ms", F.floor(ms))
