"""The job state machine, as one fold that batch and streaming runs share.

An event is (job_id, at, seq, kind, token, transient, detail); a job's events are folded in the order of (at, seq).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.settings import Jobs

OPEN = ("pending", "running", "retryable_failed")
PARKED = "book_budget_parked"
#: Failures that the same bytes can only repeat.
PERMANENT = ("encrypted", "corrupt", "invalid_source", "missing_source", "ocr_unavailable", "ocr_language_missing", "missing_run", "missing_unit", "run_failed", "invalid_range")


@dataclass
class State:
    state: str = "none"
    attempts: int = 0
    max_attempts: int = 3
    token: str | None = None
    lease_until: float | None = None
    due: float | None = None
    detail: str | None = None
    stale: int = 0  # events with a token that was no longer the job's


STATE_SCHEMA = "job_id string, state string, attempts int, max_attempts int, token string, lease_until double, due double, detail string, stale int"
EVENT_COLUMNS = ["job_id", "at", "seq", "kind", "token", "transient", "detail"]


def apply(s: State, kind: str, at: float, token: str | None = None, transient: bool | None = None, detail: str | None = None, j: Jobs = Jobs()) -> State:
    """The state after an event; backoff is without jitter."""
    if kind == "enqueue":
        return State("pending", max_attempts=j.max_attempts, stale=s.stale) if s.state == "none" else s
    if kind == "claim":
        if s.state == "running" and s.lease_until is not None and s.lease_until <= at:
            s.state = "pending"
        if s.state == "pending" or s.state == "retryable_failed" and (s.due is None or s.due <= at):
            s.state, s.token, s.attempts, s.lease_until, s.due = "running", token, s.attempts + 1, at + j.lease_s, None
        return s
    if kind in ("retry", "retry_all"):
        if s.state == "retryable_failed" or kind == "retry_all" and s.state == "permanent_failed":
            s.attempts = 0 if s.state == "permanent_failed" else s.attempts
            s.state, s.due, s.detail = "pending", None, None
        return s
    if s.state != "running" or s.token != token:
        s.stale += 1
        return s
    if kind == "heartbeat":
        s.lease_until = at + j.lease_s
        return s
    s.token = s.lease_until = None
    if kind == "succeed":
        s.state, s.detail = "succeeded", None
    elif kind == "fail":
        over = not transient or s.attempts >= s.max_attempts
        s.state, s.detail = "permanent_failed" if over else "retryable_failed", detail
        s.due = None if over else at + min(j.backoff_cap_s, j.backoff_base_s * 2 ** (s.attempts - 1))
    elif kind == "defer":
        s.state, s.due, s.detail = "retryable_failed", at + j.defer_s, None
    elif kind == "release":
        s.state, s.attempts, s.detail = "retryable_failed", max(0, s.attempts - 1), PARKED
    return s


def fold(s: State, events: Iterable[tuple]) -> State:
    """events: (at, seq, kind, token, transient, detail)."""
    for at, _, kind, token, transient, detail in sorted(events, key=lambda e: e[:2]):
        s = apply(s, kind, at, token, transient, detail)
    return s


def _rows(f: pd.DataFrame) -> list[tuple]:
    clean = f[EVENT_COLUMNS[1:]].astype(object).where(f[EVENT_COLUMNS[1:]].notna(), None)
    return list(clean.itertuples(index=False, name=None))


def fold_events(events: DataFrame) -> DataFrame:
    """The state of each job, by a sorted stream through each partition: a job's events are never held together."""
    dealt = events.select(*EVENT_COLUMNS).repartition("job_id").sortWithinPartitions("job_id", "at", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, state = None, State()
        for f in frames:
            done = []
            for name, row in zip(f["job_id"], _rows(f), strict=True):
                if name != job:
                    if job is not None:
                        done.append({"job_id": job, **asdict(state)})
                    job, state = name, State()
                at, _, kind, token, transient, detail = row
                state = apply(state, kind, at, token, transient, detail)
            if done:
                yield pd.DataFrame(done)
        if job is not None:
            yield pd.DataFrame([{"job_id": job, **asdict(state)}])

    return dealt.mapInPandas(run, STATE_SCHEMA)


def backoff(attempts: Column, j: Jobs = Jobs(), jitter: Column | None = None) -> Column:
    """Seconds until the next try after so many; jitter from 0 to 1 lengthens them by up to a fifth."""
    plain = F.least(F.lit(j.backoff_cap_s), F.lit(j.backoff_base_s) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempts - 1)))
    return plain if jitter is None else plain * (1 + F.lit(j.jitter) * jitter)


def is_permanent(category: Column) -> Column:
    return F.coalesce(category.isin(*PERMANENT), F.lit(False))


def claimable(jobs: DataFrame, now: float, paused: bool = False) -> DataFrame:
    """The job that a worker would claim: the oldest that is pending, due again, or whose lease has run out."""
    ready = (F.col("state") == "pending") | ((F.col("state") == "retryable_failed") & (F.coalesce("due", F.lit(0.0)) <= now)) | ((F.col("state") == "running") & (F.col("lease_until") <= now))
    return jobs.filter(ready & F.lit(not paused)).orderBy("job_id").limit(1)


def dead_leases(jobs: DataFrame, alive: DataFrame) -> DataFrame:
    """Running jobs whose owner isn't among the living (owner): they return to pending."""
    return jobs.filter("state = 'running'").join(alive.select("owner"), "owner", "left_anti").withColumn("state", F.lit("pending"))


URGENCY = {"running": 4, "pending": 3, "retryable_failed": 2, "permanent_failed": 2, "cancelled": 2, "succeeded": 1}


def urgency(state: Column) -> Column:
    out = F.lit(0)
    for name, rank in URGENCY.items():
        out = F.when(state == name, rank).otherwise(out)
    return out


def most_urgent(jobs: DataFrame, by: list[str]) -> DataFrame:
    """One job per group: the most urgent state, then the first by id."""
    order = W.partitionBy(*by).orderBy(urgency(F.col("state")).desc(), "job_id")
    return jobs.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
