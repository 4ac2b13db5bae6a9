"""Incremental operators: the batch operators applied to micro-batches and the tables they maintain."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sightline.functions.packages import CVE_ID
from sightline.operators.advisories import changes_only, group_members, latest_members
from sightline.operators.compare import changed_keys
from sightline.scale import latest
from sightline.streaming.tables import BatchTable

QUEUE_SCHEMA = "id string, revision string, priority int, queued_at timestamp"
KEY = ("id", "source", "branch")


def enqueue(table: BatchTable, items: DataFrame, batch_id: int) -> None:
    """Adds jobs whose (id, revision) is not queued yet; seeing one again changes nothing."""
    valid = items.where(F.col("id").rlike(CVE_ID) & F.col("revision").isNotNull())
    fresh = valid.groupBy("id", "revision").agg(F.min("priority").alias("priority"), F.min("queued_at").alias("queued_at"))
    table.write(fresh.join(table.read(batch_id).select("id", "revision"), ["id", "revision"], "left_anti"), batch_id)


def ingest_delta(table: BatchTable, cursors: BatchTable) -> Callable[[DataFrame, int], None]:
    """Handler for delta entries (id, revision, fetched): enqueues those at or after the cursor and moves it forward.

    Entries exactly at the cursor are read again; the cursor never moves back.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        # The cursor is one value; it travels as text so that no session zone touches it.
        cursor = F.lit(cursors.read(batch_id).agg(F.max("fetched").cast("string")).first()[0]).cast("timestamp")
        due = kept.where(cursor.isNull() | (F.col("fetched") >= cursor))
        enqueue(table, due.select("id", "revision", F.lit(1).alias("priority"), F.col("fetched").alias("queued_at")), batch_id)
        newest = kept.agg(F.greatest(F.max("fetched"), F.max(cursor)).alias("fetched"))
        cursors.write(newest.where("fetched IS NOT NULL"), batch_id)
        kept.unpersist()

    return handle


OBSERVATION_SCHEMA = "id string, source string, branch string, sequence bigint, snapshot_hash string"


def observe(history: BatchTable, keys: Sequence[str] = KEY) -> Callable[[DataFrame, int], None]:
    """Handler that appends content changes: an observation counts when it differs from the one before it.

    Returns to earlier content are kept. Only the last hash of the keys in the batch is looked up.
    """
    keys = list(keys)

    def handle(batch: DataFrame, batch_id: int) -> None:
        changes = changes_only(batch.select(*keys, "sequence", "snapshot_hash"), keys)
        touched = history.read(batch_id).join(batch.select(*keys).distinct(), keys, "left_semi")
        last = latest(touched, keys, ["sequence"]).select(*keys, F.col("snapshot_hash").alias("__last"), F.col("sequence").alias("__at"))
        rows = changes.join(last, keys, "left")
        # Late rows (at or before the stored position) never rewrite history.
        in_order = F.col("__at").isNull() | (F.col("sequence") > F.col("__at"))
        first = F.col("previous_hash").isNull()
        history.write(rows.where(in_order & ~(first & (F.coalesce("__last", F.lit("")) == F.col("snapshot_hash")))), batch_id)

    return handle


SNAPSHOT_SCHEMA = "source string, id string, branch string, body string, change string"


def replace_snapshots(log: BatchTable, scope: Sequence[str] = ("source",)) -> Callable[[DataFrame, int], None]:
    """Handler for complete snapshots: every scope (source or document) in the batch replaces its earlier rows.

    Only differences are written: added and changed rows, and removals as rows of their own.
    """
    scope = list(scope)

    def handle(batch: DataFrame, batch_id: int) -> None:
        keys = list(dict.fromkeys([*scope, "source", "id", "branch"]))
        scopes = batch.select(*scope).distinct()
        new = batch.where("id IS NOT NULL").select(*keys, "body")
        old = log.current(keys, batch_id).where("change <> 'removed'").join(scopes, scope, "left_semi").select(*keys, "body")
        differences = changed_keys(old, new, keys)
        log.write(differences.join(new, keys, "left"), batch_id)

    return handle


def snapshot_state(log: BatchTable, scope: Sequence[str] = ("source",)) -> DataFrame:
    """Current rows of a snapshot log."""
    keys = list(dict.fromkeys([*scope, "source", "id", "branch"]))
    return log.current(keys).where("change <> 'removed'").select(*keys, "body")


MEMBER_SCHEMA = (
    "source string, osv_id string, id string, modified string, body_hash string, severity string, withdrawn string, aliases array<string>, retired boolean"
)


def merge_query_results(members: BatchTable, conflicts: BatchTable) -> Callable[[DataFrame, int], None]:
    """Handler for query responses (members plus ``complete`` and possibly no osv_id for an empty answer).

    A complete answer retires members it no longer lists; a partial one keeps them. Older revisions are ignored, and
    an equal revision with another body is a conflict that goes to its own table.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        answers = rows.groupBy("source").agg(F.every("complete").alias("complete"))
        incoming = rows.where("osv_id IS NOT NULL").drop("complete").withColumn("retired", F.lit(False))
        stored = members.current(["source", "osv_id"], batch_id).drop("batch").join(answers.select("source"), "source", "left_semi")
        kept = stored.where("NOT retired")
        columns = [f.name for f in members.schema.fields]
        newest, clash = latest_members(kept.select(*columns).unionByName(incoming.select(*columns)))
        conflicts.write(clash, batch_id)
        listed = incoming.select("source", "osv_id").distinct()
        gone = (
            kept.join(answers.where("complete"), "source", "left_semi").join(listed, ["source", "osv_id"], "left_anti")
            .withColumn("retired", F.lit(True))
        )
        known = kept.select("source", "osv_id", F.col("modified").alias("__m"), F.col("body_hash").alias("__b"))
        fresh = newest.join(known, ["source", "osv_id"], "left").where(
            F.col("__m").isNull() | (F.col("__m") != F.col("modified")) | (F.col("__b") != F.col("body_hash"))
        )
        # A member of a complete answer that was retired earlier comes back as fresh; retired rows are not in `kept`.
        members.write(fresh.select(*columns).unionByName(gone.select(*columns)), batch_id)
        rows.unpersist()

    return handle


def current_advisories(members: BatchTable) -> DataFrame:
    """Advisories of the live members."""
    return group_members(members.current(["source", "osv_id"]).where("NOT retired"))


JOB_OUTPUT = "id string, revision string, state string, attempts int, next_attempt timestamp"
JOB_STATE = "state string, attempts int, next_attempt timestamp"


def _job_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Folds the outcomes of one job; a failure schedules the next attempt, a success ends the job."""
    if state.hasTimedOut:
        status, attempts, upcoming = state.get
        state.remove()
        yield pd.DataFrame({"id": [key[0]], "revision": [key[1]], "state": ["due"], "attempts": [attempts], "next_attempt": [upcoming]})
        return
    status, attempts, upcoming = state.get if state.exists else ("pending", 0, None)
    events = sorted((row for frame in batches for row in zip(frame["at"], frame["ok"], frame["retry_after"])), key=lambda r: r[0])
    for at, ok, retry_after in events:
        attempts += 1
        if ok:
            status, upcoming = "done", None
            continue
        # A later failure of a finished revision reopens it, as the queue does.
        wait = min(86_400, max(60 * 2 ** min(attempts - 1, 11), 0 if pd.isna(retry_after) else int(retry_after)))
        status, upcoming = "pending", at + pd.Timedelta(seconds=wait)
    state.update((status, attempts, None if upcoming is None else upcoming.to_pydatetime()))
    if upcoming is not None:
        delay = (upcoming - events[-1][0]).total_seconds() if events else 60
        state.setTimeoutDuration(max(1, int(delay * 1000)))
    yield pd.DataFrame({"id": [key[0]], "revision": [key[1]], "state": [status], "attempts": [attempts], "next_attempt": [upcoming]})


def job_states(outcomes: DataFrame, timers: bool = True) -> DataFrame:
    """Stateful stream of job outcomes (id, revision, at, ok, retry_after) to job states with backoff.

    With timers a continuous query also emits a job when its next attempt is due, which calls Python for every job revision.
    A run over what is available needs none: the fold depends on the number of outcomes and the last one alone (by batch,
    then by time), so it is a streaming aggregate, for the update mode as well.
    """
    if not timers:
        return _folded_states(outcomes)
    return outcomes.groupBy("id", "revision").applyInPandasWithState(_job_step, JOB_OUTPUT, JOB_STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def _folded_states(outcomes: DataFrame) -> DataFrame:
    """The states of :func:`_job_step` without timers. A batch has one timestamp, which only orders it among the batches."""
    folded = outcomes.withColumn("__batch", F.current_timestamp()).groupBy("id", "revision").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.max_by(F.struct("at", F.coalesce("ok", F.lit(False)).alias("ok"), "retry_after"), F.struct("__batch", "at")).alias("last"),
    )
    backoff = F.lit(60) * F.pow(F.lit(2), F.least(F.col("attempts") - 1, F.lit(11))).cast("bigint")
    wait = F.least(F.lit(86_400), F.greatest(backoff, F.coalesce(F.col("last.retry_after").cast("bigint"), F.lit(0))))
    return folded.select(
        "id", "revision", F.when(F.col("last.ok"), "done").otherwise("pending").alias("state"), F.col("attempts").cast("int").alias("attempts"),
        F.when(~F.col("last.ok"), F.timestamp_add("SECOND", wait, F.col("last.at"))).alias("next_attempt"),
    )


FEED_SCHEMA = "source string, attempted timestamp, succeeded timestamp, status string, count bigint, error string, content_hash string"


def feed_transitions(health: BatchTable) -> Callable[[DataFrame, int], None]:
    """Handler for feed attempts (source, sequence, at, status, count, error, content_hash).

    The last attempt of a batch is kept per feed; success time, count and hash come from the last success, so a failure
    never clears them.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        ok = F.col("status") == "ok"
        folded = batch.groupBy("source").agg(
            F.max_by(F.struct("at", "status", "error"), "sequence").alias("last"),
            F.max_by(F.when(ok, F.struct("at", "count", "content_hash")), F.when(ok, F.col("sequence"))).alias("good"),
        )
        before = health.current(["source"], batch_id).select(
            "source", F.struct(F.col("succeeded").alias("at"), "count", "content_hash").alias("known")
        )
        rows = folded.join(before, "source", "left")
        kept = F.coalesce("good", "known")
        health.write(
            rows.select(
                "source", F.col("last.at").alias("attempted"), kept["at"].alias("succeeded"), F.col("last.status").alias("status"),
                F.coalesce(kept["count"], F.lit(0)).alias("count"), F.coalesce("last.error", F.lit("")).alias("error"), F.coalesce(kept["content_hash"], F.lit("")).alias("content_hash"),
            ),
            batch_id,
        )

    return handle


ASSESSMENT_SCHEMA = "target string, report_id string, content_hash string, findings bigint"


def reassess(
    assessments: BatchTable, correlate: Callable[[DataFrame], DataFrame], inventory: Callable[[DataFrame], DataFrame]
) -> Callable[[DataFrame, int], None]:
    """Handler for changed advisories: recomputes the targets they touch and appends only meaningful changes.

    ``inventory(batch)`` gives the dependency rows (target, ...) of the latest reports touched by the batch;
    ``correlate(rows)`` their findings (target, id, severity, status). A target is saved when the digest of its findings
    differs from its last saved one. An inventory that serves many batches is best persisted by its owner, partitioned as
    ``correlate`` joins it.
    """
    from sightline.sinks.store import content_digests

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = inventory(batch)
        own = rows.storageLevel == StorageLevel.NONE  # an inventory that its owner keeps for all batches stays
        rows = rows.persist() if own else rows
        found = correlate(rows).select("target", "id", "severity", "status").distinct().persist()
        content = content_digests(found, ["target"], ["id", "severity", "status"], ["id", "severity", "status"])
        counts = found.groupBy("target").agg(F.count(F.lit(1)).alias("findings"))
        now = rows.select("target").distinct().join(content, "target", "left").join(counts, "target", "left").fillna("", ["content_hash"]).fillna(0, ["findings"])
        before = assessments.current(["target"], batch_id).select("target", F.col("content_hash").alias("__saved"))
        changed = now.join(before, "target", "left").where(~F.col("__saved").eqNullSafe(F.col("content_hash")))
        report = F.concat("target", F.lit(f"#{batch_id}"))
        assessments.write(changed.select("target", report.alias("report_id"), "content_hash", "findings"), batch_id)
        found.unpersist()
        if own:
            rows.unpersist()

    return handle


EVENT_SCHEMA = "kind string, body string"


def log_results(events: BatchTable, kind: str, describe: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Handler that appends one event row per result row of a batch (``describe`` gives the columns of the body)."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = describe(batch)
        events.write(rows.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*rows.columns)).alias("body")), batch_id)

    return handle
