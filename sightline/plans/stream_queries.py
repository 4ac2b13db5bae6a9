"""Streaming queries: the event and part tables arrive as files in order and run through the feed handlers.

Each query plays the whole table as three micro-batches and returns the table the stream maintains.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators import advisories as adv
from sightline.plans.advisory_queries import _CORR_SQL, observations, rated_advisories
from sightline.plans.registry import query
from sightline.plans.tables import Tables, joined, text
from sightline.session import checkpoint_root
from sightline.streaming import jobs
from sightline.streaming.tables import BatchTable, poll


class Playground:
    """Folders of one run, below the session's shared checkpoint folder."""

    def __init__(self, t: Tables):
        self.t = t
        self.root = f"{checkpoint_root(t.spark)}/stream-{uuid.uuid4().hex}"

    def table(self, name: str, schema: str) -> BatchTable:
        return BatchTable(self.t.spark, f"{self.root}/{name}", schema)

    def arrivals(self, rows: DataFrame, third: Column) -> DataFrame:
        """The rows as a stream of files; :meth:`play` lets the thirds (0, 1, 2) arrive in that order."""
        self.marked = rows.withColumn("__third", third)
        self._arrive(0)
        return self.t.spark.readStream.schema(rows.schema).parquet(f"{self.root}/incoming")

    def _arrive(self, part: int) -> None:
        """Writes a third in as many files as it has tasks, so no third passes through one task."""
        self.marked.where(F.col("__third") == part).drop("__third").write.mode("append").parquet(f"{self.root}/incoming")

    def play(self, stream: DataFrame, handle: Callable[[DataFrame, int], None], output_mode: str = "append") -> None:
        """Each third is one micro-batch: all that has arrived is processed, then the next one arrives."""
        offsets = f"{self.root}/offsets-{uuid.uuid4().hex}"
        for part in range(3):
            if part:
                self._arrive(part)
            poll(stream, handle, offsets, output_mode=output_mode).awaitTermination()


def by_event() -> Column:
    day = F.dayofmonth("day")
    return F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2)


@query(
    "str_02_delta_ingest",
    """SELECT DISTINCT 'CVE-2024-' || (10000 + user_id) AS id, 'r' || (k % 7) AS revision FROM events_k""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    p = Playground(t)
    queue, cursors = p.table("queue", jobs.QUEUE_SCHEMA), p.table("cursor", "fetched timestamp")
    rows = t.events_k.select(
        joined("CVE-2024-", text(F.col("user_id") + 10000)).alias("id"), joined("r", text(F.col("k") % 7)).alias("revision"), F.col("ts").cast("timestamp").alias("fetched"), "day"
    )
    p.play(p.arrivals(rows, by_event()), jobs.ingest_delta(queue, cursors))
    return queue.read().select("id", "revision")


@query(
    "str_03_idempotent_enqueue",
    """SELECT 'CVE-2024-' || (10000 + user_id) AS id, 'r' || (k % 7) AS revision, min(k % 3) AS priority_seen FROM events_k WHERE day(day) <= 10 GROUP BY ALL
       UNION ALL SELECT id, revision, p FROM (SELECT 'CVE-2024-' || (10000 + user_id) AS id, 'r' || (k % 7) AS revision, min(k % 3) AS p FROM events_k WHERE day(day) > 10 AND day(day) <= 20 GROUP BY ALL) x
         WHERE NOT EXISTS (SELECT 1 FROM events_k e WHERE day(e.day) <= 10 AND 'CVE-2024-' || (10000 + e.user_id) = x.id AND 'r' || (e.k % 7) = x.revision)
       UNION ALL SELECT id, revision, p FROM (SELECT 'CVE-2024-' || (10000 + user_id) AS id, 'r' || (k % 7) AS revision, min(k % 3) AS p FROM events_k WHERE day(day) > 20 GROUP BY ALL) x
         WHERE NOT EXISTS (SELECT 1 FROM events_k e WHERE day(e.day) <= 20 AND 'CVE-2024-' || (10000 + e.user_id) = x.id AND 'r' || (e.k % 7) = x.revision)""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    p = Playground(t)
    queue = p.table("queue", jobs.QUEUE_SCHEMA)
    rows = t.events_k.select(
        joined("CVE-2024-", text(F.col("user_id") + 10000)).alias("id"), joined("r", text(F.col("k") % 7)).alias("revision"), (F.col("k") % 3).alias("priority"),
        F.col("ts").cast("timestamp").alias("queued_at"), "day",
    )
    p.play(p.arrivals(rows, by_event()), lambda batch, n: jobs.enqueue(queue, batch, n))
    return queue.read().select("id", "revision", F.col("priority").alias("priority_seen"))


@query(
    "str_04_change_history",
    """SELECT id, branch, sequence, snapshot_hash FROM (SELECT CAST(user_id AS VARCHAR) AS id, event_type AS branch, event_id AS sequence, 'h' || (k % 2) AS snapshot_hash,
         lag('h' || (k % 2)) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS prev FROM events_k) WHERE prev IS NULL OR prev <> snapshot_hash""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    p = Playground(t)
    history = p.table("history", jobs.OBSERVATION_SCHEMA)
    rows = observations(t).join(t.events_k.select(F.col("event_id").alias("sequence"), "day"), "sequence")
    p.play(p.arrivals(rows, by_event()), jobs.observe(history))
    return history.read().select("id", "branch", "sequence", "snapshot_hash")


_SNAP_SQL = """s AS (SELECT 's' || (user_id % 4) AS source, CASE WHEN day(day) <= 10 THEN 0 WHEN day(day) <= 20 THEN 1 ELSE 2 END AS b, 'i' || user_id AS id, event_type AS branch, CAST(max(k) AS VARCHAR) AS body FROM events_k GROUP BY ALL)"""


@query(
    "str_05_snapshot_replacement",
    f"WITH {_SNAP_SQL} SELECT source, id, branch, body FROM s WHERE b = 2",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    p, log = _snapshots(t)
    return jobs.snapshot_state(log)


@query(
    "str_05_changed_ids",
    f"""WITH {_SNAP_SQL}, k AS (SELECT DISTINCT source, id, branch FROM s), g AS (SELECT k.*, a.body AS x, c.body AS y, e.body AS z FROM k LEFT JOIN s a ON a.b = 0 AND a.source = k.source AND a.id = k.id AND a.branch = k.branch
          LEFT JOIN s c ON c.b = 1 AND c.source = k.source AND c.id = k.id AND c.branch = k.branch LEFT JOIN s e ON e.b = 2 AND e.source = k.source AND e.id = k.id AND e.branch = k.branch)
        SELECT change, count(*) AS n FROM (SELECT CASE WHEN x IS NOT NULL THEN 'added' END AS change FROM g UNION ALL SELECT CASE WHEN x IS NULL AND y IS NOT NULL THEN 'added' WHEN x IS NOT NULL AND y IS NULL THEN 'removed' WHEN x <> y THEN 'changed' END FROM g
          UNION ALL SELECT CASE WHEN y IS NULL AND z IS NOT NULL THEN 'added' WHEN y IS NOT NULL AND z IS NULL THEN 'removed' WHEN y <> z THEN 'changed' END FROM g) WHERE change IS NOT NULL GROUP BY change""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    _, log = _snapshots(t)
    return log.read().groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def _snapshots(t: Tables) -> tuple[Playground, BatchTable]:
    p = Playground(t)
    log = p.table("log", jobs.SNAPSHOT_SCHEMA)
    rows = t.events_k.groupBy(
        joined("s", text(F.col("user_id") % 4)).alias("source"), by_event().alias("part"), joined("i", text(F.col("user_id"))).alias("id"), F.col("event_type").alias("branch")
    ).agg(text(F.max("k")).alias("body"))
    p.play(p.arrivals(rows, F.col("part")), jobs.replace_snapshots(log))
    return p, log


def _member_stream(t: Tables) -> DataFrame:
    """Three answers per source: complete, partial, complete; each lists some members in some revision."""
    key, size = F.col("p_partkey"), F.col("p_size")
    answer = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("part")
    rows = t.part.select("p_partkey", "p_size", "p_brand", answer).where((key + F.col("part")) % 4 != 3)
    return rows.select(
        joined("src", text(key % 5)).alias("source"), joined("M-", text(key)).alias("osv_id"), joined("D-", text(F.floor(key / 3))).alias("id"),
        joined("2024-0", text((size + F.col("part") * 2) % 4)).alias("modified"), joined("b", text((size + F.col("part") * 2) % 4)).alias("body_hash"), F.lit("low").alias("severity"),
        F.lit(None).cast("string").alias("withdrawn"), F.array(joined("CVE-", text(key))).alias("aliases"), (F.col("part") != 1).alias("complete"), "part",
    )


_MEMBER_SQL = """m AS (SELECT p_partkey AS k, 2 * part AS pp, part, (p_size + part * 2) % 4 AS rev FROM part, (SELECT unnest([0, 1, 2]) AS part) WHERE (p_partkey + part) % 4 <> 3),
   a AS (SELECT k, max(CASE WHEN part = 0 THEN rev END) AS r0, max(CASE WHEN part = 1 THEN rev END) AS r1, max(CASE WHEN part = 2 THEN rev END) AS r2 FROM m GROUP BY k)"""


@query(
    "str_06_partial_answers_keep_members",
    f"WITH {_MEMBER_SQL} SELECT 'M-' || k AS osv_id, '2024-0' || greatest(coalesce(r0, -1), coalesce(r1, -1), r2) AS modified FROM a WHERE r2 IS NOT NULL",
)
def _(t: Tables) -> DataFrame:
    members, _ = _merged_members(t)
    return members.current(["source", "osv_id"]).where("NOT retired").select("osv_id", "modified")


def _merged_members(t: Tables) -> tuple[BatchTable, BatchTable]:
    p = Playground(t)
    members, conflicts = p.table("members", jobs.MEMBER_SCHEMA), p.table("conflicts", "source string, osv_id string, modified string")
    rows = _member_stream(t)
    p.play(p.arrivals(rows, F.col("part")), jobs.merge_query_results(members, conflicts))
    return members, conflicts


@query(
    "str_09_old_revisions_ignored",
    f"""WITH {_MEMBER_SQL} SELECT count(*) FILTER (WHERE r0 IS NOT NULL AND r1 IS NOT NULL AND r1 < r0 AND r2 IS NOT NULL) AS kept_newer FROM a""",
)
def _(t: Tables) -> DataFrame:
    members, _ = _merged_members(t)
    # The second answer never lowers a revision the first one stored.
    after_two = members.current(["source", "osv_id"], before=2).select("osv_id", F.col("modified").alias("now"))
    first = members.read(1).select("osv_id", F.col("modified").alias("then"))
    offered = _member_stream(t).where("part = 1").select("osv_id", F.col("modified").alias("offered"))
    last = _member_stream(t).where("part = 2").select("osv_id")
    rows = first.join(offered, "osv_id").join(after_two, "osv_id").join(last, "osv_id")
    return rows.where("offered < then AND now = then").agg(F.count(F.lit(1)).alias("kept_newer"))


@query(
    "str_09_revision_conflicts",
    """SELECT 'M-' || p_partkey AS osv_id FROM part WHERE p_partkey % 6 = 0""",
)
def _(t: Tables) -> DataFrame:
    p = Playground(t)
    members, conflicts = p.table("members", jobs.MEMBER_SCHEMA), p.table("conflicts", "source string, osv_id string, modified string")
    part = F.explode(F.array(F.lit(0), F.lit(1))).alias("part")
    rows = t.part.select("p_partkey", part).select(
        F.lit("s").alias("source"), joined("M-", text(F.col("p_partkey"))).alias("osv_id"), F.lit("D").alias("id"), F.lit("2024").alias("modified"),
        F.when((F.col("p_partkey") % 6 == 0) & (F.col("part") == 1), "other").otherwise("body").alias("body_hash"), F.lit("low").alias("severity"), F.lit(None).cast("string").alias("withdrawn"),
        F.array(F.lit("CVE-1")).alias("aliases"), F.lit(False).alias("complete"), "part",
    )
    p.play(p.arrivals(rows, F.col("part")), jobs.merge_query_results(members, conflicts))
    return conflicts.read().select("osv_id").distinct()


@query(
    "str_07_retry_states",
    """WITH o AS (SELECT 'CVE-' || user_id AS id, event_type AS revision, count(*) AS attempts, arg_max(k % 3 = 0, event_id) AS ok, arg_max(ts, event_id) AS stamp, arg_max(k, event_id) AS k FROM events_k GROUP BY ALL)
       SELECT id, revision, CASE WHEN ok THEN 'done' ELSE 'pending' END AS state, CAST(attempts AS INTEGER) AS attempts,
         CASE WHEN ok THEN '' ELSE strftime(stamp + to_seconds(CAST(least(86400, greatest(60 * CAST(pow(2, least(attempts - 1, 11)) AS BIGINT), CASE WHEN k % 5 = 0 THEN k * 1000 ELSE 0 END)) AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS next_attempt FROM o""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    p = Playground(t)
    rows = t.events_k.select(
        joined("CVE-", text(F.col("user_id"))).alias("id"), F.col("event_type").alias("revision"), F.col("ts").cast("timestamp").alias("at"), (F.col("k") % 3 == 0).alias("ok"),
        F.when(F.col("k") % 5 == 0, F.col("k") * 1000).cast("int").alias("retry_after"), "day",
    )
    states = p.table("states", jobs.JOB_OUTPUT)
    p.play(jobs.job_states(p.arrivals(rows, by_event()), timers=False), _latest_states(states), "update")
    last = states.current(["id", "revision"])
    return last.select("id", "revision", "state", "attempts", F.coalesce(F.date_format("next_attempt", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("next_attempt"))


def _latest_states(states: BatchTable):
    def handle(batch: DataFrame, batch_id: int) -> None:
        states.write(batch.where("state <> 'due'"), batch_id)

    return handle


@query(
    "str_08_feed_health",
    """SELECT event_type AS source, strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S') AS attempted, strftime(max(CASE WHEN k % 3 = 0 THEN ts END), '%Y-%m-%d %H:%M:%S') AS succeeded, CASE WHEN arg_max(k, event_id) % 3 = 0 THEN 'ok' ELSE 'error' END AS status,
        arg_max(CAST(k AS BIGINT), event_id) FILTER (WHERE k % 3 = 0) AS "count" FROM events_k GROUP BY event_type""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    p = Playground(t)
    health = p.table("health", jobs.FEED_SCHEMA)
    k = F.col("k")
    rows = t.events_k.select(
        F.col("event_type").alias("source"), F.col("event_id").alias("sequence"), F.col("ts").cast("timestamp").alias("at"), F.when(k % 3 == 0, "ok").otherwise("error").alias("status"),
        k.cast("bigint").alias("count"), F.lit("").alias("error"), text(k).alias("content_hash"), "day",
    )
    p.play(p.arrivals(rows, by_event()), jobs.feed_transitions(health))
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return health.current(["source"]).select("source", show("attempted"), show("succeeded"), "status", "count")


@query(
    "str_10_reassessment",
    f"""WITH {_CORR_SQL}, f AS (SELECT app_id, count(DISTINCT (finding_id, severity, status)) AS n FROM m GROUP BY app_id) SELECT app_id AS target, n AS findings FROM f""",
    ("deps", "advisories"),
)
def _(t: Tables) -> DataFrame:
    p = Playground(t)
    saved = p.table("assessments", jobs.ASSESSMENT_SCHEMA)
    known = p.table("advisories", "id string, part int")
    all_advisories = rated_advisories(t)
    # One inventory serves all batches: gathered and placed as the correlation joins it once, not by every batch.
    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    inventory = t.deps.withColumn("target", F.col("app_id")).repartition(tasks, "name", "ecosystem", "version").persist()
    stream = p.arrivals(t.advisories.select("id", (F.col("partkey") % 3).cast("int").alias("part")), F.col("part"))

    def handle(batch: DataFrame, n: int) -> None:
        known.write(batch, n)
        seen = known.read(n + 1).select("id").distinct()
        active = all_advisories.join(seen, "id", "left_semi")
        jobs.reassess(
            saved, lambda rows: adv.correlate(rows.drop("target"), active).select(F.col("app_id").alias("target"), F.col("finding_id").alias("id"), "severity", "status"),
            lambda _: inventory,
        )(batch, n)

    p.play(stream, handle)
    inventory.unpersist()
    return saved.current(["target"]).where("findings > 0").select("target", "findings")


@query(
    "str_11_event_log",
    """SELECT 'sync' AS kind, '{"source":"' || event_type || '","rows":' || count(*) || '}' AS body FROM events_k GROUP BY event_type, CASE WHEN day(day) <= 10 THEN 0 WHEN day(day) <= 20 THEN 1 ELSE 2 END""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    p = Playground(t)
    events = p.table("events", jobs.EVENT_SCHEMA)
    rows = t.events_k.select(F.col("event_type").alias("source"), "day")
    describe = lambda batch: batch.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    p.play(p.arrivals(rows, by_event()), jobs.log_results(events, "sync", describe))
    return events.read().select("kind", "body")


@query(
    "str_01_feed_loop",
    f"WITH {_SNAP_SQL} SELECT 's' || s AS source, CAST(3 AS BIGINT) AS snapshots FROM (SELECT unnest([0, 1, 2, 3]) AS s)",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    p = Playground(t)
    seen = p.table("seen", "source string, records bigint")
    rows = t.events_k.select(joined("s", text(F.col("user_id") % 4)).alias("source"), "day")

    def handle(batch: DataFrame, n: int) -> None:
        seen.write(batch.groupBy("source").agg(F.count(F.lit(1)).alias("records")), n)

    p.play(p.arrivals(rows, by_event()), handle)
    return seen.read().groupBy("source").agg(F.count(F.lit(1)).alias("snapshots"))
