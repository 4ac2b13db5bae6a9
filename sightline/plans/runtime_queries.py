"""Runtime evidence and metric queries over the whole event, label and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators import detect, metrics, runtime
from sightline.plans.detect_queries import PROSE_RULES, prose_hits_sql
from sightline.plans.posture_queries import pick
from sightline.plans.registry import query
from sightline.plans.tables import Tables, joined, text

_HEX = "a1b2c3d4" * 8


def scenario_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Surfaces (last event per scenario, snapshot and surface) and marker matches."""
    k = F.col("k")
    rows = t.events_k.select(
        joined("s", text(F.col("user_id"))).alias("scenario"), joined("snap", text(k % 4)).alias("snapshot"), F.col("event_type").alias("surface"),
        "event_id", "k", joined("m", text(k % 3)).alias("marker"), (k % 5 == 0).alias("by_hand"),
    )
    last = F.col("last") % 10
    surfaces = rows.groupBy("scenario", "snapshot", "surface").agg(F.max_by("k", "event_id").alias("last")).select(
        "scenario", "snapshot", "surface",
        F.when(last == 0, "not-run").when(last == 1, "operator-supplied").when(last == 2, "inconclusive").otherwise("captured").alias("state"),
        F.when(last == 1, "unverified").when(last == 3, "adapter-acquired").otherwise("").alias("acquisition"),
    )
    matches = rows.where("k % 2 = 0").select(
        "scenario", "snapshot", "surface", "marker", F.when(F.col("by_hand"), "operator-supplied").otherwise("recorder").alias("origin")
    )
    return surfaces, matches


_SCENARIO_SQL = """sc AS (SELECT 's' || user_id AS scenario, 'snap' || (k % 4) AS snapshot, event_type AS surface, arg_max(k, event_id) % 10 AS l FROM events_k GROUP BY ALL),
   sf AS (SELECT scenario, snapshot, surface, CASE l WHEN 0 THEN 'not-run' WHEN 1 THEN 'operator-supplied' WHEN 2 THEN 'inconclusive' ELSE 'captured' END AS state, l FROM sc),
   mt AS (SELECT DISTINCT 's' || user_id AS scenario, 'snap' || (k % 4) AS snapshot, event_type AS surface, 'm' || (k % 3) AS marker FROM events_k WHERE k % 2 = 0 AND k % 5 <> 0),
   tm AS (SELECT mt.* FROM mt LEFT JOIN sf USING (scenario, snapshot, surface) WHERE coalesce(sf.l, 9) <> 1)"""


@query(
    "jon_25_canary_assertions",
    f"""WITH {_SCENARIO_SQL}, a AS (SELECT event_id, 's' || user_id AS scenario, 'snap0' AS b, 'snap' || (1 + k % 3) AS s, 'm' || (event_id % 3) AS marker, event_type AS surface, CASE WHEN k % 4 = 0 THEN 'present' ELSE 'absent' END AS ex FROM events_k),
       j AS (SELECT a.*, EXISTS (SELECT 1 FROM tm WHERE tm.scenario = a.scenario AND tm.snapshot = a.b AND tm.surface = a.surface AND tm.marker = a.marker) AS hb,
          EXISTS (SELECT 1 FROM tm WHERE tm.scenario = a.scenario AND tm.snapshot = a.s AND tm.surface = a.surface AND tm.marker = a.marker) AS ha, x.state AS sb, y.state AS sa
         FROM a LEFT JOIN sf x ON x.scenario = a.scenario AND x.snapshot = a.b AND x.surface = a.surface LEFT JOIN sf y ON y.scenario = a.scenario AND y.snapshot = a.s AND y.surface = a.surface)
       SELECT event_id AS assertion_id, CASE WHEN ex = 'absent' AND hb AND ha THEN 'failed' WHEN NOT (coalesce(sb, '') = 'captured' AND coalesce(sa, '') = 'captured') THEN
           CASE WHEN coalesce(sb IN ('operator-supplied', 'inconclusive'), false) OR coalesce(sa IN ('operator-supplied', 'inconclusive'), false) THEN 'inconclusive' ELSE 'not-run' END
         WHEN ex = 'present' THEN CASE WHEN hb THEN 'inconclusive' WHEN ha THEN 'passed' ELSE 'failed' END WHEN NOT hb THEN 'inconclusive' WHEN ha THEN 'failed' ELSE 'passed' END AS state FROM j""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    k = F.col("k")
    surfaces, matches = scenario_tables(t)
    assertions = t.events_k.select(
        joined("s", text(F.col("user_id"))).alias("scenario"), F.col("event_id").alias("assertion_id"), F.lit("snap0").alias("baseline"),
        joined("snap", text(k % 3 + 1)).alias("snapshot"), joined("m", text(F.col("event_id") % 3)).alias("marker"),
        F.col("event_type").alias("surface"), F.when(k % 4 == 0, "present").alias("expect"),
    )
    return runtime.evaluate_assertions(assertions, surfaces, matches).select("assertion_id", "state")


@query(
    "jon_26_account_transitions",
    f"""WITH {_SCENARIO_SQL}, e AS (SELECT 's' || user_id AS scenario, event_id AS tid, x.l AS label, CASE x.l WHEN 'baseline-canary' THEN 'snap0' ELSE 'snap' || (1 + k % 3) END AS snapshot, event_type AS surface, 'm' || (event_id % 3) AS marker, x.r AS req, user_id
         FROM events_k, (SELECT unnest([{{'l': 'baseline-canary', 'r': true}}, {{'l': 'after-login_marker', 'r': true}}, {{'l': 'after-ambiguous-account-state', 'r': false}}]) AS x)),
       j AS (SELECT e.*, coalesce(sf.state = 'captured', false) AS cap, mm.marker IS NOT NULL AS seen FROM e LEFT JOIN sf ON sf.scenario = e.scenario AND sf.snapshot = e.snapshot AND sf.surface = e.surface
          LEFT JOIN mt mm ON mm.scenario = e.scenario AND mm.snapshot = e.snapshot AND mm.surface = e.surface AND mm.marker = e.marker),
       m AS (SELECT tid, label, user_id, CASE WHEN req THEN NOT (cap AND seen) ELSE NOT cap OR seen END AS lacking FROM j)
       SELECT tid AS transition_id, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE lacking), '') || CASE WHEN any_value(user_id) % 8 = 0 THEN '+build' ELSE '' END AS missing FROM m GROUP BY tid""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    k = F.col("k")
    surfaces, matches = scenario_tables(t)
    labels = F.array(
        *[F.struct(F.lit(n).alias("label"), F.lit(r).alias("required"), F.lit(b).alias("base")) for n, r, b in
          (("baseline-canary", True, True), ("after-login_marker", True, False), ("after-ambiguous-account-state", False, False))]
    )
    wanted = t.events_k.select(
        joined("s", text(F.col("user_id"))).alias("scenario"), F.col("event_id").alias("transition_id"), F.col("event_type").alias("surface"),
        joined("m", text(F.col("event_id") % 3)).alias("marker"), "k", F.explode(labels).alias("l"),
    ).select(
        "scenario", "transition_id", "surface", "marker", "l.label", "l.required",
        F.when(F.col("l.base"), "snap0").otherwise(joined("snap", text(k % 3 + 1))).alias("snapshot"),
    )
    bindings = t.events_k.select(joined("s", text(F.col("user_id"))).alias("scenario"), (F.col("user_id") % 8 != 0).alias("bound")).distinct()
    out = runtime.transition_evidence(wanted, surfaces, matches, bindings)
    plain = F.array_remove("missing_evidence", "app-build-binding")
    build = F.when(F.array_contains("missing_evidence", "app-build-binding"), "+build").otherwise("")
    return out.select("transition_id", F.concat(F.array_join(plain, ","), build).alias("missing"))


def transcripts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Conversations as runs: user turns are actions, every third turn is a snapshot label."""
    turn = F.col("turn")
    scenario = text(F.col("conv_id")).alias("scenario")
    steps = t.conversations.where(turn % 3 != 0).select(
        scenario, turn.alias("step"), F.when(F.col("conv_id") % 3 == 0, "wait").when(turn % 2 == 1, "open_url").otherwise("tap").alias("action"),
        F.when(F.col("conv_id") % 7 == 0, "failed").otherwise("completed").alias("state"),
    )
    steps = steps.withColumn("action", F.when((F.col("step") % 3 == 2) & (F.col("scenario").cast("bigint") % 2 == 0), "wait").otherwise(F.col("action")))
    labels = t.conversations.where(turn % 3 == 0).select(scenario, joined("l", text(turn)).alias("label"), turn.alias("step"))
    return steps, labels


_TRANSCRIPT_SQL = """st AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 AND conv_id % 2 = 0 THEN 'wait' WHEN conv_id % 3 = 0 THEN 'wait' WHEN turn % 2 = 1 THEN 'open_url' ELSE 'tap' END AS action, conv_id % 7 <> 0 AS ok FROM conversations WHERE turn % 3 <> 0),
   lb AS (SELECT conv_id, turn FROM conversations WHERE turn % 3 = 0)"""


@query(
    "jon_27_delivery_evidence",
    f"""WITH {_TRANSCRIPT_SQL}, c AS (SELECT DISTINCT a.conv_id, a.turn AS t0, b.turn AS t1 FROM lb a JOIN lb b ON a.conv_id = b.conv_id AND b.turn IN (a.turn + 3, a.turn + 6)),
         j AS (SELECT c.*, count(st.turn) AS n, min(st.turn) AS step, min(st.action) AS action, bool_and(ok) AS ok FROM c LEFT JOIN st ON st.conv_id = c.conv_id AND st.turn > t0 AND st.turn < t1 AND st.action <> 'wait' GROUP BY c.conv_id, t0, t1)
       SELECT CAST(conv_id AS VARCHAR) AS scenario, 'l' || t0 AS baseline, 'l' || t1 AS snapshot, step FROM j WHERE n = 1 AND action = 'open_url' AND ok""",
)
def _(t: Tables) -> DataFrame:
    steps, labels = transcripts(t)
    later = labels.select("scenario", F.col("label").alias("snapshot"), F.col("step").alias("s1"))
    near = F.explode(F.array(F.col("step") + 3, F.col("step") + 6)).alias("s1")
    candidates = labels.select("scenario", F.col("label").alias("baseline"), near).join(later, ["scenario", "s1"]).select("scenario", "baseline", "snapshot")
    return runtime.delivery_evidence(candidates, labels, steps)


@query(
    "jon_28_backend_invalidation",
    """WITH p AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN CASE WHEN conv_id % 5 = 0 THEN 'rejected' ELSE 'accepted' END WHEN conv_id % 2 = 0 THEN 'rejected' ELSE 'accepted' END AS outcome FROM conversations)
       SELECT CAST(b.conv_id AS VARCHAR) AS scenario, 'p' || a.turn AS snapshot, CASE WHEN b.outcome = 'accepted' AND b.conv_id % 3 <> 0 AND b.conv_id % 4 <> 1 AND b.conv_id % 11 <> 0 THEN CASE WHEN a.outcome = 'rejected' THEN 'passed' ELSE 'failed' END ELSE 'inconclusive' END AS state
       FROM p b JOIN p a ON a.conv_id = b.conv_id AND a.turn > 0 WHERE b.turn = 0""",
)
def _(t: Tables) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    rows = t.conversations
    scenario = text(conv).alias("scenario")
    probes = rows.select(
        scenario, joined("p", text(turn)).alias("snapshot"),
        F.when(turn == 0, F.when(conv % 5 == 0, "rejected").otherwise("accepted")).when(conv % 2 == 0, "rejected").otherwise("accepted").alias("outcome"),
        F.when((conv % 3 == 0) & (turn > 0), "other").otherwise("host").alias("authority"), F.lit("cred").alias("credential"), F.lit(_HEX).alias("request"),
        F.when((conv % 4 == 1) & (turn > 0), F.sha2(F.lit("x"), 256)).otherwise(F.lit(_HEX)).alias("session"), F.sha2(text(turn), 256).alias("capture"),
        F.lit("target-observed").alias("delivery"), F.lit(True).alias("bound"), F.lit(_HEX).alias("binding"),
    )
    bindings = rows.select(scenario, F.lit(_HEX).alias("identity"), (conv % 11 != 0).alias("bound")).distinct()
    surfaces = rows.select(
        scenario, joined("p", text(turn)).alias("snapshot"), F.lit("network").alias("surface"), F.lit("captured").alias("state"), F.lit("adapter-acquired").alias("acquisition")
    )
    pairs = rows.where("turn > 0").select(scenario, F.lit("p0").alias("baseline"), joined("p", text(turn)).alias("snapshot"))
    return runtime.invalidation_evidence(pairs, probes, bindings, surfaces).select("scenario", "snapshot", "state")


@query(
    "jon_34_manual_captures",
    f"""WITH {_SCENARIO_SQL}, c AS (SELECT 's' || user_id AS scenario, 'snap' || (k % 4) AS snapshot, CASE WHEN k % 3 = 0 THEN 'manual' ELSE event_type END AS surface, bool_or(user_id % 6 <> 0 AND k % 5 = 0) AS fits FROM events_k WHERE k % 7 = 0 GROUP BY ALL)
       SELECT coalesce(sf.scenario, c.scenario) AS scenario, coalesce(sf.snapshot, c.snapshot) AS snapshot, coalesce(sf.surface, c.surface) AS surface,
         CASE WHEN c.scenario IS NOT NULL AND coalesce(sf.l, 9) <> 3 THEN CASE WHEN c.fits THEN 'operator-supplied' ELSE 'inconclusive' END ELSE sf.state END AS state
       FROM sf FULL OUTER JOIN c ON c.scenario = sf.scenario AND c.snapshot = sf.snapshot AND c.surface = sf.surface""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    k = F.col("k")
    surfaces, _ = scenario_tables(t)
    captures = t.events_k.where("k % 7 = 0").select(
        joined("s", text(F.col("user_id"))).alias("scenario"), joined("snap", text(k % 4)).alias("snapshot"),
        F.when(k % 3 == 0, "manual").otherwise(F.col("event_type")).alias("surface"), F.when(k % 5 == 0, "build").otherwise("old").alias("build"),
    )
    bindings = t.events_k.select(joined("s", text(F.col("user_id"))).alias("scenario"), F.lit("build").alias("identity"), (F.col("user_id") % 6 != 0).alias("bound")).distinct()
    return runtime.attach_captures(surfaces, captures, bindings).select("scenario", "snapshot", "surface", "state")


@query(
    "jon_32_plan_links",
    """SELECT report_id, id AS finding_id, '[{"path":"' || path || '","line":' || line || '}]' AS traces, 'not-observed' AS runtime_state FROM findings WHERE status <> 'runtime-confirmed'""",
    ("findings",),
)
def _(t: Tables) -> DataFrame:
    rows = t.findings.withColumn("evidence", F.array(F.struct("path", "line", F.lit("x").alias("excerpt"))))
    return runtime.static_links(rows).select("report_id", "finding_id", F.to_json("source_traces").alias("traces"), "runtime_state")


# --- metrics -------------------------------------------------------------------------------------


@query(
    "agg_25_label_metrics",
    f"""WITH {prose_hits_sql()}, lab AS (SELECT doc_id, quality, toxic FROM labels),
         e AS (SELECT DISTINCT doc_id, CASE WHEN quality = 1 THEN 'TXT-THE' ELSE 'TXT-LICENSE' END AS rule_id FROM lab UNION SELECT doc_id, 'TXT-TOKEN' FROM lab WHERE toxic = 1),
         o AS (SELECT DISTINCT CAST(regexp_extract(path, 'doc([0-9]+)', 1) AS BIGINT) AS doc_id, rule_id FROM hits),
         c AS (SELECT doc_id, doc_id % 17 = 0 AS err, doc_id % 13 = 0 AS inc FROM lab),
         j AS (SELECT coalesce(e.doc_id, o.doc_id) AS doc_id, coalesce(e.rule_id, o.rule_id) AS rule_id, e.doc_id IS NOT NULL AS ex, o.doc_id IS NOT NULL AS ob FROM e FULL OUTER JOIN o ON e.doc_id = o.doc_id AND e.rule_id = o.rule_id),
         s AS (SELECT rule_id, count(*) FILTER (WHERE NOT err AND NOT inc AND ex AND ob) AS tp, count(*) FILTER (WHERE NOT err AND NOT inc AND NOT ex AND ob) AS fp, count(*) FILTER (WHERE NOT err AND NOT inc AND ex AND NOT ob) AS fn,
            count(*) FILTER (WHERE err) AS errored, count(*) FILTER (WHERE inc AND NOT err) AS incomplete FROM j JOIN c ON c.doc_id = j.doc_id GROUP BY rule_id)
       SELECT rule_id, tp, fp, fn, errored, incomplete, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE -1.0 END, 9) AS "precision", CASE WHEN tp + fp > 0 THEN 'defined' ELSE 'undefined-no-predicted-positive-labels' END AS precision_state,
         round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE -1.0 END, 9) AS recall, CASE WHEN tp + fn > 0 THEN 'defined' ELSE 'undefined-no-ground-truth-positive-labels' END AS recall_state FROM s""",
    ("documents_src",),
)
def _(t: Tables) -> DataFrame:
    doc = F.col("doc_id")
    sources = t.documents_src.select("app_id", "path", "suffix", "text")
    status = F.lit("candidate").alias("status")
    observed = detect.scan(sources, PROSE_RULES).select(F.regexp_extract("path", "doc([0-9]+)", 1).cast("bigint").alias("case_id"), "rule_id", status)
    rules = F.array_compact(F.array(F.when(F.col("quality") == 1, "TXT-THE").otherwise("TXT-LICENSE"), F.when(F.col("toxic") == 1, "TXT-TOKEN")))
    expected = t.labels.select(doc.alias("case_id"), F.explode(rules).alias("rule_id"), status)
    cases = t.labels.select(doc.alias("case_id"), (doc % 17 == 0).alias("error"), (doc % 13 == 0).alias("incomplete")).distinct()
    out = metrics.label_metrics(expected, observed, cases)
    return out.withColumn("precision", F.round("precision", 9)).withColumn("recall", F.round("recall", 9))


def tool_records(t: Tables) -> DataFrame:
    k = F.col("k")
    states = ("completed", "completed", "completed", "partial", "unmeasured", "unsupported", "failed", None)
    return t.events_k.select(
        F.col("event_type").alias("tool"), F.get(F.array(*[F.lit(s) for s in states]), (k % 8).cast("int")).alias("state"),
        (F.col("user_id") % 3 == 0).alias("detected"), (k % 3 == 0).alias("risky"), F.col("value").alias("seconds"),
    )


_TOOLS_SQL = """r AS (SELECT event_type AS tool, ['completed', 'completed', 'completed', 'partial', 'unmeasured', 'unsupported', 'failed', NULL][1 + k % 8] AS state, user_id % 3 = 0 AS d, k % 3 = 0 AS y, value FROM events_k)"""


@query(
    "agg_26_tool_scores",
    f"""WITH {_TOOLS_SQL}, s AS (SELECT tool, count(*) AS cases, count(*) FILTER (WHERE state = 'completed') AS completed, count(*) FILTER (WHERE state = 'completed' AND d AND y) AS tp, count(*) FILTER (WHERE state = 'completed' AND d AND NOT y) AS fp,
         count(*) FILTER (WHERE state = 'completed' AND NOT d AND y) AS fn, count(*) FILTER (WHERE state = 'completed' AND NOT d AND NOT y) AS tn, count(*) FILTER (WHERE state = 'unsupported') AS unsupported,
         count(*) FILTER (WHERE state IS NULL OR state = 'failed') AS failed, count(*) FILTER (WHERE y AND (state IS NULL OR state IN ('failed', 'partial', 'unmeasured'))) AS open_risky, median(value) AS m FROM r GROUP BY tool)
       SELECT tool, cases, completed, tp, fp, fn, tn, unsupported, failed, round(tp / (tp + fp), 9) AS alert_precision, round(tp / (tp + fn), 9) AS completed_recall, round(tp / (tp + fn + open_risky), 9) AS end_to_end_recall,
         round(completed / (cases - unsupported), 9) AS eligible_completion_rate, round(m, 6) AS median_seconds FROM s""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    out = metrics.tool_scores(tool_records(t)).drop("partial", "unmeasured")
    for c in ("alert_precision", "completed_recall", "end_to_end_recall", "eligible_completion_rate"):
        out = out.withColumn(c, F.round(c, 9))
    return out.withColumn("median_seconds", F.round("median_seconds", 6))


@query(
    "agg_27_observation_states",
    """WITH o AS (SELECT user_id, event_id, CASE WHEN k = 0 AND event_id % 50 = 0 THEN true WHEN k = 1 AND event_id % 20 = 0 THEN NULL ELSE false END AS inc, CASE WHEN k = 2 AND event_id % 50 = 0 THEN 1 ELSE 0 END AS w FROM events_k)
       SELECT user_id AS case_id, CASE WHEN bool_or(coalesce(inc, false) OR w > 0 OR event_id % 400 = 0) THEN 'partial' WHEN bool_or(inc IS NULL OR event_id % 600 = 4) THEN 'unmeasured' ELSE 'completed' END AS state FROM o GROUP BY user_id""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    k, e = F.col("k"), F.col("event_id")
    rows = t.events_k.select(
        F.col("user_id").alias("case_id"), e.alias("observation"), F.when((k == 0) & (e % 50 == 0), True).when((k == 1) & (e % 20 == 0), F.lit(None)).otherwise(False).alias("incomplete"),
        F.when((k == 2) & (e % 50 == 0), 1).otherwise(0).alias("warnings"), (e % 600 != 4).alias("has_coverage"),
    )
    cov = t.events_k.select(
        F.col("user_id").alias("case_id"), e.alias("observation"), F.when(e % 400 == 0, "limited").otherwise("checked").alias("state")
    )
    return metrics.observation_states(rows, cov)


@query(
    "agg_28_unit_scores",
    """WITH r AS (SELECT ['affected', 'unaffected', 'unknown'][1 + k % 3] AS e, ['completed', 'completed', 'abstained', 'unstable'][1 + user_id % 4] AS s, k % 5 < 3 AS m FROM events_k),
         c AS (SELECT count(*) FILTER (WHERE e = 'affected' AND s = 'completed' AND m) AS tp, count(*) FILTER (WHERE e = 'unaffected' AND s = 'completed' AND m) AS fp, count(*) FILTER (WHERE e = 'affected' AND s = 'completed' AND NOT m) AS fn,
           count(*) FILTER (WHERE e = 'unaffected' AND s = 'completed' AND NOT m) AS tn, count(*) FILTER (WHERE e <> 'unknown' AND s <> 'completed') AS failed, count(*) FILTER (WHERE e = 'affected' AND s <> 'completed') AS failed_affected,
           count(*) FILTER (WHERE e = 'unknown') AS "unknown", count(*) FILTER (WHERE e = 'unknown' AND s = 'abstained' AND NOT m) AS correct_abstentions, count(*) FILTER (WHERE e <> 'unknown' AND s = 'unstable') AS unstable FROM r)
       SELECT *, round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) AS completed_recall, round(tp / (tp + fn + failed_affected), 9) AS end_to_end_recall FROM c""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    k = F.col("k")
    rows = t.events_k.select(
        pick(("affected", "unaffected", "unknown"), k % 3).alias("expected"), pick(("completed", "completed", "abstained", "unstable"), F.col("user_id") % 4).alias("state"), (k % 5 < 3).alias("matched")
    )
    out = metrics.unit_scores(rows)
    for c in ("precision", "completed_recall", "end_to_end_recall"):
        out = out.withColumn(c, F.round(c, 9))
    return out


@query(
    "agg_29_pair_totals",
    """WITH p AS (SELECT user_id % 5 AS g, ['tp', 'fn', 'unscored'][1 + k % 3] AS v, ['fp', 'tn', 'unscored'][1 + event_id % 3] AS f, k % 4 = 0 AS ll, k % 6 = 0 AS d, k % 20 = 0 AS e FROM events_k)
       SELECT g, count(*) FILTER (WHERE NOT e AND v = 'tp') AS tp, count(*) FILTER (WHERE NOT e AND v = 'fn') AS fn, count(*) FILTER (WHERE NOT e AND f = 'fp') AS fp, count(*) FILTER (WHERE NOT e AND f = 'tn') AS tn,
         count(*) FILTER (WHERE NOT e AND ll) AS line_level_tp, count(*) FILTER (WHERE NOT e AND d) AS discriminating_tp, count(*) FILTER (WHERE e) AS errors,
         CAST(coalesce(sum(CASE WHEN e THEN 0 ELSE (v = 'unscored')::INT + (f = 'unscored')::INT END), 0) AS BIGINT) AS unscored_sides, count(*) FILTER (WHERE NOT e AND (v <> 'unscored' OR f <> 'unscored')) AS scored_pairs FROM p GROUP BY g""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    k = F.col("k")
    rows = t.events_k.select(
        (F.col("user_id") % 5).alias("g"), pick(("tp", "fn", "unscored"), k % 3).alias("vulnerable"), pick(("fp", "tn", "unscored"), F.col("event_id") % 3).alias("fixed"),
        (k % 4 == 0).alias("line_level"), (k % 6 == 0).alias("discriminating"), (k % 20 == 0).alias("error"),
    )
    return metrics.pair_totals(rows, ["g"])


def demo_rows(t: Tables) -> DataFrame:
    k, e = F.col("k"), F.col("event_id")
    return t.events_k.select(
        joined("t", text(F.floor(e / 4))).alias("test"), pick(("fail", "pass", "skip"), k % 3).alias("label"), pick(("tp", "tn", "tp", "fn"), F.col("user_id") % 4).alias("outcome"), (k % 7 != 0).alias("in_scope")
    )


_DEMO_SQL = """d AS (SELECT 't' || (event_id // 4) AS test, ['fail', 'pass', 'skip'][1 + k % 3] AS label, ['tp', 'tn', 'tp', 'fn'][1 + user_id % 4] AS outcome, k % 7 <> 0 AS sc FROM events_k)"""


@query(
    "agg_30_strict_pairs",
    f"WITH {_DEMO_SQL} SELECT test, bool_and(outcome IN ('tp', 'tn')) AS strict FROM d WHERE sc AND label <> 'skip' GROUP BY test HAVING count(DISTINCT label) = 2",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    return metrics.strict_pairs(demo_rows(t))


@query("agg_30_outcome_histogram", f'WITH {_DEMO_SQL} SELECT outcome, count(*) AS "rows" FROM d GROUP BY outcome', ("events_k",))
def _(t: Tables) -> DataFrame:
    return metrics.outcome_histogram(demo_rows(t))


@query(
    "agg_31_repetition_stability",
    """WITH tr AS (SELECT event_type AS tool, event_id // 15 AS c, event_id % 3 AS rep, CASE WHEN k < 30 THEN 'a' ELSE 'b' END AS sig, ['TP', 'FN'][1 + (event_id // 15) % 2] AS cls FROM events_k),
         p AS (SELECT tool, c, count(*) = 2 AND count(DISTINCT CASE WHEN rep < 2 THEN rep END) = 2 AS complete, count(DISTINCT sig) = 1 AS same, any_value(cls) AS cls FROM tr GROUP BY ALL)
       SELECT tool, count(*) FILTER (WHERE complete AND same AND cls = 'TP') AS tp, count(*) FILTER (WHERE complete AND same AND cls = 'FN') AS fn, count(*) FILTER (WHERE NOT (complete AND same)) AS excluded, bool_and(complete AND same) AS stable, count(*) AS cases FROM p GROUP BY tool""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    e = F.col("event_id")
    trials = t.events_k.select(
        F.col("event_type").alias("tool"), F.floor(e / 15).alias("case_id"), (e % 3).alias("repetition"), F.when(F.col("k") < 30, "a").otherwise("b").alias("signature"),
        pick(("TP", "FN"), F.floor(e / 15) % 2).alias("classification"),
    )
    return metrics.stability_summary(metrics.repetition_stability(trials, 2)).select("tool", "tp", "fn", "excluded", "stable", "cases")


@query(
    "agg_32_two_tool_comparison",
    f"""WITH {_TOOLS_SQL}, s AS (SELECT tool, count(*) FILTER (WHERE state = 'completed' AND d AND y) AS tp, count(*) FILTER (WHERE state = 'completed' AND d AND NOT y) AS fp, count(*) FILTER (WHERE state = 'completed' AND NOT d AND y) AS fn,
         count(*) FILTER (WHERE state = 'completed') AS scored_cases FROM r WHERE tool IN ('click', 'view') GROUP BY tool) SELECT tool, tp, fp, fn, scored_cases, round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) AS recall FROM s""",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    rows = tool_records(t).where("tool IN ('click', 'view')").withColumnRenamed("detected", "matched")
    out = metrics.two_tool_comparison(rows)
    return out.select("tool", "tp", "fp", "fn", "scored_cases", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(
    "agg_33_catalog_scores",
    """WITH x AS (SELECT p_partkey % 5 <> 0 AS found, p_partkey % 3 <> 0 AS dec, p_size % 2 = 0 AS ship, p_size % 4 = 0 AS agree FROM part),
         c AS (SELECT count(*) FILTER (WHERE found AND dec AND ship) AS tp, count(*) FILTER (WHERE found AND dec AND NOT ship) AS fp, count(*) FILTER (WHERE found AND NOT dec AND ship) AS abstained_shipped,
           count(*) FILTER (WHERE NOT found) AS missing_entry, count(*) FILTER (WHERE found AND dec AND ship AND agree) AS versions_agree FROM x)
       SELECT *, round(tp / (tp + fp), 9) AS declared_precision, round(tp / (tp + abstained_shipped), 9) AS shipped_coverage FROM c""",
)
def _(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    truth = t.part.select(key.alias("alias"), (size % 2 == 0).alias("shipped"), F.array(F.when(size % 4 == 0, "1").otherwise("2"), F.lit("3")).alias("shipped_versions"))
    entries = t.part.where(key % 5 != 0).select(key.alias("alias"), (key % 3 != 0).alias("declared"), F.lit("1").alias("version"))
    out = metrics.catalog_scores(truth, entries)
    return out.select(
        "tp", "fp", "abstained_shipped", "missing_entry", "versions_agree", F.round("declared_precision", 9).alias("declared_precision"), F.round("shipped_coverage", 9).alias("shipped_coverage")
    )


@query(
    "agg_33_lockfile_scores",
    """WITH e AS (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'A'), o AS (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N')
       SELECT (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM o) AS observed, (SELECT count(*) FROM e ANTI JOIN o USING (l_partkey, l_linenumber)) AS missing, (SELECT count(*) FROM o ANTI JOIN e USING (l_partkey, l_linenumber)) AS unexpected""",
)
def _(t: Tables) -> DataFrame:
    pair = [F.col("l_partkey").alias("name"), F.col("l_linenumber").alias("version")]
    return metrics.lockfile_scores(t.lineitem.where("l_returnflag <> 'A'").select(*pair), t.lineitem.where("l_returnflag <> 'N'").select(*pair))


_STATES_SQL = """o AS (SELECT user_id, string_agg(DISTINCT s, ',' ORDER BY s) AS observed, bool_and(s IN ('affected', 'unknown')) AS sub FROM (SELECT user_id, ['affected', 'unknown', 'outside'][CASE WHEN user_id % 4 = 0 THEN 1 + k % 2 ELSE 1 + (k // 50 + user_id % 2) % 3 END] AS s FROM events_k) GROUP BY user_id),
   c AS (SELECT DISTINCT user_id FROM events_k)"""


def state_cases(t: Tables) -> tuple[DataFrame, DataFrame]:
    cases = t.events_k.select(F.col("user_id").alias("case_id"), F.array(F.lit("unknown"), F.lit("affected")).alias("expected")).distinct()
    seen = t.events_k.select(
        F.col("user_id").alias("case_id"), pick(("affected", "unknown", "outside"), F.when(F.col("user_id") % 4 == 0, F.col("k") % 2).otherwise((F.floor(F.col("k") / 50) + F.col("user_id") % 2) % 3)).alias("state")
    )
    return cases, seen


@query(
    "agg_34_branch_agreement",
    f"WITH {_STATES_SQL} SELECT c.user_id AS case_id, coalesce(observed, '') AS observed, coalesce(observed = 'affected,unknown', false) AS correct FROM c LEFT JOIN o USING (user_id)",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    return metrics.state_agreement(*state_cases(t))


@query(
    "agg_38_os_case_agreement",
    f"WITH {_STATES_SQL} SELECT c.user_id AS case_id, coalesce(observed, '') AS observed, coalesce(sub, false) AS correct FROM c LEFT JOIN o USING (user_id)",
    ("events_k",),
)
def _(t: Tables) -> DataFrame:
    return metrics.state_agreement(*state_cases(t), exact=False)


@query(
    "agg_37_inventory_labels",
    """SELECT p_partkey AS label_id, EXISTS (SELECT 1 FROM deps d WHERE d.partkey = p_partkey AND d.version = '1.' || (1 + p_size % 7) AND (d.path = 'mod' || (p_size % 5) || '/build.gradle')) AS extracted FROM part""",
    ("deps",),
)
def _(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    labels = t.part.select(
        key.alias("label_id"), Tables.ecosystem(key).alias("ecosystem"), joined("org.g", text(key % 13), ":lib", text(key)).alias("name"), joined("1.", text(size % 7 + 1)).alias("version"),
        joined("mod", text(size % 5), "/build.gradle").alias("path"),
    )
    found = t.deps.withColumn("path", F.when(F.col("partkey") % 2 == 0, F.concat(F.lit("root/"), "path")).otherwise(F.col("path")))
    return metrics.inventory_labels(labels, found)


@query(
    "agg_37_configuration_labels",
    """WITH l AS (SELECT p_partkey AS k, p_partkey % 2 = 0 AS expected, p_partkey % 3 <> 0 AS covered, p_partkey % 4 < 2 AS matched FROM part) SELECT k AS label_id, covered, matched, covered AND matched = expected AS correct FROM l""",
)
def _(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    app = joined("a", text(key % 50)).alias("app_id")
    path = joined("m", text(key), "/AndroidManifest.xml")
    labels = t.part.select(key.alias("label_id"), app, path.alias("path"), F.lit("ANDROID-DEBUG").alias("rule_id"), (key % 2 == 0).alias("expected"))
    configs = t.part.where(key % 3 != 0).select(app, F.concat(F.lit("root/"), path).alias("path"))
    found = t.part.where(key % 4 < 2).select(app, F.lit("ANDROID-DEBUG").alias("rule_id"), path.alias("path"))
    return metrics.configuration_labels(labels, configs, found)


@query(
    "agg_39_labelled_scope",
    """WITH f AS (SELECT report_id, path, bool_and(k % 20 <> 0) AS ok FROM findings GROUP BY ALL), lab AS (SELECT DISTINCT report_id, path FROM findings WHERE user_id % 4 = 0),
         ff AS (SELECT lab.report_id, bool_and(f.ok) AS files_checked FROM lab JOIN f USING (report_id, path) GROUP BY lab.report_id),
         rs AS (SELECT report_id, bool_and(state IN ('checked', 'not-applicable')) AND bool_or(state = 'checked') AS ok FROM coverage WHERE rule_id = 'RULE-CLICK' GROUP BY report_id)
       SELECT report_id AS side_id, files_checked, coalesce(rs.ok, false) AS rules_checked, files_checked AND coalesce(rs.ok, false) AS complete FROM ff LEFT JOIN rs USING (report_id)""",
    ("findings", "coverage"),
)
def _(t: Tables) -> DataFrame:
    labels = t.findings.where("user_id % 4 = 0").select(F.col("report_id").alias("side_id"), "report_id", "path").distinct()
    files = t.findings.groupBy("report_id", "path").agg(F.when(F.every(F.col("k") % 20 != 0), "checked").otherwise("partial").alias("state"))
    rules = labels.select("side_id").distinct().withColumn("rule_id", F.lit("RULE-CLICK"))
    return metrics.labelled_scope(labels, files, t.coverage, rules)


def lint_rows(t: Tables) -> DataFrame:
    k = F.col("k")
    return t.events_k.select(
        joined("app-", text(F.col("user_id"))).alias("app_id"), F.col("event_type").alias("check_id"), pick(("fail", "warn", "info", "na", "error", "pass"), F.floor(k / 17)).alias("status"),
        pick(("HIGH", "MEDIUM", "LOW", "INFO"), k % 4).alias("severity"), "event_id", joined("detail ", text(k)).alias("detail"),
    )


_LINT_SQL = """ln AS (SELECT 'app-' || user_id AS app_id, event_type AS check_id, ['fail', 'warn', 'info', 'na', 'error', 'pass'][1 + k // 17] AS status, ['HIGH', 'MEDIUM', 'LOW', 'INFO'][1 + k % 4] AS severity, event_id, 'detail ' || k AS detail FROM events_k)"""


@query("agg_35_lint_histogram", f'WITH {_LINT_SQL} SELECT app_id, status, count(*) AS "rows" FROM ln GROUP BY ALL', ("events_k",))
def _(t: Tables) -> DataFrame:
    return metrics.lint_counts(lint_rows(t), ["app_id"])


@query("agg_35_lint_exit_code", f"WITH {_LINT_SQL} SELECT app_id, CAST(max(CASE WHEN status IN ('fail', 'error') THEN 1 ELSE 0 END) AS INTEGER) AS exit_code FROM ln GROUP BY app_id", ("events_k",))
def _(t: Tables) -> DataFrame:
    return metrics.lint_exit(lint_rows(t), ["app_id"])
