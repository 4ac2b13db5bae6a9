"""Runtime evidence: canary assertions, account transitions, delivery, invalidation, captures and plan links.

Snapshots are relational: ``surfaces`` (scenario, snapshot, surface, state, acquisition) and ``matches`` (scenario, snapshot,
surface, marker, origin).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH = r"^[0-9a-f]{64}$"
MUTATIONS = ("launch", "open_url", "tap", "input_text")


def trusted_matches(matches: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Distinct marker sightings that were not supplied by hand or by an unverified capture."""
    doubtful = surfaces.where("acquisition = 'unverified'").select("scenario", "snapshot", "surface").distinct()
    own = matches.where(F.coalesce("origin", F.lit("")) != "operator-supplied")
    return own.join(doubtful, ["scenario", "snapshot", "surface"], "left_anti").select("scenario", "snapshot", "surface", "marker").distinct()


def _side(assertions: DataFrame, trusted: DataFrame, surfaces: DataFrame, snapshot: str, prefix: str) -> DataFrame:
    """Adds hit and surface state of one snapshot column."""
    hit = trusted.select("scenario", F.col("snapshot").alias(snapshot), "surface", "marker", F.lit(True).alias(f"{prefix}_hit"))
    state = surfaces.groupBy("scenario", F.col("snapshot").alias(snapshot), "surface").agg(F.max("state").alias(f"{prefix}_state"))
    return assertions.join(hit, ["scenario", snapshot, "surface", "marker"], "left").join(state, ["scenario", snapshot, "surface"], "left")


def evaluate_assertions(assertions: DataFrame, surfaces: DataFrame, matches: DataFrame) -> DataFrame:
    """State of each assertion (scenario, assertion_id, baseline, snapshot, marker, surface, expect)."""
    trusted = trusted_matches(matches, surfaces)
    rows = assertions.withColumn("surface", F.coalesce("surface", F.lit("storage"))).withColumn("expect", F.coalesce("expect", F.lit("absent")))
    rows = _side(_side(rows, trusted, surfaces, "baseline", "before"), trusted, surfaces, "snapshot", "after")
    before, after = F.coalesce("before_hit", F.lit(False)), F.coalesce("after_hit", F.lit(False))
    captured = (F.coalesce("before_state", F.lit("")) == "captured") & (F.coalesce("after_state", F.lit("")) == "captured")
    doubtful = F.coalesce(F.col("before_state").isin("operator-supplied", "inconclusive"), F.lit(False)) | F.coalesce(
        F.col("after_state").isin("operator-supplied", "inconclusive"), F.lit(False)
    )
    absent = F.col("expect") == "absent"
    state = (
        F.when(absent & before & after, "failed")
        .when(~captured, F.when(doubtful, "inconclusive").otherwise("not-run"))
        .when(~absent, F.when(before, "inconclusive").when(after, "passed").otherwise("failed"))
        .when(~before, "inconclusive").when(after, "failed").otherwise("passed")
    )
    return rows.select("scenario", "assertion_id", state.alias("state"))


def transition_evidence(expectations: DataFrame, surfaces: DataFrame, matches: DataFrame, bindings: DataFrame) -> DataFrame:
    """Missing evidence per account transition.

    ``expectations``: scenario, transition_id, label, snapshot, surface, marker, required (true: must be present in a
    captured surface; false: must be visibly absent, so the surface must be captured). ``bindings``: scenario, bound.
    """
    captured = surfaces.where("state = 'captured'").select("scenario", "snapshot", "surface", F.lit(True).alias("captured")).distinct()
    own = matches.where(F.coalesce("origin", F.lit("")) != "operator-supplied").select(
        "scenario", "snapshot", "surface", "marker", F.lit(True).alias("seen")
    ).distinct()
    rows = expectations.join(captured, ["scenario", "snapshot", "surface"], "left").join(own, ["scenario", "snapshot", "surface", "marker"], "left")
    is_captured, seen = F.coalesce("captured", F.lit(False)), F.coalesce("seen", F.lit(False))
    present = is_captured & seen
    lacking = F.when(F.col("required"), ~present).otherwise(~is_captured | seen)
    per = rows.groupBy("scenario", "transition_id").agg(
        F.array_sort(F.collect_set(F.when(lacking, F.col("label")))).alias("missing")  # labels are a fixed vocabulary
    )
    unbound = bindings.where("NOT bound").select("scenario", F.lit(True).alias("unbound"))
    out = per.join(unbound, "scenario", "left")
    missing = F.when(F.coalesce("unbound", F.lit(False)), F.array_sort(F.array_union("missing", F.array(F.lit("app-build-binding"))))).otherwise(F.col("missing"))
    return out.select(
        "scenario", "transition_id", missing.alias("missing_evidence"),
        F.when(F.size(missing) > 0, "inconclusive").otherwise("passed").alias("state"),
    )


def delivery_evidence(candidates: DataFrame, labels: DataFrame, transcript: DataFrame) -> DataFrame:
    """Candidates (scenario, baseline, snapshot) bracketing exactly one change, a completed link opening.

    ``labels``: scenario, label, step; ``transcript``: scenario, step, action, state. Changes are numbered in step order
    first, so the changes between two snapshots are a difference of two counts, not a range join.
    """
    from sightline.scale import numbered

    changes = numbered(transcript.where(F.col("action").isin(*MUTATIONS)), ["scenario"], ["step"], "nth")
    marks = labels.select("scenario", "step", "label").unionByName(
        changes.select("scenario", "step", F.lit(None).cast("string").alias("label")), allowMissingColumns=True
    )
    # Changes up to each label: a label sorts after the changes of smaller steps.
    counted = _running_count(marks)
    placed = counted.where("label IS NOT NULL").select("scenario", "label", F.col("step").alias("at"), F.col("changes").alias("upto"))
    rows = (
        candidates.distinct()
        .join(placed.select("scenario", F.col("label").alias("baseline"), F.col("at").alias("from_step"), F.col("upto").alias("c0")), ["scenario", "baseline"])
        .join(placed.select("scenario", F.col("label").alias("snapshot"), F.col("at").alias("to_step"), F.col("upto").alias("c1")), ["scenario", "snapshot"])
        .where((F.col("to_step") > F.col("from_step")) & (F.col("c1") - F.col("c0") == 1))
    )
    only = changes.select("scenario", F.col("nth").alias("c1"), F.col("step").alias("opened"), "action", "state")
    return rows.join(only, ["scenario", "c1"]).where("action = 'open_url' AND state = 'completed'").select(
        "scenario", "baseline", "snapshot", F.col("opened").alias("step")
    )


def _running_count(marks: DataFrame) -> DataFrame:
    from sightline.scale import running_total

    # Labels come after changes of the same step, and count none themselves.
    ordered = marks.withColumn("is_label", F.col("label").isNotNull().cast("int")).withColumn("tie", F.coalesce("label", F.lit("")))
    return running_total(ordered, ["scenario"], ["step", "is_label", "tie"], {"changes": (1 - F.col("is_label")).cast("bigint")})


def invalidation_evidence(transitions: DataFrame, probes: DataFrame, bindings: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Backend outcome of logout transitions (scenario, baseline, snapshot).

    ``probes``: scenario, snapshot, outcome, authority, credential, request, session, capture, delivery, bound, binding.
    Both probes must be bound to the build, fresh, of one session, and hit the same authority with the same credential.
    """
    adapter = surfaces.where("surface = 'network' AND state = 'captured' AND acquisition = 'adapter-acquired'").select(
        "scenario", "snapshot", F.lit(True).alias("net")
    ).distinct()
    full = probes.join(adapter, ["scenario", "snapshot"], "left").join(bindings.select("scenario", "identity", F.col("bound").alias("build_bound")), "scenario", "left")
    ok = (
        F.coalesce("net", F.lit(False)) & F.coalesce("build_bound", F.lit(False)) & F.col("bound") & (F.col("binding") == F.col("identity"))
        & F.col("identity").rlike(HASH) & F.col("capture").rlike(HASH) & F.col("request").rlike(HASH) & F.col("session").rlike(HASH)
    )
    fields = ("outcome", "authority", "credential", "session", "capture", "delivery")
    packed = full.select("scenario", "snapshot", F.coalesce(ok, F.lit(False)).alias("ok"), *fields)
    before = packed.select("scenario", F.col("snapshot").alias("baseline"), F.struct("ok", *fields).alias("b"))
    after = packed.select("scenario", "snapshot", F.struct("ok", *fields).alias("a"))
    rows = transitions.join(before, ["scenario", "baseline"], "left").join(after, ["scenario", "snapshot"], "left")
    a, b = F.col("a"), F.col("b")
    valid = (
        a["ok"] & b["ok"] & (a["capture"] != b["capture"]) & (a["session"] == b["session"]) & (a["authority"] == b["authority"])
        & (a["credential"] == b["credential"]) & (a["authority"] != "") & (a["credential"] != "") & (b["outcome"] == "accepted")
        & (a["delivery"] == "target-observed")
    )
    state = F.when(
        F.coalesce(valid, F.lit(False)), F.when(a["outcome"] == "rejected", "passed").when(a["outcome"] == "accepted", "failed").otherwise("inconclusive")
    ).otherwise("inconclusive")
    return rows.select("scenario", "baseline", "snapshot", state.alias("state"))


def attach_captures(surfaces: DataFrame, captures: DataFrame, bindings: DataFrame) -> DataFrame:
    """Surfaces after manual captures (scenario, snapshot, surface, build).

    Recorded surfaces are never overridden; a capture of another build leaves the surface inconclusive, one of the
    bound build makes it operator-supplied and unverified.
    """
    offered = captures.join(bindings.select("scenario", F.col("identity"), "bound"), "scenario", "left").groupBy("scenario", "snapshot", "surface").agg(
        F.bool_or(F.col("bound") & (F.col("build") == F.col("identity"))).alias("fits"), F.count(F.lit(1)).alias("captures")
    )
    known = surfaces.select("scenario", "snapshot").distinct()
    offered = offered.join(known, ["scenario", "snapshot"], "left_semi")
    rows = surfaces.join(offered, ["scenario", "snapshot", "surface"], "full_outer")
    recorded = F.coalesce(F.col("acquisition") == "adapter-acquired", F.lit(False))
    offered_here = F.col("captures").isNotNull() & ~recorded
    fits = F.coalesce("fits", F.lit(False))
    return rows.select(
        "scenario", "snapshot", "surface",
        F.when(offered_here, F.when(fits, "operator-supplied").otherwise("inconclusive")).otherwise(F.col("state")).alias("state"),
        F.when(offered_here, F.when(fits, "unverified").otherwise("")).otherwise(F.coalesce("acquisition", F.lit(""))).alias("acquisition"),
    )


TRACE_FIELDS = ("path", "line", "source", "sink", "sink_api", "trace", "source_trace")


def static_links(findings: DataFrame, present: Sequence[str] = ("path", "line")) -> DataFrame:
    """Plan linkage of every finding that is not runtime-confirmed, with its source traces."""
    fields = [f for f in TRACE_FIELDS if f in present]

    def trace(row: Column) -> Column:
        return F.struct(*[row[f].alias(f) for f in fields])

    return findings.where("status <> 'runtime-confirmed'").select(
        "report_id", F.col("id").alias("finding_id"), "rule_id", F.transform("evidence", trace).alias("source_traces"),
        F.lit("not-observed").alias("runtime_state"),
    )
