"""Comparison of reports: pairing, difference, follow-up, history, corroboration and claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import ranks
from sightline.functions.paths import base_name, path_agrees
from sightline.operators.coverage import aggregate_state, rule_states, state_mask
from sightline.operators.identity import match_identities
from sightline.operators.ranges import nearby_counts
from sightline.session import cut_lineage
from sightline.scale import with_next_value

PAIR = ("before_id", "after_id")


def paired_sides(pairs: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings of every pair's earlier and later report."""
    before = pairs.select(*PAIR).join(findings, F.col("before_id") == F.col("report_id"))
    after = pairs.select(*PAIR).join(findings, F.col("after_id") == F.col("report_id"))
    return before, after


def difference(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per pair and finding: added, no-longer-observed, changed or unchanged.

    With ``own``/``every`` identity columns a renamed advisory stays one finding; else ids decide.
    """
    before, after = paired_sides(pairs, findings)
    facts = ["rule_id", "severity", "status"]
    if "own" in findings.columns:
        matched = match_identities(after, before, PAIR)
    else:
        matched = after.select(*PAIR, F.col("id").alias("current_id")).join(
            before.select(*PAIR, F.col("id").alias("current_id")), [*PAIR, "current_id"], "left_semi"
        ).select(*PAIR, "current_id", F.col("current_id").alias("previous_id"), F.lit("identity").alias("basis"))
    old = before.select(*PAIR, F.col("id").alias("previous_id"), *[F.col(f).alias(f"before_{f}") for f in facts])
    new = after.select(*PAIR, F.col("id").alias("current_id"), *[F.col(f).alias(f"after_{f}") for f in facts])
    both = new.join(matched, [*PAIR, "current_id"], "left")
    full = both.join(old, [*PAIR, "previous_id"], "full_outer")
    same = F.lit(True)
    for f in facts:
        same = same & F.col(f"before_{f}").eqNullSafe(F.col(f"after_{f}"))
    change = (
        F.when(F.col("previous_id").isNull(), "added").when(F.col("current_id").isNull(), "no-longer-observed")
        .when(same, "unchanged").otherwise("changed")
    )
    return full.select(
        *PAIR, F.coalesce("current_id", "previous_id").alias("id"), change.alias("change"),
        *[F.coalesce(F.col(f"{side}_{f}"), F.lit("")).alias(f"{side}_{f}") for side in ("before", "after") for f in facts],
    )


def observations(pairs: DataFrame, findings: DataFrame, scopes: DataFrame) -> DataFrame:
    """Pairing by id: still, newly or no longer observed, and whether the two scopes are comparable.

    ``scopes``: report_id, scope_hash (null = unavailable) and fingerprint.
    """
    rows = difference(pairs, findings)
    left = scopes.select(F.col("report_id").alias("before_id"), F.col("scope_hash").alias("s0"), F.col("fingerprint").alias("f0"))
    right = scopes.select(F.col("report_id").alias("after_id"), F.col("scope_hash").alias("s1"), F.col("fingerprint").alias("f1"))
    judged = pairs.select(*PAIR).join(left, "before_id", "left").join(right, "after_id", "left").select(
        *PAIR,
        F.when(F.col("s0").isNull() | F.col("s1").isNull(), "unavailable").when(F.col("s0") == F.col("s1"), "unchanged")
        .otherwise("changed").alias("scope_state"),
        F.when(F.col("f0").isNull() | F.col("f1").isNull(), "unavailable").when(F.col("f0") == F.col("f1"), "same-build")
        .otherwise("different-builds").alias("build_state"),
    )
    observation = (
        F.when(F.col("change") == "added", "newly-observed").when(F.col("change") == "no-longer-observed", "no-longer-observed")
        .otherwise("still-observed")
    )
    return rows.join(judged, list(PAIR)).select(
        *PAIR, "id", observation.alias("observation"), "before_status", "after_status", "scope_state", "build_state",
        F.when(F.col("scope_state") == "unchanged", "comparable-observation").otherwise("inconclusive").alias("verification"),
    )


def follow_up(
    selected: DataFrame, before: DataFrame, after: DataFrame, coverage: DataFrame, completeness: DataFrame
) -> DataFrame:
    """Follows chosen earlier findings (before_id, after_id, id) into the later report.

    ``before``/``after``: report_id, id, rule_id, path and ``anchor`` (null without one). Candidates are joined by
    id, by (rule, path, anchor) and by (rule, path); per selected finding the strongest basis wins. Counts, not
    candidate lists, are carried, so a rule with very many findings stays cheap.
    """
    key = [*PAIR, "id"]
    chosen = selected.join(
        before.select(F.col("report_id").alias("before_id"), "id", "rule_id", "path", "anchor"), ["before_id", "id"]
    )
    later = after.select(
        F.col("report_id").alias("after_id"), F.col("id").alias("later_id"), "rule_id", F.col("path").alias("later_path"),
        F.col("anchor").alias("later_anchor"),
    )
    exact = chosen.join(
        later.select("after_id", F.col("later_id").alias("id"), F.col("rule_id").alias("same_rule")), ["after_id", "id"]
    ).groupBy(*key).agg(
        F.bool_or(F.col("same_rule") == F.col("rule_id")).alias("exact"),
        F.bool_or(F.col("same_rule") != F.col("rule_id")).alias("conflict"),
    )
    here = ["after_id", "rule_id"]
    by_path = later.groupBy(*here, "later_path", "later_anchor").agg(F.count_distinct("later_id").alias("n"))
    anchored = chosen.join(
        by_path.select(*here, F.col("later_path").alias("path"), F.col("later_anchor").alias("anchor"), F.col("n").alias("anchored")),
        [*here, "path", "anchor"],
    ).select(*key, "anchored")
    loose = chosen.where("anchor IS NULL").join(
        by_path.where("later_anchor IS NULL").select(*here, F.col("later_path").alias("path"), F.col("n").alias("loose")),
        [*here, "path"],
    ).select(*key, "loose")
    everywhere = later.groupBy(*here).agg(F.count_distinct("later_id").alias("same_rule_total"))
    rows = (
        chosen.join(exact, key, "left").join(anchored, key, "left").join(loose, key, "left").join(everywhere, here, "left")
    )
    n = lambda c: F.coalesce(c, F.lit(0))
    is_exact = F.coalesce("exact", F.lit(False))
    continuations = n("anchored") + n("loose")
    observation = (
        F.when(is_exact, "exact-id-observed").when(continuations > 0, "possible-continuation")
        .when(n("same_rule_total") > 0, "same-rule-elsewhere").otherwise("no-compatible-observation")
    )
    basis = (
        F.when(is_exact, "exact-id").when(n("anchored") > 0, "semantic-path-and-anchors")
        .when(n("loose") > 0, "path-only-unconfirmed").when(n("same_rule_total") > 0, "same-rule-other-location-or-anchor")
        .otherwise("none")
    )
    states = rule_states(coverage)
    blocked = F.coalesce
    rows = rows.join(
        states.select(F.col("report_id").alias("after_id"), "rule_id", F.col("state").alias("after_state")), here, "left"
    ).join(
        states.select(F.col("report_id").alias("before_id"), "rule_id", F.col("state").alias("before_state")),
        ["before_id", "rule_id"], "left",
    )
    rows = rows.join(
        completeness.select(F.col("report_id").alias("after_id"), F.col("incomplete").alias("after_incomplete")), "after_id", "left"
    ).join(
        completeness.select(F.col("report_id").alias("before_id"), F.col("incomplete").alias("before_incomplete")), "before_id", "left"
    )
    codes = F.array_compact(
        F.array(
            F.when(~is_exact & (continuations > 1), "ambiguous-continuation"),
            F.when(observation == "same-rule-elsewhere", "same-rule-elsewhere"),
            F.when(blocked("conflict", F.lit(False)), "finding-identity-conflict"),
            F.when(
                (blocked("after_state", F.lit("not-run")) != "checked") | (blocked("before_state", F.lit("not-run")) != "checked"),
                "rule-coverage-incomplete",
            ),
            F.when(blocked("after_incomplete", F.lit(False)) | blocked("before_incomplete", F.lit(False)), "partial-report"),
            F.when(F.col("path").isNull(), "evidence-path-unavailable"),
        )
    )
    return rows.select(
        *key, observation.alias("observation"), basis.alias("basis"), continuations.alias("continuations"),
        F.array_join(F.array_sort(codes), ",").alias("blockers"),
        F.when(F.size(codes) == 0, "comparable").otherwise("limited").alias("assessment"),
    )


def previous_runs(runs: DataFrame) -> DataFrame:
    """Each runtime run with the last earlier run of the same scenario scope, and whether they compare.

    ``runs``: target, scenario_scope, run_seq, run_id, build_state, build_identity, scenario_identity, partial.
    """
    from sightline.scale import with_previous

    packed = runs.withColumn("__run", F.struct("run_id", "build_state", "build_identity", "scenario_identity", "partial"))
    rows = with_previous(packed, ["target", "scenario_scope"], ["run_seq"], "__run", "__prior")
    prior = F.col("__prior")
    same_build = (
        prior.isNotNull() & (F.col("build_state") == "bound") & (prior["build_state"] == "bound")
        & (F.col("build_identity") == prior["build_identity"])
    )
    comparable = (
        same_build & (F.col("scenario_identity") == prior["scenario_identity"]) & ~F.col("partial") & ~prior["partial"]
    )
    flag = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(
        "run_id", F.coalesce(prior["run_id"], F.lit("")).alias("before_run_id"),
        F.when(flag(same_build), "same-build").otherwise("unavailable-or-different").alias("build_pairing"),
        F.when(flag(comparable), "comparable-observation").otherwise("inconclusive").alias("verification"),
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run per report is its current runtime assessment."""
    from sightline.scale import latest

    return latest(runs, ["report_id"], ["run_seq"])


def timeline(findings: DataFrame, reports: DataFrame, coverage: DataFrame) -> DataFrame:
    """First and last observation per target and finding, and what later reports say about its absence.

    ``reports``: report_id, target, created, complete and ``signature`` (subject, specification and versions). The
    first later complete report with the same signature that fully checked the rule resolves a finding; any other
    later report leaves it inconclusive. Later reports are found from one row per (target, rule, report), not from
    finding-report pairs.
    """
    seen = findings.join(reports.select("report_id", "target", "created", "signature"), "report_id")
    when = F.struct("created", "report_id")
    entries = seen.groupBy("target", "id").agg(
        F.min(when).alias("first"), F.max(when).alias("last"),
        F.max_by(F.struct("rule_id", "severity", "status", "signature"), when).alias("at_last"),
        F.count(F.lit(1)).alias("observations"),
    ).select("target", "id", "first", "last", "observations", "at_last.*")
    newest = reports.groupBy("target").agg(F.max(when).alias("newest"))
    able = rule_states(coverage).where("state = 'checked'").join(
        reports.where("complete").select("report_id", "target", "created", "signature"), "report_id"
    )
    # Forward as-of join on one row per point in time: the next capable report after each last sighting.
    key = ["target", "rule_id", "signature"]
    points = entries.select(
        *key, F.col("last.created").alias("created"), F.col("last.report_id").alias("report_id"), F.lit(None).cast("string").alias("capable")
    ).distinct()
    marks = able.select(*key, "created", "report_id", F.col("report_id").alias("capable"))
    moments = points.unionByName(marks).groupBy(*key, "created", "report_id").agg(
        F.max("capable").alias("capable"), F.bool_or(F.col("capable").isNull()).alias("asked")
    )
    nexts = with_next_value(moments, key, ["created", "report_id"], "capable", "resolved_in").where("asked").select(
        *key, F.struct("created", "report_id").alias("last"), "resolved_in"
    )
    rows = entries.join(nexts, [*key, "last"], "left").join(newest, "target", "left")
    absent = F.col("newest") > F.col("last")
    return rows.select(
        "target", "id", "rule_id", F.col("first.created").alias("first_seen"), F.col("first.report_id").alias("first_report"),
        F.col("last.created").alias("last_seen"), F.col("last.report_id").alias("last_report"), "severity", "status", "observations",
        F.coalesce("resolved_in", F.lit("")).alias("resolved_in"),
        F.when(F.col("resolved_in").isNull() & absent, F.col("newest.report_id")).otherwise("").alias("inconclusive_in"),
    )


def first_observed(findings: DataFrame, reports: DataFrame, limit: int | None = None) -> DataFrame:
    """Earliest report time per target and finding, and whether the target's whole history was within ``limit`` reports, if there is one."""
    window = reports.groupBy("target").agg(F.count(F.lit(1)).alias("reports"))
    return (
        findings.join(reports.select("report_id", "target", "created"), "report_id")
        .groupBy("target", "id").agg(F.min("created").alias("first_observed"))
        .join(window, "target").withColumn("complete", F.lit(True) if limit is None else F.col("reports") <= limit)
    )


def corroboration(external: DataFrame, native: DataFrame, line_window: int = 3) -> DataFrame:
    """Imported and native findings that share a weakness and a place.

    Both: report_id, id, weakness_id, path, line (null = whole file). Rows meet on (report, weakness, file name)
    and on the line bucket, so one busy file never forms all pairs; paths and line distance are then verified.
    """
    width = 2 * line_window + 1

    def prepared(frame: DataFrame, prefix: str) -> DataFrame:
        return frame.select(
            "report_id", "weakness_id", base_name(F.col("path")).alias("__base"), F.col("id").alias(f"{prefix}_id"),
            F.col("path").alias(f"{prefix}_path"), F.col("line").alias(f"{prefix}_line"),
        )

    left, right = prepared(external, "external"), prepared(native, "native")
    bucket = lambda line: F.floor(line / width).cast("bigint")
    keys = ["report_id", "weakness_id", "__base"]
    lined = left.where("external_line IS NOT NULL").withColumn(
        "__b", F.explode(F.sequence(bucket(F.col("external_line") - line_window), bucket(F.col("external_line") + line_window)))
    ).join(right.where("native_line IS NOT NULL").withColumn("__b", bucket(F.col("native_line"))), [*keys, "__b"]).drop("__b")
    whole = left.where("external_line IS NULL").join(right, keys).unionByName(
        left.where("external_line IS NOT NULL").join(right.where("native_line IS NULL"), keys)
    )
    near = F.col("external_line").isNull() | F.col("native_line").isNull() | (
        F.abs(F.col("external_line") - F.col("native_line")) <= line_window
    )
    return (
        lined.unionByName(whole).where(near & path_agrees(F.col("external_path"), F.col("native_path")))
        .select("report_id", "external_id", "native_id").distinct()
    )


def corroboration_counts(external: DataFrame, native: DataFrame, line_window: int = 3) -> DataFrame:
    """For every finding of either side how many of the other share its weakness and place: side, report_id, id,
    weakness_id, path, line, partners.

    The pairs of :func:`corroboration` counted without forming them: findings near a line come from running sums over the
    lines of a file, and findings without a line meet one total a file.
    """
    keys = ["report_id", "weakness_id"]
    tags = ["external", "native"]
    tagged = [frame.withColumn("side", F.lit(side)) for side, frame in zip(tags, (external, native))]
    rows = tagged[0].select("side", *keys, "id", "path", "line").unionByName(tagged[1].select("side", *keys, "id", "path", "line")).distinct()
    rows = cut_lineage(rows)  # read from several ends, each of which would build the findings anew
    queries = rows.select(F.struct("side", "report_id", "id", "weakness_id").alias("query"), *keys, "path", "line")
    # both sides are points of one run, in which each looks at the other's counts
    counts = nearby_counts(queries, rows.withColumnRenamed("side", "tag"), keys, tags, line_window)
    other = F.when(F.col("query.side") == "external", 1).otherwise(0)
    partners = F.get("bare", other) + F.when(F.col("line").isNotNull(), F.get("near", other)).otherwise(F.get("lined", other))
    return counts.where("path IS NOT NULL").select("query.*", "path", "line", partners.alias("partners"))


def group_imported(results: DataFrame, keys: Sequence[str] = ("id",), keep: int = 20) -> DataFrame:
    """Imported results with one identity as one finding: strongest representative, unions and exact counts.

    ``results``: keys, severity, canonical, cwe ARRAY, references ARRAY, observation. Unions are sets of values per
    finding; observations are listed up to ``keep`` with their exact number beside.
    """
    from sightline.scale import top_k

    rank = F.struct((-ranks.severity_rank(F.col("severity"))).alias("r"), F.col("canonical"))
    base = results.groupBy(*keys).agg(
        F.min_by(F.struct("severity", "canonical"), rank).alias("rep"), F.count(F.lit(1)).alias("observation_count")
    )
    distinct = results.select(*keys, "observation").distinct()
    kinds = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct_observations"))
    listed = top_k(distinct, keys, [F.col("observation")], keep, "__rank").groupBy(*keys).agg(
        F.array_sort(F.collect_list("observation")).alias("observations")
    )
    cwe = results.select(*keys, F.explode("cwe").alias("c")).distinct().groupBy(*keys).agg(
        F.array_sort(F.collect_set("c")).alias("cwe")
    )
    out = base.join(kinds, list(keys)).join(listed, list(keys)).join(cwe, list(keys), "left")
    return out.select(
        *keys, "rep.severity", F.col("rep.canonical").alias("representative"), "observation_count", "observations",
        F.coalesce("cwe", F.array().cast("array<string>")).alias("cwe"),
        (F.col("distinct_observations") > keep).alias("truncated"),
    )


def replace_tool_results(existing: DataFrame, imported: DataFrame, tools: DataFrame) -> DataFrame:
    """Earlier external rows of the re-imported tools are replaced; everything else stays."""
    again = (F.col("origin") == "external")
    kept = existing.where(~again).unionByName(
        existing.where(again).join(tools.select("tool").distinct(), "tool", "left_anti").select(*existing.columns)
    )
    return kept.unionByName(imported, allowMissingColumns=True)


def merge_engines(primary: DataFrame, extra: DataFrame, overlap: DataFrame) -> DataFrame:
    """Findings of two engines; an extra row joins the one primary row it states the same fact as.

    ``overlap``: (check, rule_id). Severity rises to the greater; ``engines`` and ``supporting`` list the sources.
    Without exactly one partner the extra row stays a finding of its own.
    """
    facts = primary.groupBy("report_id", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("partner"))
    keyed = extra.join(overlap.select("check", F.col("rule_id").alias("fact")), "check", "left")
    placed = keyed.join(
        facts.where("n = 1").select("report_id", F.col("rule_id").alias("fact"), "partner"), ["report_id", "fact"], "left"
    )
    support = placed.where("partner IS NOT NULL").groupBy("report_id", F.col("partner").alias("id")).agg(
        F.max(ranks.severity_rank(F.col("severity"))).alias("extra_rank"),
        F.array_sort(F.collect_set("rule_id")).alias("supporting"),  # bounded by the overlap table
        F.max("engine").alias("extra_engine"),
    )
    merged = primary.join(support, ["report_id", "id"], "left").select(
        "report_id", "id", "rule_id",
        F.when(
            F.col("extra_rank") > ranks.severity_rank(F.col("severity")), ranks.name_of(F.col("extra_rank"), ranks.SEVERITIES)
        ).otherwise(F.col("severity")).alias("severity"),
        F.array_sort(F.array_distinct(F.array_compact(F.array("engine", "extra_engine")))).alias("engines"),
        F.coalesce("supporting", F.array().cast("array<string>")).alias("supporting"),
    )
    alone = placed.where("partner IS NULL").select(
        "report_id", "id", "rule_id", "severity", F.array("engine").alias("engines"), F.array().cast("array<string>").alias("supporting")
    )
    return merged.unionByName(alone)


def merge_observations(loader: DataFrame, staged: DataFrame, keys: Sequence[str] = ("app_id", "path")) -> DataFrame:
    """Both observation sets by path; loader rows win."""
    left = loader.select(*keys, F.struct(*[c for c in loader.columns if c not in keys]).alias("l"))
    right = staged.select(*keys, F.struct(*[c for c in staged.columns if c not in keys]).alias("s"))
    return left.join(right, list(keys), "full_outer").select(*keys, F.coalesce("l", "s").alias("o")).select(*keys, "o.*")


def verify_claims(
    claims: DataFrame, findings: DataFrame, coverage: DataFrame, bridge: DataFrame, completeness: DataFrame,
    files_table: DataFrame, window: int = 3,
) -> DataFrame:
    """Verdict per claim (claim_id, report_id, path, line, weakness_id, rule_id; unused parts null).

    A claim names checks through its rule or weakness; findings of those checks in the named file and line window
    corroborate it. They are counted by running sums over lines (:mod:`sightline.operators.ranges`), so the work is linear
    in claims and findings however many share a rule. ``files_table``: analyzed files (report_id, path, state).
    """
    by_rule = claims.where("rule_id IS NOT NULL").select("claim_id", "report_id", "rule_id")
    by_weakness = claims.where("rule_id IS NULL").select("claim_id", "report_id", "weakness_id").join(bridge, "weakness_id").select(
        "claim_id", "report_id", "rule_id"
    )
    checks = by_rule.unionByName(by_weakness)
    known = checks.groupBy("claim_id").agg(F.count(F.lit(1)).alias("checks"))
    places = claims.select(F.col("claim_id").alias("query"), "path", "line")
    asked = checks.withColumnRenamed("claim_id", "query").join(places, "query")
    # several checks of a claim may name one rule; each counts, as one query of its own
    asked = asked.groupBy("query", "report_id", "rule_id", "path", "line").agg(F.count(F.lit(1)).alias("times"))
    asked = asked.withColumn("query", F.struct("query", "rule_id", "times"))
    seen = findings.where("origin <> 'external'").select(
        "report_id", "rule_id", "path", "line", F.coalesce(F.when(F.col("status").isin(*ranks.STATUSES), F.col("status")), F.lit("")).alias("tag")
    )
    tags = ["", *ranks.STATUSES]  # in the order of their ranks
    counts = nearby_counts(asked.drop("times"), seen, ["report_id", "rule_id"], tags, window)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda x, y: x + y) * F.col("query.times")
    lined = F.col("path").isNotNull() & F.col("line").isNotNull()
    matching = F.when(lined, F.col("near")).otherwise(F.zip_with("lined", "bare", lambda x, y: x + y))
    strongest = F.array_max(F.filter(F.transform(matching, lambda x, k: F.when(x > 0, k - 1)), lambda x: x.isNotNull()))
    folded = counts.groupBy(F.col("query.query").alias("claim_id")).agg(
        F.sum(total(matching)).alias("matches"),
        F.sum(F.when(lined, total(F.col("lined")) - total(F.col("near"))).otherwise(0)).alias("elsewhere"),
        F.max(strongest).alias("strongest"),
    ).where("matches > 0 OR elsewhere > 0")
    states = checks.join(rule_states(coverage), ["report_id", "rule_id"]).groupBy("claim_id").agg(
        state_mask(F.col("state")).alias("mask")
    )
    analyzed = claims.where("path IS NOT NULL").join(
        files_table.select("report_id", "path", F.col("state").alias("file_state")), ["report_id", "path"]
    ).groupBy("claim_id").agg(F.max("file_state").alias("file_state"))
    rows = (
        claims.join(known, "claim_id", "left").join(folded, "claim_id", "left").join(states, "claim_id", "left")
        .join(analyzed, "claim_id", "left")
        .join(completeness.select("report_id", "incomplete"), "report_id", "left")
    )
    observed = aggregate_state(F.col("mask"))
    file_state = F.when(F.col("path").isNotNull(), F.coalesce("file_state", F.lit("not-analyzed")))
    n = lambda c: F.coalesce(c, F.lit(0))
    verdict = (
        F.when(n("matches") > 0, "corroborated").when(n("checks") == 0, "not-assessed")
        .when(n("elsewhere") > 0, "same-file-other-location")
        .when(F.coalesce(file_state.isin("skipped", "not-analyzed"), F.lit(False)), "file-not-analyzed")
        .when(observed.isin("partial", "limited") | F.coalesce(file_state.isin("partial", "limited"), F.lit(False)), "partial")
        .when(observed == "checked", F.when(F.coalesce("incomplete", F.lit(False)), "partial").otherwise("not-observed"))
        .otherwise("not-run")
    )
    return rows.select(
        "claim_id", "report_id", verdict.alias("verdict"), n("matches").alias("matches"), n("elsewhere").alias("elsewhere"),
        F.coalesce(ranks.name_of(F.col("strongest"), ranks.STATUSES), F.lit("")).alias("strongest_status"),
    )


def changed_keys(old: DataFrame, new: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """Keys whose body was added, removed or changed between two snapshots."""
    left = old.select(*keys, F.col(body).alias("__a"), F.lit(True).alias("__in_a"))
    right = new.select(*keys, F.col(body).alias("__b"), F.lit(True).alias("__in_b"))
    both = left.join(right, list(keys), "full_outer")
    change = (
        F.when(F.col("__in_a").isNull(), "added").when(F.col("__in_b").isNull(), "removed")
        .when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    )
    return both.select(*keys, change.alias("change")).where("change IS NOT NULL")


def expected_observed(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels matched, missing or unexpected."""
    left = expected.select(*keys).distinct().withColumn("__e", F.lit(True))
    right = observed.select(*keys).distinct().withColumn("__o", F.lit(True))
    both = left.join(right, list(keys), "full_outer")
    return both.select(
        *keys,
        F.when(F.col("__e") & F.col("__o"), "matched").when(F.col("__o").isNull(), "missing").otherwise("unexpected").alias("label"),
    )


