"""Detection-quality metrics from labelled data; every rate keeps its denominator and an explicit undefined state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.paths import same_or_suffix
from sightline.scale import exact_median

NO_PREDICTED = "undefined-no-predicted-positive-labels"
NO_TRUTH = "undefined-no-ground-truth-positive-labels"


def count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, or -1 when it is undefined."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(-1.0))


def label_metrics(expected: DataFrame, observed: DataFrame, cases: DataFrame) -> DataFrame:
    """Per rule: tp, fp, fn over scored cases, errored and incomplete ones apart, precision and recall with their state.

    ``expected``/``observed``: case_id, rule_id, status; ``cases``: case_id, error, incomplete.
    """
    keys = ["case_id", "rule_id", "status"]
    left = expected.select(*keys).distinct().withColumn("__e", F.lit(True))
    right = observed.select(*keys).distinct().withColumn("__o", F.lit(True))
    rows = left.join(right, keys, "full_outer").join(cases.select("case_id", "error", "incomplete"), "case_id")
    exp, obs = F.coalesce("__e", F.lit(False)), F.coalesce("__o", F.lit(False))
    scored = ~F.col("error") & ~F.col("incomplete")
    # An unscored case counts once per rule, whatever labels it has.
    per_case = rows.groupBy("case_id", "rule_id").agg(
        F.first(scored).alias("scored"), F.first("error").alias("error"), count(exp & obs).alias("tp"), count(exp & ~obs).alias("fn"),
        count(~exp & obs).alias("fp"),
    )
    ok = F.col("scored")
    per = per_case.groupBy("rule_id").agg(
        *[F.sum(F.when(ok, F.col(c)).otherwise(0)).cast("bigint").alias(c) for c in ("tp", "fp", "fn")],
        count(~ok & F.col("error")).alias("errored"), count(~ok & ~F.col("error")).alias("incomplete"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return per.select(
        "rule_id", "tp", "fp", "fn", "errored", "incomplete",
        ratio(tp, tp + fp).alias("precision"), F.when(tp + fp > 0, "defined").otherwise(NO_PREDICTED).alias("precision_state"),
        ratio(tp, tp + fn).alias("recall"), F.when(tp + fn > 0, "defined").otherwise(NO_TRUTH).alias("recall_state"),
    )


def tool_scores(records: DataFrame, keys: Sequence[str] = ("tool",)) -> DataFrame:
    """Completed, partial, unmeasured, unsupported and failed cases per tool, with precision, recalls and median time.

    ``records``: keys, state, detected, risky, seconds. Only completed cases are scored; unfinished risky ones stay in
    the end-to-end denominator.
    """
    state, detected, risky = F.col("state"), F.col("detected"), F.col("risky")
    done = state == "completed"
    known = state.isin("completed", "partial", "unsupported", "unmeasured")
    failed = ~F.coalesce(known, F.lit(False))
    is_done = F.coalesce(done, F.lit(False))
    per = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"), count(is_done).alias("completed"),
        count(is_done & detected & risky).alias("tp"), count(is_done & detected & ~risky).alias("fp"),
        count(is_done & ~detected & risky).alias("fn"), count(is_done & ~detected & ~risky).alias("tn"),
        *[count(F.coalesce(state == s, F.lit(False))).alias(s) for s in ("partial", "unmeasured", "unsupported")],
        *[count(F.coalesce(state == s, F.lit(False)) & risky).alias(f"{s}_risky") for s in ("partial", "unmeasured")],
        count(failed).alias("failed"), count(failed & risky).alias("failed_risky"),
    )
    per = per.join(exact_median(records, keys, "seconds", "median_seconds"), list(keys), "left")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return per.select(
        *keys, "cases", "completed", "tp", "fp", "fn", "tn", "partial", "unmeasured", "unsupported", "failed",
        ratio(tp, tp + fp).alias("alert_precision"), ratio(tp, tp + fn).alias("completed_recall"),
        ratio(tp, tp + fn + F.col("failed_risky") + F.col("partial_risky") + F.col("unmeasured_risky")).alias("end_to_end_recall"),
        ratio(F.col("completed"), F.col("cases") - F.col("unsupported")).alias("eligible_completion_rate"), "median_seconds",
    )


def observation_states(observations: DataFrame, coverage: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Execution state per observation set: partial on any shortfall, unmeasured without full evidence, else completed.

    ``observations``: keys, observation, incomplete (null = unknown), warnings (count), has_coverage; ``coverage``: keys,
    observation, state.
    """
    per_cov = coverage.groupBy(*keys, "observation").agg(
        F.bool_or(F.col("state").isin("partial", "limited", "not-run")).alias("short"),
        F.bool_or(~F.col("state").isin("checked", "not-applicable")).alias("unfinished"),
    )
    rows = observations.join(per_cov, [*keys, "observation"], "left")
    short = F.coalesce("incomplete", F.lit(False)) | (F.col("warnings") > 0) | F.coalesce("short", F.lit(False))
    unknown = F.col("incomplete").isNull() | ~F.col("has_coverage") | F.coalesce("unfinished", F.lit(False))
    per = rows.groupBy(*keys).agg(F.bool_or(short).alias("s"), F.bool_or(unknown).alias("u"))
    return per.select(*keys, F.when(F.col("s"), "partial").when(F.col("u"), "unmeasured").otherwise("completed").alias("state"))


def unit_scores(records: DataFrame) -> DataFrame:
    """Scores of affected/unaffected units with abstentions for unknown ones. ``records``: expected, state, matched."""
    expected, state, hit = F.col("expected"), F.col("state"), F.col("matched")
    unknown, done = expected == "unknown", state == "completed"
    affected = expected == "affected"
    judged = ~unknown & done
    per = records.agg(
        count(judged & hit & affected).alias("tp"), count(judged & hit & ~affected).alias("fp"), count(judged & ~hit & affected).alias("fn"),
        count(judged & ~hit & ~affected).alias("tn"), count(~unknown & ~done).alias("failed"), count(~unknown & ~done & affected).alias("failed_affected"),
        count(unknown).alias("unknown"), count(unknown & (state == "abstained") & ~hit).alias("correct_abstentions"),
        count(~unknown & (state == "unstable")).alias("unstable"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return per.withColumn("precision", ratio(tp, tp + fp)).withColumn("completed_recall", ratio(tp, tp + fn)).withColumn(
        "end_to_end_recall", ratio(tp, tp + fn + F.col("failed_affected"))
    )


def pair_totals(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals of vulnerable/fixed pairs. ``pairs``: keys, vulnerable, fixed (outcomes), line_level, discriminating, error."""
    scored = ~F.col("error")
    outcomes = ("tp", "fn", "fp", "tn")
    one_side = F.coalesce(F.col("vulnerable").isin(*outcomes), F.lit(False)) | F.coalesce(F.col("fixed").isin(*outcomes), F.lit(False))
    frame = pairs.groupBy(*keys) if keys else pairs.groupBy()
    return frame.agg(
        count(scored & (F.col("vulnerable") == "tp")).alias("tp"), count(scored & (F.col("vulnerable") == "fn")).alias("fn"),
        count(scored & (F.col("fixed") == "fp")).alias("fp"), count(scored & (F.col("fixed") == "tn")).alias("tn"),
        count(scored & F.col("line_level")).alias("line_level_tp"), count(scored & F.col("discriminating")).alias("discriminating_tp"),
        count(F.col("error")).alias("errors"),
        F.sum(F.when(scored, (F.col("vulnerable") == "unscored").cast("int") + (F.col("fixed") == "unscored").cast("int")).otherwise(0)).cast("bigint").alias("unscored_sides"),
        count(scored & one_side).alias("scored_pairs"),
    )


def strict_pairs(rows: DataFrame) -> DataFrame:
    """Tests that have both a failing and a passing label: strictly right only when every outcome is. ``rows``: test, label, outcome, in_scope."""
    judged = rows.where(F.col("in_scope") & F.col("label").isin("fail", "pass"))
    return judged.groupBy("test").agg(
        F.every(F.col("outcome").isin("tp", "tn")).alias("strict"), F.bool_or(F.col("label") == "fail").alias("f"), F.bool_or(F.col("label") == "pass").alias("p")
    ).where("f AND p").select("test", "strict")


def outcome_histogram(rows: DataFrame, column: str = "outcome") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def repetition_stability(trials: DataFrame, repetitions: int) -> DataFrame:
    """Per (tool, case): complete repetition indices and one signature make it stable; others are excluded.

    ``trials``: tool, case_id, repetition, signature, classification. Completeness is counted, not collected.
    """
    if repetitions < 1:
        raise ValueError("repetitions must be positive")
    inside = F.col("repetition").between(0, repetitions - 1)
    per = trials.groupBy("tool", "case_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(inside, F.col("repetition"))).alias("indices"),
        F.min("signature").alias("lo"), F.max("signature").alias("hi"), F.min_by("classification", "repetition").alias("classification"),
    )
    complete = (F.col("n") == repetitions) & (F.col("indices") == repetitions)
    stable = complete & (F.col("lo") == F.col("hi"))
    return per.select(
        "tool", "case_id", complete.alias("complete"), stable.alias("stable"), F.when(stable, F.col("classification")).otherwise("excluded").alias("classification")
    )


def stability_summary(per_case: DataFrame) -> DataFrame:
    return per_case.groupBy("tool").agg(
        *[count(F.col("classification") == c).alias(c.lower()) for c in ("TP", "TN", "FP", "FN")],
        count(F.col("classification") == "excluded").alias("excluded"), F.every("stable").alias("stable"), F.count(F.lit(1)).alias("cases"),
    )


def two_tool_comparison(records: DataFrame) -> DataFrame:
    """Precision and recall of each tool over its completed records. ``records``: tool, state, matched, risky."""
    done, hit, risky = F.col("state") == "completed", F.col("matched"), F.col("risky")
    per = records.groupBy("tool").agg(
        count(done & hit & risky).alias("tp"), count(done & hit & ~risky).alias("fp"), count(done & ~hit & risky).alias("fn"), count(done & ~hit & ~risky).alias("tn"),
        *[count(F.col("state") == s).alias(s) for s in ("partial", "failed", "unmeasured", "unsupported")],
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return per.withColumn("scored_cases", tp + fp + fn + F.col("tn")).withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))


def catalog_scores(truth: DataFrame, entries: DataFrame) -> DataFrame:
    """Catalogue resolution against truth. ``truth``: alias, shipped, shipped_versions ARRAY; ``entries``: alias, declared, version."""
    rows = truth.join(entries.select("alias", "declared", "version"), "alias", "left")
    found, shipped = F.col("declared").isNotNull(), F.col("shipped")
    declared = F.coalesce("declared", F.lit(False))
    agree = F.coalesce(F.array_contains("shipped_versions", F.col("version")), F.lit(False))
    per = rows.agg(
        count(declared & shipped).alias("tp"), count(declared & ~shipped).alias("fp"), count(found & ~declared & shipped).alias("abstained_shipped"),
        count(found & ~declared & ~shipped).alias("abstained_not_shipped"), count(~found).alias("missing_entry"),
        count(declared & shipped & agree).alias("versions_agree"), count(declared & shipped & ~agree).alias("versions_differ"),
    )
    tp = F.col("tp")
    return per.withColumn("declared_precision", ratio(tp, tp + F.col("fp"))).withColumn("shipped_coverage", ratio(tp, tp + F.col("abstained_shipped")))


def lockfile_scores(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Missing and unexpected resolved coordinates. Both: name, version."""
    left = expected.select("name", "version").distinct().withColumn("__e", F.lit(True))
    right = observed.select("name", "version").distinct().withColumn("__o", F.lit(True))
    both = left.join(right, ["name", "version"], "full_outer")
    return both.agg(
        count(F.col("__e").isNotNull()).alias("expected"), count(F.col("__o").isNotNull()).alias("observed"),
        count(F.col("__o").isNull()).alias("missing"), count(F.col("__e").isNull()).alias("unexpected"),
    )


def state_agreement(cases: DataFrame, observed: DataFrame, exact: bool = True) -> DataFrame:
    """Whether the observed states of each case are the expected ones (exactly, or a non-empty subset).

    ``cases``: case_id, expected ARRAY; ``observed``: case_id, state. States are a fixed vocabulary.
    """
    seen = observed.groupBy("case_id").agg(F.array_sort(F.collect_set("state")).alias("observed"))
    rows = cases.join(seen, "case_id", "left")
    states = F.coalesce("observed", F.array().cast("array<string>"))
    want = F.array_sort(F.array_distinct("expected"))
    correct = (states == want) if exact else (F.size(states) > 0) & (F.size(F.array_except(states, want)) == 0)
    return rows.select("case_id", F.array_join(states, ",").alias("observed"), correct.alias("correct"))


def inventory_labels(labels: DataFrame, deps: DataFrame) -> DataFrame:
    """Whether each labelled dependency (label_id, ecosystem, name, version, path) was extracted at that path."""
    hits = labels.join(deps.select("ecosystem", "name", "version", F.col("path").alias("__p")), ["ecosystem", "name", "version"]).where(
        same_or_suffix(F.col("__p"), F.col("path"))
    ).select("label_id").distinct().withColumn("__hit", F.lit(True))
    return labels.join(hits, "label_id", "left").select("label_id", F.coalesce("__hit", F.lit(False)).alias("extracted"))


def _with_ends(frame: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys with ``path`` and every part of it that begins behind a slash."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    return frame.where("path IS NOT NULL").select(*keys, F.explode(ends).alias("path")).distinct()


def configuration_labels(labels: DataFrame, configs: DataFrame, findings: DataFrame) -> DataFrame:
    """Per label (label_id, app_id, path, rule_id, expected): covered, matched and correct.

    A label meets an observed path that equals it or ends with it behind a slash: every observed path is listed with all
    its ends, so labels are looked up by whole path and files of one name never meet in pairs.
    """
    covered = labels.join(_with_ends(configs, "app_id").hint("merge"), ["app_id", "path"]).select("label_id").distinct().withColumn("covered", F.lit(True))
    matched = labels.join(_with_ends(findings, "app_id", "rule_id").hint("merge"), ["app_id", "rule_id", "path"]).select("label_id").distinct().withColumn("matched", F.lit(True))
    rows = labels.join(covered.hint("merge"), "label_id", "left").join(matched.hint("merge"), "label_id", "left")
    c, m = F.coalesce("covered", F.lit(False)), F.coalesce("matched", F.lit(False))
    return rows.select("label_id", c.alias("covered"), m.alias("matched"), (c & (m == F.col("expected"))).alias("correct"))


def labelled_scope(labels: DataFrame, files_table: DataFrame, coverage: DataFrame, rules: DataFrame) -> DataFrame:
    """Per side: every labelled file and every related rule fully checked.

    ``labels``: side_id, report_id, path; ``rules``: side_id, rule_id.
    """
    from sightline.operators.coverage import rule_states

    analyzed = labels.join(files_table.select("report_id", "path", "state"), ["report_id", "path"], "left")
    by_file = analyzed.groupBy("side_id", "report_id").agg(F.every(F.coalesce(F.col("state") == "checked", F.lit(False))).alias("files_checked"))
    wanted = labels.select("side_id", "report_id").distinct().join(rules, "side_id", "left")
    by_rule = wanted.join(rule_states(coverage).withColumnRenamed("state", "rule_state"), ["report_id", "rule_id"], "left").groupBy("side_id").agg(
        F.every(F.col("rule_id").isNull() | F.coalesce(F.col("rule_state") == "checked", F.lit(False))).alias("rules_checked")
    )
    return by_file.join(by_rule, "side_id", "left").select(
        "side_id", "files_checked", F.coalesce("rules_checked", F.lit(True)).alias("rules_checked"),
        (F.col("files_checked") & F.coalesce("rules_checked", F.lit(True))).alias("complete"),
    )


def lint_counts(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Lint rows per status."""
    return findings.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("rows"))


def lint_exit(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exit code per subject: 1 when anything failed or errored."""
    return findings.groupBy(*keys).agg(F.max(F.col("status").isin("fail", "error").cast("int")).alias("exit_code"))
