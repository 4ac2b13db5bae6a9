"""Reachability by iterated joins: module closures, non-shipping modules and bounded flow paths.

Every round joins only the rows found in the round before, drops what is already known, and writes the result to the
reliable checkpoint folder, so the plan stays short and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.session import cut_lineage

# Consumption states that do not ship the consumed module.
UNSHIPPED_EDGES = ("non-shipping-configuration", "platform-only")
MAX_CALL_DEPTH = 8
STEPS_A_CUT = 4  # steps of a walk between two cuts of the lineage


def reachable(edges: DataFrame, roots: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, root, module): everything each root reaches over ``edges`` (keys, src, dst), the root included.

    Rounds go on until one finds nothing new, which cycles do not delay.
    """
    keys = list(keys)
    steps = cut_lineage(edges.select(*keys, "src", "dst").distinct())
    frontier = cut_lineage(roots.select(*keys, F.col("module").alias("root"), "module").distinct())
    seen = frontier  # grows by one written part per round; earlier parts are not written again
    while True:
        # rows of a round are about as many as the roots and the last rounds are small: as broadcasts they would all pass the driver
        found = frontier.join(steps.withColumnRenamed("src", "module").hint("merge"), [*keys, "module"]).select(
            *keys, "root", F.col("dst").alias("module")
        ).distinct()
        frontier = cut_lineage(found.join(seen.hint("merge"), [*keys, "root", "module"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def shipping_roles(modules: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Modules with ``role``: library modules nobody live ships become non-shipping, to a fixed point.

    ``modules``: keys, module, role (null, application, build-tooling, non-shipping-module), library. ``edges``: keys,
    consumer, module, state.
    """
    keys = list(keys)
    nodes = cut_lineage(modules.select(*keys, "module", "role", "library"))
    links = cut_lineage(edges.select(*keys, "consumer", "module", "state").distinct())
    consumed = links.select(*keys, "module").distinct()
    # Only consumed libraries that are no application can drop out.
    candidates = nodes.where(F.col("library") & (F.coalesce("role", F.lit("")) != "application")).join(
        consumed, [*keys, "module"], "left_semi"
    )
    dead = cut_lineage(nodes.where(F.col("role").isin("build-tooling", "non-shipping-module")).select(*keys, "module"))
    shipping = links.where(~F.col("state").isin(*UNSHIPPED_EDGES))
    while True:  # every round but the last retires a module
        live_use = shipping.join(dead.withColumnRenamed("module", "consumer"), [*keys, "consumer"], "left_anti")
        fresh = (
            candidates.join(dead, [*keys, "module"], "left_anti")
            .join(live_use.select(*keys, "module").distinct(), [*keys, "module"], "left_anti").select(*keys, "module")
        )
        fresh = cut_lineage(fresh)
        if fresh.isEmpty():
            gone = dead.withColumn("__dead", F.lit(True))
            return nodes.join(gone, [*keys, "module"], "left").select(
                *keys, "module",
                F.when(F.col("role").isNull() & F.coalesce("__dead", F.lit(False)), "non-shipping-module").otherwise(F.col("role")).alias("role"),
            )
        dead = cut_lineage(dead.unionByName(fresh))


def flow_walk(
    edges: DataFrame, starts: DataFrame, sinks: DataFrame, keys: Sequence[str] = (), depth: int = MAX_CALL_DEPTH,
    stops: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(findings, cuts) of up to 63 flow families in one walk from all origins at once.

    ``edges``: keys, src, dst; ``starts``: keys, node, origin, mask; ``sinks``: keys, node, mask; ``stops``: keys, node,
    mask. Each bit of a mask is a family; a stop takes its bits from every flow that enters or starts at the node.
    Findings are keys, family (bit number), origin, sink, steps and the least of the shortest paths; cuts are keys,
    family, origin, node rows still expanding at the depth limit.

    The frontier holds (node, origin, path, mask) rows; a step is one join with the edges, written once with the bits
    that their ends let through, and one aggregate that keeps for every family the least path to a node. Some steps are
    one job. Nodes of a path
    are not entered again, so cycles end; a node reached anew on a longer path only costs its rows, and the shortest one
    is taken at the end, which spares a look at all rows seen so far in every round. A hub is no key of its own: rows
    are spread by node and origin after each join, and the join's hot nodes can be split.
    """
    keys = list(keys)
    end = [*keys, "node", "origin"]
    def bits(mask: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.lit(62)), lambda b: F.call_function("shiftright", mask, b).bitwiseAND(F.lit(1)) == 1)

    def let_through(rows: DataFrame, at: str) -> DataFrame:
        if stops is None:
            return rows
        stopped = stops.groupBy(*keys, F.col("node").alias(at)).agg(F.bit_or("mask").alias("__stop"))
        rows = rows.join(stopped, [*keys, at], "left")
        mask = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("__stop", F.lit(0).cast("bigint"))))
        return rows.withColumn("mask", mask).drop("__stop").where("mask <> 0")

    def least_paths(rows: DataFrame, families: list[int]) -> DataFrame:
        """Of the rows for one node and origin, the least path of every family, with the bits of equal paths united."""
        if len(families) == 1:
            return rows.groupBy(*end).agg(F.bit_or("mask").alias("mask"), F.min("path").alias("path"))
        one = F.lit(1).cast("bigint")
        held = [(f, F.col("mask").bitwiseAND(F.shiftleft(one, f)) != 0) for f in families]
        best = rows.groupBy(*end).agg(*[F.min(F.when(ok, F.col("path"))).alias(f"__{f}") for f, ok in held])
        each = F.array(*[F.struct(F.col(f"__{f}").alias("path"), F.shiftleft(one, f).alias("mask")) for f in families])
        each = F.filter(each, lambda e: e["path"].isNotNull())

        def united(path):
            return F.aggregate(F.filter(each, lambda e: e["path"] == path), F.lit(0).cast("bigint"), lambda m, e: m.bitwiseOR(e["mask"]))

        paths = F.array_distinct(F.transform(each, lambda e: e["path"]))
        return best.select(*end, F.explode(F.transform(paths, lambda p: F.struct(united(p).alias("mask"), p.alias("path")))).alias("r")).select(*end, "r.*")

    used = starts.agg(F.bit_or("mask")).first()[0] or 0
    families = [b for b in range(63) if used >> b & 1]
    steps = edges.select(*keys, "src", "dst").where("src <> dst").distinct().withColumn("mask", F.lit(used).cast("bigint"))
    steps = cut_lineage(let_through(steps, "dst").withColumnRenamed("mask", "__open"))
    first = let_through(starts.select(*end, "mask"), "node").groupBy(*end).agg(F.bit_or("mask").alias("mask"))
    frontier = cut_lineage(first.withColumn("path", F.array("node")).select(*end, "mask", "path"))
    levels = [frontier]
    out = steps.withColumnRenamed("src", "node")

    def advanced(rows: DataFrame) -> DataFrame:
        moved = rows.join(out, [*keys, "node"]).where(~F.array_contains("path", F.col("dst")))
        moved = moved.select(
            *keys, F.col("dst").alias("node"), "origin", F.col("mask").bitwiseAND(F.col("__open")).alias("mask"),
            F.concat("path", F.array("dst")).alias("path"),
        )
        return least_paths(moved.where("mask <> 0"), families).select(*end, "mask", "path")

    left = depth
    while left > 0:
        made, now = [], frontier
        for _ in range(min(STEPS_A_CUT, left)):
            now = advanced(now)
            made.append(now)
        left -= len(made)
        written = cut_lineage(reduce(DataFrame.unionByName, made))  # the shuffle of a step also feeds the next one
        levels.append(written)
        frontier = written.where(F.size("path") == depth - left + 1)
        if frontier.isEmpty():
            break
    seen = levels[0]
    for level in levels[1:]:
        seen = seen.unionByName(level)
    aimed = sinks.groupBy(*keys, "node").agg(F.bit_or("mask").alias("__aim"))
    hits = seen.join(aimed, [*keys, "node"]).withColumn("mask", F.col("mask").bitwiseAND(F.col("__aim"))).where("mask <> 0")
    rank = F.struct((F.size("path") - 1).alias("steps"), "path")
    findings = hits.select(*end, F.explode(bits(F.col("mask"))).alias("family"), rank.alias("r")).groupBy(*end, "family").agg(F.min("r").alias("r"))
    findings = findings.select(*keys, "family", "origin", F.col("node").alias("sink"), "r.steps", "r.path")
    ends = frontier.join(out, [*keys, "node"]).withColumn("mask", F.col("mask").bitwiseAND(F.col("__open"))).where("mask <> 0")
    known = seen.groupBy(*end).agg(F.bit_or("mask").alias("__seen")).withColumnRenamed("node", "dst")
    ends = ends.join(known, [*keys, "dst", "origin"], "left")
    fresh = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("__seen", F.lit(0).cast("bigint"))))
    cuts = ends.withColumn("mask", fresh).where("mask <> 0").groupBy(*end).agg(F.bit_or("mask").alias("mask"))
    return findings, cuts.select(*keys, F.explode(bits(F.col("mask"))).alias("family"), "origin", "node")


def flow_paths(
    edges: DataFrame, sources: DataFrame, sinks: DataFrame, keys: Sequence[str] = (), depth: int = MAX_CALL_DEPTH,
    guards: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(findings, cuts): origins that reach a sink within ``depth`` steps, with one shortest path each.

    ``edges``: keys, src, dst; ``sources``: keys, node, origin; ``sinks``: keys, node, rule_id; ``guards``: keys, node
    that stop a flow. Cuts are the (origin, node) rows still expanding at the depth limit.
    """
    keys = list(keys)
    one = F.lit(1).cast("bigint").alias("mask")
    stops = guards.select(*keys, "node", one) if guards is not None else None
    found, cuts = flow_walk(edges, sources.select(*keys, "node", "origin", one), sinks.select(*keys, "node", one), keys, depth, stops)
    named = sinks.select(*keys, F.col("node").alias("sink"), "rule_id").distinct()
    findings = found.join(named, [*keys, "sink"]).select(*keys, "rule_id", "origin", "sink", "steps", "path")
    return findings, cuts.select(*keys, "node", "origin")
