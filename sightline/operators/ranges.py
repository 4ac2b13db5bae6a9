"""Counting joins: how many rows lie below a bound or near a place, without forming the pairs.

Points are summed per key and value, bounds are reduced to the distinct ones, and one running sum over both gives every
bound its count. Rows between are linear in points and bounds, however many of them share a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def counts_below(points: DataFrame, bounds: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str]) -> DataFrame:
    """For each distinct bound the sums of ``measures`` over the points of its key below it (or at it, where inclusive).

    ``points``: keys, value, measures; ``bounds``: keys, value, inclusive. Rows with a null value take no part; keys may be
    null. A window holds the distinct values of one key, such as the lines of a file or the days of a calendar.
    """
    keys = list(keys)
    summed = points.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[F.sum(m).alias(m) for m in measures])
    zero = [F.lit(0).cast("bigint").alias(m) for m in measures]
    sides = bounds.where(F.col(value).isNotNull()).select(*keys, value, F.when(F.col("inclusive"), 2).otherwise(0).alias("__side")).distinct()
    rows = summed.select(*keys, value, F.lit(1).alias("__side"), *[F.col(m).cast("bigint").alias(m) for m in measures]).unionByName(
        sides.select(*keys, value, "__side", *zero)
    )
    upto = W.partitionBy(*keys).orderBy(value, "__side").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select(*keys, value, "__side", *[F.sum(m).over(upto).alias(m) for m in measures])
    return rows.where("__side <> 1").select(*keys, value, (F.col("__side") == 2).alias("inclusive"), *measures)


def path_suffixes(path: Column) -> Column:
    """A path and all its ends at a directory boundary, the whole path first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def nearby_counts(queries: DataFrame, points: DataFrame, keys: Sequence[str], tags: Sequence[str], window: int) -> DataFrame:
    """For every row of ``queries`` how many points of each tag lie in its file, by line.

    ``queries``: query, keys, path, line; ``points``: keys, path, line, tag. Paths agree where one is the other or ends with
    it at a directory boundary. Result: query, path, line and arrays over ``tags``: ``near`` (lines at most ``window``
    away), ``lined`` and ``bare`` (points with and without a line). A query without a path looks at all points of its
    keys, in ``lined`` and ``bare`` alone; a null line has no ``near``. Points meet queries on every end of their path at
    which the other side has a path as deep with their base name, so the cost is linear in rows and path depth.
    """
    keys = list(keys)
    place = [*keys, "__kind", "__key"]
    tag_sums = [F.count_if(F.col("tag") == tag).alias(f"__t{k}") for k, tag in enumerate(tags)]
    names = [f"__t{k}" for k in range(len(tags))]
    zeros = F.array(*[F.lit(0).cast("bigint")] * len(tags))

    base = F.element_at(F.split("path", "/"), -1)
    bit = lambda path: F.expr(f"shiftleft(1L, least(size(split({path}, '/')), 62))")  # noqa: E731  (deeper paths share a bit)

    def depths(rows: DataFrame) -> DataFrame:
        return rows.where("path IS NOT NULL").groupBy(*keys, base.alias("__base")).agg(F.bit_or(bit("path")).alias("__depths"))

    def ends(rows: DataFrame, depth: str) -> DataFrame:
        """One row for each end of a path whose depth is in the mask ``depth``; ``__at`` is 0 for the whole path."""
        out = rows.select("*", F.posexplode(path_suffixes(F.col("path"))).alias("__at", "__key"))
        return out.where(F.col(depth).bitwiseAND(bit("__key")) != 0)

    grouped = points.groupBy(*keys, "path", "line").agg(*tag_sums)
    # a point answers at every end of its path for queries that name that end, and as a whole for longer query paths
    met = grouped.where("path IS NOT NULL").withColumn("__base", base).join(depths(queries), [*keys, "__base"]).select(*grouped.columns, "__depths")
    longer = F.expr("__depths >= shiftleft(1L, least(size(split(path, '/')) + 1, 62))")
    held = ends(met, "__depths").drop("__at", "__depths").withColumn("__kind", F.lit("end")).unionByName(
        met.where(longer).drop("__depths").withColumn("__key", F.col("path")).withColumn("__kind", F.lit("whole"))
    )
    anywhere = grouped.withColumn("__key", F.lit("")).withColumn("__kind", F.lit("all"))
    named = queries.where("path IS NOT NULL").withColumn("__base", base)
    shorter = ends(named.join(depths(points), [*keys, "__base"]), "__depths").where("__at > 0")
    asked = queries.withColumn("__key", F.coalesce("path", F.lit(""))).withColumn("__kind", F.when(F.col("path").isNull(), "all").otherwise("end")).unionByName(
        shorter.select(*queries.columns, "__key", F.lit("whole").alias("__kind"))
    )
    totals = held.unionByName(anywhere).groupBy(*place).agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("line").isNotNull(), F.col(n))), F.lit(0)) for n in names]).alias("__lined"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("line").isNull(), F.col(n))), F.lit(0)) for n in names]).alias("__bare"),
    )
    lines = asked.where("path IS NOT NULL AND line IS NOT NULL").select(*place, F.col("line").alias("__line")).distinct()
    bounds = lines.select(*place, F.explode(F.array(
        F.struct((F.col("__line") - window).alias("line"), F.lit(False).alias("inclusive")),
        F.struct((F.col("__line") + window).alias("line"), F.lit(True).alias("inclusive")),
    )).alias("b")).select(*place, "b.*")
    below = counts_below(held, bounds, place, "line", names)
    sign = F.when(F.col("inclusive"), 1).otherwise(-1)
    middle = F.col("line") - F.when(F.col("inclusive"), window).otherwise(-window)
    near = below.groupBy(*place, middle.alias("line")).agg(F.array(*[F.sum(F.col(n) * sign) for n in names]).alias("__near"))
    found = asked.join(totals, place, "left").join(near, [*place, "line"], "left")
    columns = {"near": "__near", "lined": "__lined", "bare": "__bare"}
    return found.groupBy("query", "path", "line").agg(*[
        F.array(*[F.coalesce(F.sum(F.get(F.coalesce(c, zeros), F.lit(k))), F.lit(0)) for k in range(len(tags))]).alias(name)
        for name, c in columns.items()
    ])
