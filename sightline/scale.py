"""Skew-safe building blocks shared by the operators.

None of these holds a whole key group in one task: running values are computed per range slice
and completed with one small row per slice; latest/first rows use mergeable aggregates; top-k uses
a rank filter that Spark prunes before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sightline.session import cut_lineage

SLICE = "__slice"
MAX_CONFIG_ROWS = 10_000


def bounded_rows(df: DataFrame, what: str, limit: int = MAX_CONFIG_ROWS) -> list[Row]:
    """Rows of a configuration table; refuses a table that is not configuration-sized."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} holds more than {limit} rows; it must be a small configuration table")
    return rows


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row with the greatest order per key, through a mergeable ``max_by``."""
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    value = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(value, rank).alias("__row")).select("__row.*")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; the rank filter is applied before and after the shuffle. Without ``k`` all rows are
    ranked, slice by slice; the order must then be unique per key."""
    if k is None:
        names = [f"__by_{n}" for n in range(len(order))]
        return numbered(df.withColumns(dict(zip(names, order))), keys, names, rank).drop(*names).withColumn(rank, F.col(rank).cast("int"))
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def sliced(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Rows cut into ordered range slices; a hot key spans as many slices as its rows need.

    The slice number is written out once, so every later use sees the same cut even after a lost executor.
    """
    columns = [F.col(name) for name in order]
    ranged = df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)
    return cut_lineage(ranged.withColumn(SLICE, F.spark_partition_id()))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    parts: int | None = None,
) -> DataFrame:
    """Inclusive running sums per key (or over everything, without keys).

    ``order`` must be unique per key. One partial sum per (key, slice) carries totals across slices.
    """
    work = df
    for name, value in values.items():
        work = work.withColumn(f"__v_{name}", value)
    work = sliced(work, [*keys, *order], parts)
    sums = work.groupBy(*keys, SLICE).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values])
    before = W.partitionBy(*[F.col(k) for k in keys]).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col(SLICE).alias("__k_slice"),
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in values],
    )
    match = F.col(SLICE) == F.col("__k_slice")
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"__k_{key}"))
    inside = W.partitionBy(*[F.col(k) for k in keys], F.col(SLICE)).orderBy(*[F.col(o) for o in order])
    inside = inside.rowsBetween(W.unboundedPreceding, 0)
    joined = work.join(carried, match)
    return joined.select(
        *df.columns,
        *[(F.sum(f"__v_{n}").over(inside) + F.col(f"__c_{n}")).alias(n) for n in values],
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """Dense row numbers per key (1-based) without sorting a key in one task."""
    return running_total(df, keys, order, {name: F.lit(1).cast("bigint")})


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str, parts: int | None = None
) -> DataFrame:
    """The previous row's value per key (``lag``), carried across slices by one row per (key, slice)."""
    work = sliced(df, [*keys, *order], parts)
    rank = F.struct(*order)
    last = work.groupBy(*keys, SLICE).agg(F.max_by(F.struct(F.col(column).alias("v")), rank).alias("__l"))
    earlier = W.partitionBy(*[F.col(k) for k in keys]).orderBy(SLICE)
    carried = last.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col(SLICE).alias("__k_slice"),
        F.lag("__l").over(earlier).alias("__carry"),
    )
    match = F.col(SLICE) == F.col("__k_slice")
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"__k_{key}"))
    inside = W.partitionBy(*[F.col(k) for k in keys], F.col(SLICE)).orderBy(*order)
    here = F.lag(F.struct(F.col(column).alias("v"))).over(inside)
    return work.join(carried, match).select(*df.columns, F.coalesce(here, F.col("__carry"))["v"].alias(name))


def with_next_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str, parts: int | None = None
) -> DataFrame:
    """The nearest later non-null value per key (an as-of lookup), carried back by one row per (key, slice)."""
    work = sliced(df, [*keys, *order], parts)
    held = F.when(F.col(column).isNotNull(), F.struct(*order))
    firsts = work.groupBy(*keys, SLICE).agg(F.min_by(F.col(column), held).alias("__f"))
    later = W.partitionBy(*[F.col(k) for k in keys]).orderBy(F.col(SLICE).desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = firsts.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col(SLICE).alias("__k_slice"),
        F.last("__f", ignorenulls=True).over(later).alias("__carry"),
    )
    match = F.col(SLICE) == F.col("__k_slice")
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"__k_{key}"))
    inside = W.partitionBy(*[F.col(k) for k in keys], F.col(SLICE)).orderBy(*[F.col(o).desc() for o in order])
    inside = inside.rowsBetween(W.unboundedPreceding, -1)
    here = F.last(column, ignorenulls=True).over(inside)
    return work.join(carried, match).select(*df.columns, F.coalesce(here, F.col("__carry")).alias(name))


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: str, salts: int = 16) -> DataFrame:
    """Equi-join on few, hot keys: ``big`` rows are spread over ``salts`` by the hash of a column.

    ``small`` is repeated once per salt, so every task gets a share of each key's pairs.
    """
    left = big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*on, "__salt"]).drop("__salt")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per key from distinct value counts, so no key's values meet in one task."""
    if not keys:
        return exact_median(df.withColumn("__all", F.lit(0)), ["__all"], value, name).drop("__all")
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    rows = running_total(counts, keys, [value], {"__upto": F.col("__n")})
    rows = rows.join(totals, keys)
    low, high = F.floor((F.col("__total") + 1) / 2), F.floor(F.col("__total") / 2) + 1
    middle = rows.groupBy(*keys).agg(
        F.min(F.when(F.col("__upto") >= low, F.col(value))).alias("__lo"),
        F.min(F.when(F.col("__upto") >= high, F.col(value))).alias("__hi"),
    )
    return middle.select(*keys, ((F.col("__lo") + F.col("__hi")) / 2).alias(name))
