"""Budgets, paging and queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sightline.functions.paths import base_name, path_suffix, source_module
from sightline.scale import running_total, top_k
from sightline.session import cut_lineage

# Source kinds by name, for the staging order.
NATIVE = (".kt", ".java", ".swift", ".m", ".mm")
CODE = (*NATIVE, ".h", ".dart", ".js", ".jsx", ".jsbundle", ".bundle", ".ts", ".tsx")
CONFIG = (".gradle", ".kts", ".toml", ".lock", ".lockfile", ".resolved", ".pbxproj", ".plist", ".xcprivacy")
CONFIG_NAMES = (
    "AndroidManifest.xml",
    "Podfile.lock",
    "Package.resolved",
    "package.json",
    "package-lock.json",
    "pubspec.yaml",
    "google-services.json",
    "sbom.json",
)
LOCK_NAMES = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "pubspec.lock")
LOCK_SUFFIXES = (".lock", ".lockfile", ".resolved")
VENDORED = (".build", ".dart_tool", "assets", "carthage", "external", "third_party", "thirdparty", "vendor")
TIERS = ("code_and_config", "other_text", "localized_values", "tests")
TEST_SOURCES = (
    r"(?:^|/)src/(?:test(?:[A-Z0-9]\w*)?|androidTest\w*|[a-z]\w*Test(?:[A-Z]\w*)?)/"
    r"|^(?:test(?:[A-Z0-9]\w*)?|androidTest\w*)/"
    r"|(?:^|/)(?:Tests|UITests|[A-Z][A-Za-z0-9_-]*UITests|(?:[A-Z][a-z0-9]+){2,}Tests"
    r"|[A-Z][a-z0-9]+(?:[-_][A-Z][a-z0-9]+)+Tests|__tests__)/"
    r"|\.(?:test|spec)\.[jt]s$|_test\.dart$|(?:^|/)integration_test/"
)

def staging_rank(path: Column) -> Column:
    """Struct (tier, rank) of a path: configuration, own code, headers, locks, vendored code; then text, locales, tests."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    vendored = F.exists(
        dirs, lambda d: F.lower(d).isin(*VENDORED) | F.lower(d).endswith(".framework") | F.lower(d).endswith(".xcframework")
    )
    suffix, name = path_suffix(base_name(path)), base_name(path)
    lock = suffix.isin(*LOCK_SUFFIXES) | name.isin(*LOCK_NAMES)
    config = (
        suffix.isin(*CONFIG) | name.isin(*CONFIG_NAMES) | name.endswith(".cdx.json") | path.rlike(r"(?:^|/)res/xml[^/]*/")
    )
    pair = lambda tier, rank: F.struct(F.lit(tier).alias("tier"), rank.cast("int").alias("rank"))
    own = lambda rank: F.when(vendored, F.lit(5)).otherwise(rank)
    code_rank = F.when(suffix == ".h", 3).when(suffix.isin(*NATIVE), 1).otherwise(2)
    return (
        F.when(path.rlike(TEST_SOURCES), pair(3, F.lit(0)))
        .when(path.rlike(r"(?:^|/)res/values-[^/]+/"), pair(2, F.lit(0)))
        .when(lock, pair(0, own(F.lit(4))))
        .when(suffix.isin(*CODE), pair(0, own(code_rank)))
        .when(config, pair(0, own(F.lit(0))))
        .otherwise(pair(1, F.lit(0)))
    )


def round_robin(files: DataFrame, keys: Sequence[str] = ("app_id",)) -> DataFrame:
    """Adds tier, rank, module and ``turn``: files in turn across modules within each priority.

    The turn inside a module comes from slice-wise numbering, so one huge module is not sorted by one task. Sorting
    by (tier, rank, turn, module) gives the order.
    """
    from sightline.scale import numbered

    ranked = files.withColumn("__r", staging_rank(F.col("path"))).withColumn("module", source_module(F.col("path")))
    ranked = ranked.withColumn("tier", F.col("__r.tier")).withColumn("rank", F.col("__r.rank")).drop("__r")
    return numbered(ranked, [*keys, "tier", "rank", "module"], ["path"], "turn")


def admit(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, budget: int, count_limit: int | None = None
) -> DataFrame:
    """Adds ``admitted``: in order, every row that still fits the byte (and row) budget; others are passed over.

    A row is passed over when it exceeds what is left; later, smaller rows can still fit. A round looks at the rows of at
    most half the room: all of them fit until half the room is used, and running totals tell which larger row, of which
    at most one can be admitted meanwhile, fits first. So each round at least halves the room of a key, whatever the sizes,
    and no key's rows meet in one task. Null order values come first, as Spark sorts them.
    """
    if not keys:
        return admit(rows.withColumn("__all", F.lit(0)), ["__all"], order, size, budget, count_limit).drop("__all")
    keys, order = list(keys), list(order)
    columns = rows.columns
    slots = F.lit(count_limit if count_limit is not None else 2**62).cast("bigint")
    pending = rows.withColumn("__size", F.col(size).cast("bigint")).withColumn("__room", F.lit(budget).cast("bigint")).withColumn("__slots", slots)
    decided: list[DataFrame] = []
    while True:
        pending = cut_lineage(pending)
        open_ = F.coalesce((F.col("__size") <= F.col("__room")) & (F.col("__slots") > 0), F.lit(False))
        decided.append(pending.where(~open_).select(*columns, F.lit(False).alias("admitted")))
        pending = pending.where(open_)
        if pending.isEmpty():
            break
        small = F.col("__size") * 2 <= F.col("__room")
        sums = running_total(
            pending, keys, order,
            {"__place": F.lit(1).cast("bigint"), "__sum": F.when(small, F.col("__size")).otherwise(0), "__n": F.when(small, F.lit(1)).otherwise(0).cast("bigint")},
        )
        fits = ~small & (F.col("__sum") + F.col("__size") <= F.col("__room")) & (F.col("__n") < F.col("__slots"))
        halved = small & ((F.col("__sum") * 2 > F.col("__room")) | (F.col("__n") >= F.col("__slots")))
        sums = cut_lineage(sums.withColumn("__small", small).withColumn("__stop", fits | halved))
        first = F.min_by(
            F.struct(F.col("__place").alias("at"), (F.col("__sum") + F.when(F.col("__small"), 0).otherwise(F.col("__size"))).alias("used"),
                     (F.col("__n") + F.when(F.col("__small"), 0).otherwise(1)).alias("taken")),
            F.col("__place"),
        )
        stops = sums.where("__stop").groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(first.alias("__first"))
        same = F.lit(True)
        for key in keys:
            same = same & F.col(key).eqNullSafe(F.col(f"__k_{key}"))
        joined = sums.join(stops, same, "left")
        at = F.col("__first.at")
        reached = at.isNull() | (F.col("__place") <= at)
        decided.append(joined.where(reached).select(*columns, (F.col("__small") | F.coalesce(F.col("__place") == at, F.lit(False))).alias("admitted")))
        pending = joined.where(~reached).select(
            *columns, "__size", (F.col("__room") - F.col("__first.used")).alias("__room"), (F.col("__slots") - F.col("__first.taken")).alias("__slots")
        )
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out


def omissions(staged: DataFrame, keys: Sequence[str] = ("app_id",)) -> DataFrame:
    """Files and bytes left out per kind and module."""
    kind = F.get(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    return staged.where(~F.col("admitted")).groupBy(*keys, kind.alias("kind"), "module").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")
    )


def two_lane_queue(queue: DataFrame, limit: int, as_of) -> DataFrame:
    """Due jobs: half the limit (rounded up) for priority work, the rest for bulk work, unused places filled in order.

    ``queue``: id, revision, priority, state, next_attempt (null = now), queued_at. Only top-n results are combined, so
    at most ``limit`` rows ever meet in one place.
    """
    due = queue.where(
        (F.col("state") == "pending") & (F.col("next_attempt").isNull() | (F.col("next_attempt") <= F.lit(as_of).cast("timestamp")))
    )
    order = ["queued_at", "id", "revision"]
    if limit < 1:
        return due.limit(0).withColumn("lane", F.lit(""))
    if limit == 1:
        return due.orderBy(*order).limit(1).withColumn("lane", F.lit("fill"))
    first = due.where("priority <= 0").orderBy(*order).limit((limit + 1) // 2).withColumn("lane", F.lit("priority"))
    second = due.where("priority > 0").orderBy(*order).limit(limit // 2).withColumn("lane", F.lit("bulk"))
    chosen = cut_lineage(first.unionByName(second))
    # Among the first `limit` due rows at most |chosen| are taken already, so these suffice to fill up.
    fill = due.orderBy(*order).limit(limit).join(chosen.select("id", "revision"), ["id", "revision"], "left_anti")
    both = chosen.withColumn("__o", F.lit(0)).unionByName(fill.withColumn("lane", F.lit("fill")).withColumn("__o", F.lit(1)))
    return both.orderBy("__o", *order).limit(limit).drop("__o")


def page(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, max_bytes: int, limit: int = 20, cursor: int = 0
) -> DataFrame:
    """One byte-budgeted page per key: positions shown or oversized, and the next cursor.

    Positions count from 0 in ``order``. Rows larger than the budget at the head of a page are reported as oversized and
    passed; after the first row shown the page ends at the first one that does not fit. A page never looks at more
    than ``limit`` rows per key.
    """
    if limit < 1 or cursor < 0:
        raise ValueError("limit must be at least 1 and cursor not negative")
    by = [F.col(o) for o in order]
    ranked = top_k(rows, keys, by, cursor + limit, "__rank").where(F.col("__rank") > cursor)
    window = W.partitionBy(*keys).orderBy("__rank")  # at most `limit` rows per key
    upto = window.rowsBetween(W.unboundedPreceding, 0)
    big = F.col(size) > max_bytes
    marked = ranked.withColumn("__head", F.min(big).over(upto))  # still only oversized rows so far
    marked = marked.withColumn("__sum", F.sum(F.when(F.col("__head"), F.lit(0)).otherwise(F.col(size))).over(upto))
    shown = ~F.col("__head") & (F.col("__sum") <= max_bytes)
    state = F.when(F.col("__head"), "oversized").when(shown, "shown").otherwise("later")
    return marked.withColumn("position", F.col("__rank") - 1).withColumn("page_state", state).drop("__rank", "__head", "__sum")


def next_cursors(paged: DataFrame, totals: DataFrame, keys: Sequence[str], cursor: int = 0) -> DataFrame:
    """Next cursor per key (-1 when the section is exhausted) with shown and oversized counts."""
    done = paged.where("page_state <> 'later'").groupBy(*keys).agg(
        (F.max("position") + 1).alias("__end"), F.sum((F.col("page_state") == "shown").cast("bigint")).alias("shown"),
        F.sum((F.col("page_state") == "oversized").cast("bigint")).alias("oversized"),
    )
    rows = totals.join(done, list(keys), "left")
    end = F.coalesce("__end", F.lit(cursor))
    return rows.select(
        *keys, "total", F.when(end < F.col("total"), end).otherwise(F.lit(-1)).alias("next_cursor"),
        F.coalesce("shown", F.lit(0)).alias("shown"), F.coalesce("oversized", F.lit(0)).alias("oversized"),
    )


def interleave(rows: DataFrame, keys: Sequence[str], list_column: str, order: Sequence[str], size: str, budget: int) -> DataFrame:
    """Adds ``admitted``: one row of each list in turn while it fits the shared budget."""
    from sightline.scale import numbered

    turns = numbered(rows, [*keys, list_column], order, "turn")
    return admit(turns, keys, ["turn", list_column], size, budget)


def omitted_counts(interleaved: DataFrame, keys: Sequence[str], list_column: str) -> DataFrame:
    """Rows shown and left out per list."""
    return interleaved.groupBy(*keys, list_column).agg(
        F.sum(F.col("admitted").cast("bigint")).alias("shown"), F.sum((~F.col("admitted")).cast("bigint")).alias("omitted")
    )
