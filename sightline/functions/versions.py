"""Version, date and time columns: strict parsing, sortable keys and retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.binding import let

# The version grammar of PEP 440, appendix B, as one Java expression.
PEP440 = (
    r"(?i)^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)"
    r"(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d+)?)?"
    r"((?:-(\d+))|(?:[-_.]?(?:post|rev|r)[-_.]?(\d+)?))?"
    r"([-_.]?dev[-_.]?(\d+)?)?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)


def _digits(value: Column) -> Column:
    """A number behind its count of digits, so text order is numeric order at any length."""
    number = F.regexp_replace(F.when(value == "", "0").otherwise(value), r"^0+(?=\d)", "")
    return F.concat(F.lpad(F.length(number).cast("string"), 6, "0"), number)


def version_key(version: Column) -> Column:
    """A text whose byte order is PEP 440 order; null for a version outside the grammar."""
    names = ("epoch", "release", "pre", "pre_n", "post", "post_a", "post_b", "dev", "dev_n", "local")
    parts = F.struct(*[F.regexp_extract(version, PEP440, i + 1).alias(n) for i, n in enumerate(names)])
    # Plain dotted numbers, by far the most common form, need no grammar groups.
    plain = F.concat(_digits(F.lit("0")), F.lit("/"), _release(version), F.lit("9/0/9/0"))
    return F.when(version.rlike(r"^\d+(?:\.\d+)*$"), plain).when(version.rlike(PEP440), let(parts, _key))


def _release(release: Column) -> Column:
    """Numbers of a release without trailing zeros, closed by a sign below any digit or dot."""
    trimmed = F.regexp_replace(release, r"(?:\.0+)+$", "")
    return F.concat(F.array_join(F.transform(F.split(trimmed, r"\."), _digits), "."), F.lit("!"))


def _key(part: Column) -> Column:
    release_key = _release(part["release"])
    pre, post, dev, local = F.lower(part["pre"]), part["post"], part["dev"], F.lower(part["local"])
    stage = F.when(pre.isin("a", "alpha"), "1").when(pre.isin("b", "beta"), "2").otherwise("3")
    pre_key = (
        F.when(pre != "", F.concat(stage, _digits(part["pre_n"]))).when((post == "") & (dev != ""), "0").otherwise("9")
    )
    post_number = F.when(part["post_a"] != "", part["post_a"]).otherwise(part["post_b"])
    post_key = F.when(post == "", "0").otherwise(F.concat(F.lit("1"), _digits(post_number)))
    dev_key = F.when(dev == "", "9").otherwise(F.concat(F.lit("1"), _digits(part["dev_n"])))
    local_key = F.when(local == "", "0").otherwise(
        F.concat(F.lit("1"), F.array_join(F.transform(F.split(local, r"[-_.]"), _segment), "."), F.lit("!"))
    )
    slash = F.lit("/")
    return F.concat(
        _digits(part["epoch"]), slash, release_key, pre_key, slash, post_key, slash, dev_key, slash, local_key
    )


def _segment(segment: Column) -> Column:
    """Local segment: numbers sort after words."""
    return F.when(segment.rlike(r"^\d+$"), F.concat(F.lit("N"), _digits(segment))).otherwise(F.concat(F.lit("A"), segment))


def numeric_version(value: Column) -> Column:
    """Two to four dotted numbers as a four-part int array; null otherwise."""
    ok = value.rlike(r"^(?:0|[1-9][0-9]{0,3})(?:\.(?:0|[1-9][0-9]{0,3})){1,3}$")
    parts = F.transform(F.split(value, r"\."), lambda x: x.try_cast("int"))
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit(0), 3)), 1, 4)
    return F.when(ok, padded)


def patch_date(value: Column) -> Column:
    """A 20YY-MM-DD day; null for any other text, never an error."""
    return F.when(value.rlike(r"^20\d\d-\d\d-\d\d$"), value.try_cast("date"))


_ISO = r"^\d{4}-\d\d-\d\d(?:[T ]\d\d(?::\d\d(?::\d\d(?:\.\d{1,6})?)?)?)?"


def zoned_timestamp(value: Column) -> Column:
    """An ISO time that names its offset; null without one."""
    return F.when(value.rlike(_ISO + r"(?:Z|[+-]\d\d:?\d\d)$"), value.try_cast("timestamp"))


def created_timestamp(value: Column) -> Column:
    """An ISO time; one without an offset is read as UTC (the session zone)."""
    return F.when(value.rlike(_ISO + r"(?:Z|[+-]\d\d:?\d\d)?$"), value.try_cast("timestamp"))


def retry_delay(attempts: Column, retry_after: Column) -> Column:
    """Seconds until the next attempt: a minute doubling per attempt, at least what the server asked, at most a day."""
    backoff = F.lit(60) * F.pow(F.lit(2), F.least(attempts - 1, F.lit(11)))
    return F.least(F.lit(86_400), F.greatest(backoff, F.coalesce(retry_after, F.lit(0)))).cast("bigint")


def months_between_days(old: Column, new: Column) -> Column:
    """Calendar months between two dates, ignoring the day of month."""
    return (F.year(new) - F.year(old)) * 12 + (F.month(new) - F.month(old))
