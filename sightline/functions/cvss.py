"""CVSS base scores of version 2 and 3 vectors as column arithmetic (weights from the FIRST specifications)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.binding import let

# Metric weights.
V3 = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0},
    "I": {"H": 0.56, "L": 0.22, "N": 0.0},
    "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}
V3_PRIVILEGES = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}
V2 = {
    "AV": {"L": 0.395, "A": 0.646, "N": 1.0},
    "AC": {"H": 0.35, "M": 0.61, "L": 0.71},
    "Au": {"M": 0.45, "S": 0.56, "N": 0.704},
    "C": {"N": 0.0, "P": 0.275, "C": 0.66},
    "I": {"N": 0.0, "P": 0.275, "C": 0.66},
    "A": {"N": 0.0, "P": 0.275, "C": 0.66},
}
DECLARED_SCORE = {"critical": 10, "high": 8, "medium": 5, "low": 2, "info": 0}
V3_VALUES = {"AV": "NALP", "AC": "LH", "PR": "NLH", "UI": "NR", "S": "UC", "C": "HLN", "I": "HLN", "A": "HLN"}
V2_VALUES = {name: "".join(table) for name, table in V2.items()}
V3_HEAD = r"^CVSS:3\.[01]/"


def _named(name: str):
    return lambda part: part.startswith(f"{name}:")


def _well_formed(vector: Column, values: dict[str, str]) -> Column:
    """Metrics in any order: every part is a metric, and each base metric occurs once, with one of its values."""
    parts = F.split(vector, "/")
    ok = F.forall(parts, lambda p: p.rlike(r"^[A-Z][A-Za-z]{0,2}:[A-Z]{1,3}$"))
    for name, letters in values.items():
        mine = F.filter(parts, _named(name))
        ok = ok & (F.size(mine) == 1) & F.get(mine, F.lit(0)).rlike(f"^{name}:[{letters}]$")
    return ok


def _metric(vector: Column, name: str) -> Column:
    return F.regexp_extract(vector, f"(?:^|/){name}:([A-Z])", 1)


def _weight(letter: Column, table: dict[str, float]) -> Column:
    """Weight of a one-letter metric value."""
    return F.get(F.array(*[F.lit(w) for w in table.values()]), F.position(letter, F.lit("".join(table))) - 1)


def _letters(vector: Column, names: tuple[str, ...]) -> Column:
    return F.struct(*[_metric(vector, n).alias(n) for n in names])


def v3_base(vector: Column) -> Column:
    """Base score of a version 3.0/3.1 vector; null for anything else."""

    def scored(m: Column) -> Column:
        changed = m["S"] == "C"
        pr = F.when(changed, _weight(m["PR"], V3_PRIVILEGES["C"])).otherwise(_weight(m["PR"], V3_PRIVILEGES["U"]))
        iss = 1 - (1 - _weight(m["C"], V3["C"])) * (1 - _weight(m["I"], V3["I"])) * (1 - _weight(m["A"], V3["A"]))
        exploit = 8.22 * _weight(m["AV"], V3["AV"]) * _weight(m["AC"], V3["AC"]) * pr * _weight(m["UI"], V3["UI"])
        parts = let(
            iss,
            lambda x: F.struct(
                F.when(changed, 7.52 * (x - 0.029) - 3.25 * F.pow(x - 0.02, 15)).otherwise(6.42 * x).alias("impact"),
                exploit.alias("exploit"), changed.alias("changed"),
            ),
        )
        return let(parts, total)

    def total(p: Column) -> Column:
        both = p["impact"] + p["exploit"]
        raw = F.least(F.when(p["changed"], 1.08 * both).otherwise(both), F.lit(10.0))
        return F.when(p["impact"] <= 0, F.lit(0.0)).otherwise(let(F.round(raw * 100000).cast("bigint"), rounded_up))

    def rounded_up(scaled: Column) -> Column:
        # Up to one decimal on scaled integers, as the specification defines it.
        return F.when(scaled % 10000 == 0, scaled / 100000).otherwise((F.floor(scaled / 10000) + 1) / 10)

    names = ("AV", "AC", "PR", "UI", "S", "C", "I", "A")
    return F.when(vector.rlike(V3_HEAD) & _well_formed(F.regexp_replace(vector, V3_HEAD, ""), V3_VALUES), let(_letters(vector, names), scored))


def v2_base(vector: Column) -> Column:
    """Base score of a version 2 vector; null for anything else."""

    def scored(m: Column) -> Column:
        weight = {n: _weight(m[n], t) for n, t in V2.items()}
        impact = 10.41 * (1 - (1 - weight["C"]) * (1 - weight["I"]) * (1 - weight["A"]))
        exploit = 20 * weight["AV"] * weight["AC"] * weight["Au"]
        return let(
            F.struct(impact.alias("i"), exploit.alias("e")),
            lambda p: F.round(
                (0.6 * p["i"] + 0.4 * p["e"] - 1.5) * F.when(p["i"] == 0, F.lit(0.0)).otherwise(F.lit(1.176)), 1
            ),
        )

    return F.when(_well_formed(vector, V2_VALUES), let(_letters(vector, tuple(V2)), scored))


def score_label(score: Column) -> Column:
    return (
        F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low")
        .otherwise("info")
    )


def advisory_severity(metrics: Column, declared: Column) -> Column:
    """Struct (severity, severity_basis): the greatest of computed and declared ratings.

    ``metrics``: ``array<struct<type, score>>``. Vectors that cannot be scored give no rating.
    """

    def rated(metric: Column) -> Column:
        score = F.when(metric["type"] == "CVSS_V3", v3_base(metric["score"])).when(
            metric["type"] == "CVSS_V2", v2_base(metric["score"])
        )
        return F.when(
            score.isNotNull(),
            F.struct(score.alias("score"), score_label(score).alias("severity"), metric["type"].alias("severity_basis")),
        )

    name = F.lower(F.coalesce(declared, F.lit("")))
    name = F.when(name == "moderate", "medium").otherwise(name)
    points = F.lit(None).cast("double")
    for key, value in DECLARED_SCORE.items():
        points = F.when(name == key, F.lit(float(value))).otherwise(points)
    own = F.when(
        points.isNotNull(),
        F.struct(points.alias("score"), name.alias("severity"), F.lit("database_specific.severity").alias("severity_basis")),
    )
    ratings = F.array_compact(F.concat(F.transform(F.coalesce(metrics, F.array().cast("array<struct<type:string,score:string>>")), rated), F.array(own)))
    best = F.array_max(ratings)
    return F.struct(
        best["severity"].alias("severity"), F.coalesce(best["severity_basis"], F.lit("unknown")).alias("severity_basis")
    )
