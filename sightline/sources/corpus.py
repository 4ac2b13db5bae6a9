"""Text corpora, rule catalogues, taxonomies and captured files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.paths import path_suffix
from sightline.scale import bounded_rows

# Suffixes admitted as text, and directories that are never part of a corpus.
TEXT_SUFFIXES = (
    ".kt", ".java", ".swift", ".m", ".mm", ".h", ".dart", ".js", ".jsx", ".ts", ".tsx", ".xml", ".json", ".gradle", ".kts",
    ".toml", ".lock", ".lockfile", ".resolved", ".plist", ".pbxproj", ".xcprivacy", ".properties", ".yaml", ".yml",
)
SKIP_DIRECTORIES = (".git", ".gradle", ".idea", ".svn", "node_modules", "Pods", "build", "DerivedData", ".venv", "__pycache__")


def read_corpus(spark: SparkSession, root: str, **options) -> DataFrame:
    """Every admitted text file below ``root`` as one row; the first directory names the application."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return corpus_rows(files.select("path", "content"), root, **options)


def corpus_rows(
    files: DataFrame, root: str, suffixes: Sequence[str] = TEXT_SUFFIXES, skip: Sequence[str] = SKIP_DIRECTORIES
) -> DataFrame:
    """(app_id, path, suffix, text) from (path, content) rows; name filters run before any content is decoded."""
    prefix = root.rstrip("/") + "/"
    relative = F.substr(F.col("path"), F.instr(F.col("path"), prefix) + len(prefix))
    named = files.where(F.contains("path", F.lit(prefix))).withColumn("relative", relative)
    directories = F.slice(F.split("relative", "/"), F.lit(1), F.size(F.split("relative", "/")) - 1)
    kept = named.withColumn("suffix", path_suffix(F.col("relative"))).where(
        F.col("suffix").isin(*suffixes) & ~F.arrays_overlap(directories, F.array(*[F.lit(d) for d in skip]))
    )
    return kept.select(
        F.split_part("relative", F.lit("/"), F.lit(1)).alias("app_id"),
        F.substr("relative", F.instr("relative", "/") + 1).alias("path"), "suffix",
        F.regexp_replace(F.decode("content", "UTF-8"), "^\\x{FEFF}", "").alias("text"),
    )


def with_weaknesses(rules: DataFrame, bridge: DataFrame) -> DataFrame:
    """Rules with their weakness ids: their own, else the bridge's (rule_id, weakness_id)."""
    mapped = bridge.groupBy("rule_id").agg(F.array_sort(F.collect_set("weakness_id")).alias("__mapped"))
    own = F.coalesce("maswe", F.array().cast("array<string>"))
    return rules.join(mapped, "rule_id", "left").withColumn(
        "maswe", F.when(F.size(own) > 0, own).otherwise(F.coalesce("__mapped", F.array().cast("array<string>")))
    ).drop("__mapped")


RULE_SCHEMA = (
    "rules array<struct<id string, severity string, platform string, suffixes array<string>, requires string, pattern string, "
    "argument_pattern string, case_sensitive boolean, once_per_file boolean, masvs string, maswe array<string>>>"
)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule catalogue file (JSON with a ``rules`` list) as a rule table."""
    return rule_rows(spark.read.schema(RULE_SCHEMA).json(path, multiLine=True))


def rule_rows(documents: DataFrame) -> DataFrame:
    """Rules of parsed catalogue documents; rows without an id or a pattern are left out."""
    rows = documents.select(F.explode("rules").alias("r")).select(F.col("r.id").alias("rule_id"), "r.*").drop("id")
    return rows.where("rule_id IS NOT NULL AND pattern IS NOT NULL")


def taxonomy_bridges(weaknesses: DataFrame) -> DataFrame:
    """(weakness_id, kind, value) rows of platforms, controls, CWE and superseded ids."""
    kinds = [("platform", "platform"), ("masvs", "masvs"), ("cwe", "cwe"), ("beta", "beta")]
    out = None
    for kind, column in kinds:
        part = weaknesses.select(F.col("id").alias("weakness_id"), F.lit(kind).alias("kind"), F.explode(column).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def canary_matches(files: DataFrame, markers: DataFrame) -> DataFrame:
    """Markers found in captured files (scenario, snapshot, surface, path, content), in UTF-8 or either UTF-16 order.

    Markers (label, marker) are configuration and become literal byte tests; values are never emitted.
    """
    tests = []
    for row in bounded_rows(markers, "marker table", 1000):
        text = row["marker"]
        forms = [text.encode("utf-8"), text.encode("utf-16-le"), text.encode("utf-16-be")]
        hit = F.lit(False)
        for form in forms:
            hit = hit | F.contains(F.col("content"), F.lit(form))
        tests.append(F.when(hit, F.lit(row["label"])))
    labels = F.array_compact(F.array(*tests))
    return files.select("scenario", "snapshot", "surface", "path", F.explode(labels).alias("marker"))


