"""Mixing sources to target weights.

Documents get hash-random keys, are range-sorted within their source, and distributed prefix sums of their word
counts cut every source at its exact budget; a budget larger than the source repeats it in whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import WORD, saved
from sightline.scale import numbered, running_total

CEILING = 3


def source_targets(sizes: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: the share of all words given to each source.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. No target is above ``ceiling`` times its source's
    size; what is cut goes to the others by weight until none is above. With sources ordered by ceiling over weight,
    the capped ones come first, so one level for the rest follows from prefix sums.
    """
    named = sizes.withColumn("unnamed", F.col("source").isNull())
    ranked = numbered(named, [], ["unnamed", "source"], "rank")
    ranked = ranked.withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("cap", F.col("source_size") * ceiling)
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    summed = running_total(ranked, [], ["ratio", "rank"], {"caps": F.col("cap"), "weights": F.col("weight")})
    totals = sizes.agg(F.sum("source_size").alias("total"), F.count(F.lit(1)).alias("sources"))
    weights = ranked.agg(F.sum("weight").alias("all_weights"))
    one = totals.join(F.broadcast(weights))  # one row each
    level = (F.col("total") - (F.col("caps") - F.col("cap"))) / (F.col("all_weights") - F.col("weights") + F.col("weight"))
    summed = summed.join(F.broadcast(one)).withColumn("level", level)
    free = summed.where(F.col("cap") > F.col("level") * F.col("weight")).agg(F.min_by("level", F.struct("ratio", "rank")).alias("at"))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("at") * F.col("weight"), F.col("cap").cast("double")))
    return summed.join(F.broadcast(free)).select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, ceiling: int = CEILING, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, source_size, target, taken.

    ``size`` counts words (null text: none); ``taken`` counts the words the mix takes, repeats included: whole epochs
    of the source and then its first documents in hash order, the last of them in part, up to the rounded target.
    Repeated rows are rows of their own; rows alike in doc_id and size are interchangeable.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    sized = saved(sized, "sizes")  # words are counted once; the numbers are read several times
    prefixed = running_total(sized, ["source"], ["key", "doc_id", "size", "text_crc32"], {"upto": F.col("size")})
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), ceiling)
    targets = targets.withColumnRenamed("source", "target_source")
    joined = prefixed.join(targets, F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - (F.col("upto") - F.col("size"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return joined.select("doc_id", "source", "size", "text_crc32", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, ceiling: int = CEILING, seed: str = "mix") -> DataFrame:
    """The mixed corpus: rows of ``docs`` as often as the mix takes them, the last one of a source cut after its words.

    Documents without words carry nothing to mix and stay once; rows alike share their words evenly, rounded down. Columns are those of ``docs``.
    """
    part = ["__doc", "__crc"]
    plan = mix(docs, ceiling, seed).select(F.col("doc_id").alias("__doc"), F.col("text_crc32").alias("__crc"), "source", "size", "taken")
    plan = plan.withColumnRenamed("source", "__source").groupBy(*part, "__source", "size").agg(F.sum("taken").alias("__taken"), F.count(F.lit(1)).alias("__alike"))
    keyed = docs.withColumn("__doc_key", F.col("doc_id").cast("long")).withColumn("__crc_key", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    joined = keyed.join(
        plan.withColumnRenamed("size", "__size"),
        F.col("__doc_key").eqNullSafe(F.col("__doc")) & (F.col("__crc_key") == F.col("__crc")) & F.col("source").eqNullSafe(F.col("__source")),
    )
    share = F.floor(F.col("__taken") / F.col("__alike"))
    whole = F.when(F.col("__size") > 0, F.floor(share / F.greatest("__size", F.lit(1)))).otherwise(1).cast("int")
    rest = F.when(F.col("__size") > 0, share - whole * F.col("__size")).otherwise(0)
    word_ends = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
    cut = F.array_join(F.slice(F.split("text", word_ends), F.lit(1), F.greatest(F.col("__rest"), F.lit(1)).cast("int")), "")
    copies = F.array_repeat(F.lit(False), whole)
    marks = F.when(F.col("__rest") > 0, F.concat(copies, F.array(F.lit(True)))).otherwise(copies)
    rows = joined.withColumn("__rest", rest).withColumn("__partly", F.explode(marks))
    columns = [F.when(F.col("__partly"), cut).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        columns[at] = F.when(F.col("__partly"), F.length(cut).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return rows.select(*columns)
