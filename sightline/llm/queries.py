"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import block_labeller, cotraining, crf_secrets, ctw, fill_middle, mixing, ngram_join, nn_descent, packing
from sightline.llm import periodic_runs, projection_dedup, sharding, warc
from sightline.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_virtual_slots")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard(table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


@query("op2_context_tree")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return ctw.score(table(spark, folder, "documents"))


@query("op3_warc_dictionary")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive(table(spark, folder, "pages"))


@query("op4_cotraining")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return cotraining.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_window_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(table(spark, folder, "documents"), *files, public_tokenizers.PATTERN, with_ids=False)


@query("op6_projection_passes")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return projection_dedup.near_duplicates(table(spark, folder, "embeddings"))


@query("op7_random_field")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return crf_secrets.scan(table(spark, folder, "documents"))


@query(
    "op8_source_mixing",
    r"""
    WITH d AS (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
      FROM documents),
    p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d),
    s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
    r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
    w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM r),
    q AS (SELECT *, cap / weight AS ratio, (SELECT sum(source_size) FROM w) AS total, (SELECT sum(weight) FROM w) AS weights FROM w),
    l AS (SELECT *, (total - (sum(cap) OVER o - cap)) / (weights - sum(weight) OVER o + weight) AS level FROM q
          WINDOW o AS (ORDER BY ratio, rank ROWS UNBOUNDED PRECEDING)),
    a AS (SELECT arg_min(level, rank_all) AS free_level FROM (SELECT *, row_number() OVER (ORDER BY ratio, rank) AS rank_all FROM l) z WHERE cap > level * weight),
    t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(free_level * weight, CAST(cap AS DOUBLE))) AS target FROM l, a),
    b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM t),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b)
    SELECT p.doc_id, p.size, CAST(e.source_size AS BIGINT) AS source_size, e.target AS target,
           CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - (upto - size))) AS BIGINT) AS taken
    FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_ngram_minhash")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents"))


@query("op10_nn_descent")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return nn_descent.search(table(spark, folder, "embeddings"))


@query("op11_block_labeller")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return block_labeller.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars", "n_blocks", "n_main")


@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.annotate(table(spark, folder, "documents"), rewrite=periodic_runs.periodic_tail))


@query(
    "op13_fill_in_middle",
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    u AS (
      SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
             CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
    c AS (SELECT *, CAST(len(units) AS BIGINT) AS n FROM u),
    f AS (
      SELECT doc_id, text, n,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                  THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
             array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
             array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:n], '') AS suffix FROM c)
    SELECT doc_id, n, form,
           CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM f
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    done = fill_middle.transform(table(spark, folder, "documents"))
    digest = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)
