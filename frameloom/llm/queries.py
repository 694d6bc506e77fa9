"""Queries over the supplied tables, one for each operator, with the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .ann import nearest
from .clusters import cluster, with_inertia
from .exact_dedup import exact_dedup
from .fim import fill_in_middle, restored
from .html_text import extract
from .language import held_out, identify, learn
from .mixing import capped_targets, cycle_weights, mix, word_count
from .packing import pack
from .quality import classify
from .simhash import simhash_components
from .token_binary import token_binary
from .token_counts import count_tokens
from .tokenizer import public_spec
from .warc import archive


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label="quality", sample=1200)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), words=3, radius=3)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_spec("byte_bpe_50k.json"), end_id=1, tiers=(2048, 1024, 512, 256))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary(table(spark, sf_dir, "documents"), public_spec("word_bpe_49k.json"), end_id=1)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"), min_revisit_bytes=0)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(
        table(spark, sf_dir, "documents"),
        word_count("text"),
        F.col("source"),
        lambda names, sizes: capped_targets(sizes, cycle_weights(len(names)), share=1.0, max_repeat=3),
        max_repeat=3,
        seed=7,
    )
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.element_at("members", 1).alias("source"), "copies")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_spec("piece_bpe_32k.model"), limit=4096)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, seed=2))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"), seed=1)
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs.where(~held_out("doc_id")), public_spec("piece_bpe_32k.model").path))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_packing": op4_packing,
    "op5_token_binary": op5_token_binary,
    "op6_warc": op6_warc,
    "op7_source_mixing": op7_source_mixing,
    "op8_token_counts": op8_token_counts,
    "op9_html_text": op9_html_text,
    "op10_nearest": op10_nearest,
    "op11_clusters": op11_clusters,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_language": op13_language,
}


def _lloyd(k: int, rounds: int, dims: int, seed: int, scale: int) -> str:
    """Lloyd's rounds as a chain of tables: centroids c0, nearest ones a0, and so on."""
    parts = [
        f"""v AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"""c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h, vec_id, v) - 1 AS cluster, v AS c
            FROM (SELECT *, sha256('{seed}:' || vec_id) AS h FROM v ORDER BY h, vec_id, v LIMIT {k}))""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (
            SELECT vec_id, any_value(v) AS v, min(struct_pack(d := d, cluster := cluster)) AS best
            FROM (SELECT row, vec_id, v, cluster, list_sum(list_transform(v, lambda x, i: (x - c[i]) * (x - c[i]))) AS d
                  FROM (SELECT row_number() OVER () AS row, * FROM v), c{r})
            GROUP BY row, vec_id)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (
            SELECT c{r}.cluster, coalesce(m.c, c{r}.c) AS c
            FROM c{r} LEFT JOIN (
                SELECT cluster, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS c
                FROM (SELECT best.cluster AS cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY ALL)
                GROUP BY cluster) m USING (cluster))"""
            )
    return (
        "WITH " + ",\n        ".join(parts) + f"""
        SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
               CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON c{rounds}.cluster = best.cluster
    """
    )


ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_clusters": _lloyd(k=40, rounds=5, dims=64, seed=2, scale=256),
    "op12_fill_in_middle": """
        WITH units AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
        hashed AS (
            SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM units),
        cut AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM hashed),
        parts AS (
            SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM cut)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
               CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts
    """,
}
