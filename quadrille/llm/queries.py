"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm.common import table


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives are written to the shared folder and read back by the salvage reader."""
    from pyspark.sql import functions as F

    from quadrille.llm.common import materialize, scratch_path
    from quadrille.llm.warc import log_gaps, read_warc, write_warc

    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    read = materialize(read_warc(spark, path, with_payload=False).drop("payload"), "records")
    log_gaps(read, f"{path}-gaps")
    return read.where("kind = 'record'").select(
        F.expr(r"try_cast(regexp_extract(record_id, '^urn:page:(-?[0-9]+)$', 1) as long)").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.expr(r"try_cast(regexp_extract(refers_to, '^urn:page:(-?[0-9]+)$', 1) as long)").alias("refers_to"),
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op5_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.pii import find_personal_data, report

    return report(find_personal_data(table(spark, sf_dir, "documents")))


def op6_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op8_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.embeddings import embedding_duplicates

    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.substrings import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc_salvage, op2_mix_sources, op3_quality_trees, op4_best_fit_packing, op5_pii_disclosure, op6_toxicity_grammar, op7_exact_dedup, op8_projection_forest, op9_minhash, op10_repeated_passages, pipeline)}


def oracle_sql() -> dict[str, str]:
    from quadrille.llm import embeddings, minhash, mixing, substrings

    return {
        "op1_warc_salvage": r"""
            WITH p AS (
                SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
            q AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
            SELECT page_id, n AS payload_bytes, digest AS payload_digest,
                   CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
            FROM q""",
        "op2_mix_sources": mixing.ORACLE,
        "op7_exact_dedup": r"""
            WITH d AS (
                SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
            SELECT doc_id,
                   min(doc_id) OVER (PARTITION BY norm) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size,
                   min(doc_id) OVER (PARTITION BY norm) = doc_id AS kept,
                   sha256(norm) AS text_sha256
            FROM d""",
        "op8_projection_forest": embeddings.ORACLE,
        "op9_minhash": minhash.ORACLE,
        "op10_repeated_passages": substrings.ORACLE,
    }
