"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from filingloom.llm import bpe, fingerprint, langid, licenses, mixing, neardup, oracles, pii, tiff, urltree, warc
from filingloom.llm.common import Scratch, prepare, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_path() -> str:
    """Where the public tokenizers' byte-level vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.components(table(spark, sf_dir, "documents"), width=4, percent=80)
    return found.withColumnRenamed("id", "doc_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents"), ["doc_id"], Scratch(spark, "mix").write).taken()


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(table(spark, sf_dir, "pages"))


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_pictures(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_language_id, op2_fingerprints, op3_near_duplicates, op4_mixing, op5_licenses, op6_pii, op7_warc, op8_url_filter, op9_tiff, op10_bpe)}
ORACLES = oracles.ORACLES


def queries() -> dict[str, Query]:
    def importable(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return query(spark, sf_dir)

        return run

    return {name: importable(q) for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
