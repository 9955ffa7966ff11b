"""The thin queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import packing

    return packing.pack(_docs(spark, sf_dir), _path("byte_bpe_50k.json"), window=2048, end_id=1)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import transport

    return transport.media_features(_docs(spark, sf_dir))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import substrings

    return substrings.repeats(_docs(spark, sf_dir))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import simhash

    return simhash.near_duplicates(_docs(spark, sf_dir))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import wavelet

    return wavelet.token_output(_docs(spark, sf_dir), _path("byte_bpe_50k.json"), end_id=0)


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import licences

    return licences.scan(_docs(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import counts

    return counts.token_counts(_docs(spark, sf_dir), _path("word_bpe_49k.json"), limit=2048)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import decontaminate

    return decontaminate.contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import language

    return language.identify(_docs(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import quality

    return quality.classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import toxicity

    return toxicity.toxic_documents(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import collocations

    return collocations.collocations(_docs(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbside.llm import periods

    return periods.periodic_runs(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_packing,
        op2_media_columns,
        op3_suffix_array_dedup,
        op4_simhash_near_dedup,
        op5_token_output,
        op6_licence_scan,
        op7_token_counts,
        op8_decontamination,
        op9_language_id,
        op10_quality_classifier,
        op11_toxicity,
        op12_collocations,
        op13_periodic_runs,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from kerbside.llm import collocations, decontaminate, licences

    return {
        "op6_licence_scan": licences.scan_sql(),
        "op8_decontamination": decontaminate.CONTAMINATION_SQL,
        "op12_collocations": collocations.COLLOCATIONS_SQL,
    }
