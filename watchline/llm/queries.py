"""The queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from watchline.llm import bpe, decontaminate, language_model, licenses, manifest, manifest_sql, near_dups, private, quality_rules, secrets, site_quality, spelling, spelling_sql, substrings, toxicity
from watchline.plans.registry import Registry
from watchline.sources.tables import table

REGISTRY = Registry()

#: The vocabulary's file, at the same place on every worker.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@REGISTRY.query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(table(spark, sf_dir, "documents"), VOCABULARY)


@REGISTRY.query("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@REGISTRY.query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


@REGISTRY.query("op6_secrets")
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@REGISTRY.query("op9_substrings")
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


@REGISTRY.query("op5_near_dups")
def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.groups_of(table(spark, sf_dir, "documents"))


@REGISTRY.query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@REGISTRY.query("op2_lm_scores")
def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.lm_scores(table(spark, sf_dir, "documents"))


@REGISTRY.query("op3_licenses")
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


@REGISTRY.query("op7_site_quality")
def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@REGISTRY.query("op11_manifest", manifest_sql.SQL)
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verify(table(spark, sf_dir, "documents"))


@REGISTRY.query("op13_spelling", spelling_sql.SQL)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@REGISTRY.query("op12_private")
def op12_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.scan(table(spark, sf_dir, "documents"))
