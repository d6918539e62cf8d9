"""Queries of this subpackage over the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

from folioflow.llm import decontaminate, html_extract, language_id, mixing, quality_rules, secrets, simhash, substring_dedup, token_counts, url_filters
from folioflow.llm.common import saved, table


def op1_simhash(spark, sf_dir):
    return simhash.digest(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_url_filters(spark, sf_dir):
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), url_filters.contract_rules(spark))


def op5_secret_scan(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return token_counts.digest(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    return language_id.digest(table(spark, sf_dir, "documents"))


def quality_ablations(spark, sf_dir):
    """What each rule of op9 rejects, from the stored ledger."""
    return quality_rules.ablations(saved(quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", quality_rules.LEDGER)))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_source_mixing, op3_decontamination, op4_url_filters, op5_secret_scan, op6_html_extraction, op7_substring_dedup, op8_token_counts, op9_quality_rules, op10_language_id, quality_ablations)}
ORACLE = {"op2_source_mixing": mixing.SQL, "op3_decontamination": decontaminate.SQL, "op4_url_filters": url_filters.SQL, "op7_substring_dedup": substring_dedup.SQL, "op9_quality_rules": quality_rules.SQL, "quality_ablations": quality_rules.ABLATION_SQL}
