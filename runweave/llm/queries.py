"""The queries of the operators, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import embeddings, hashing, html, jaccard, lm, merkle, mixing, packing, pii, quality, spelling, toxicity, warc
from .common import table


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_extraction(spark, sf_dir):
    return html.main_text(table(spark, sf_dir, "pages"))


def op5_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard_join(spark, sf_dir):
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


def op7_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark, sf_dir):
    d = quality.quality(table(spark, sf_dir, "documents"))
    return d.select("doc_id", *quality.NAMES, "base_failed", "kept", *(F.round(f"rate_{k}", 9).alias(f"rate_{k}") for k in quality.rules()))


def op9_mixing(spark, sf_dir):
    return mixing.mix(mixing.sized(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op10_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_nearest_neighbours(spark, sf_dir):
    return hashing.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_lm_scoring, op3_toxicity, op4_html_extraction, op5_embedding_near_dedup, op6_ngram_jaccard_join, op7_pii, op8_quality_rules, op9_mixing, op10_warc, op11_merkle_manifest, op12_spelling_variants, op13_nearest_neighbours)}
ORACLES = {"op6_ngram_jaccard_join": jaccard.ORACLE, "op8_quality_rules": quality.ORACLE, "op9_mixing": mixing.ORACLE, "op10_warc": warc.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_spelling_variants": spelling.ORACLE}
