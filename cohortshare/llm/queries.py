"""Registered queries of the corpus operators and their SQL oracles."""

from __future__ import annotations

from . import (anchor_points, bit_slices, disclosure, grouped_packing, induced_suffixes, license_index, line_frequency, multi_order_join, ns_bounds, oracles, patricia,
               piece_transducer, string_kernel, window_dedup)
from .common import read_documents


def op1_line_frequency(spark, sf_dir):
    return line_frequency.judge_documents(read_documents(spark, sf_dir))


def op2_suffix_dedup(spark, sf_dir):
    return induced_suffixes.remove_earlier_strings(read_documents(spark, sf_dir)).drop("kept")


def op3_license_scan(spark, sf_dir):
    return license_index.scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_pii_disclosure(spark, sf_dir):
    return disclosure.find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_language_id(spark, sf_dir):
    return string_kernel.identify_languages(read_documents(spark, sf_dir))


def op6_exact_dedup(spark, sf_dir):
    return patricia.exact_dedup(read_documents(spark, sf_dir)).drop("first_id")


def op7_sentencepiece(spark, sf_dir):
    return piece_transducer.encode_and_check(read_documents(spark, sf_dir))


def op8_substring_dedup(spark, sf_dir):
    return window_dedup.remove_repeated_windows(read_documents(spark, sf_dir)).drop("text")


def op9_jaccard_join(spark, sf_dir):
    return multi_order_join.document_components(read_documents(spark, sf_dir))


def op10_best_fit_packing(spark, sf_dir):
    return grouped_packing.best_fit_pack(read_documents(spark, sf_dir))


def op11_simhash_anchors(spark, sf_dir):
    return anchor_points.simhash_components(read_documents(spark, sf_dir))


def op12_centroid_clusters(spark, sf_dir):
    return ns_bounds.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_bit_sliced_search(spark, sf_dir):
    return bit_slices.rank_documents(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_line_frequency, op2_suffix_dedup, op3_license_scan, op4_pii_disclosure, op5_language_id, op6_exact_dedup,
    op7_sentencepiece, op8_substring_dedup, op9_jaccard_join, op10_best_fit_packing,
    op11_simhash_anchors, op12_centroid_clusters, op13_bit_sliced_search)}
ORACLE = oracles.ORACLE
