"""Queries of the training-data operators and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from millrace.llm import bpe, extendible, jpeg, minhash, mixing, preference, quality_hosts, suffix, toxicity, warc

QUERIES = {
    "op1_warc_dictionary": warc.query,
    "op2_extendible_hashing": extendible.query,
    "op3_mix_hash_histograms": mixing.query,
    "op4_bwt_repeats": suffix.query,
    "op5_toxicity_lexicon": toxicity.query,
    "op6_jpeg_media": jpeg.query,
    "op7_probminhash_near": minhash.query,
    "op8_bpe_distinct_words": bpe.query,
    "op9_quality_host_rules": quality_hosts.query,
    "op10_preference_pairs": preference.query,
    "host_verdicts_of_pages": quality_hosts.page_query,
}

ORACLES = {
    "op1_warc_dictionary": warc.SQL,
    "op2_extendible_hashing": extendible.SQL,
    "op3_mix_hash_histograms": mixing.SQL,
    "op9_quality_host_rules": quality_hosts.SQL,
    "op10_preference_pairs": preference.SQL,
    "host_verdicts_of_pages": quality_hosts.PAGE_SQL,
}
