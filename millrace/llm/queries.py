"""Queries of this package for the entry module: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from millrace.llm import centroids, context_tree, decontaminate, divergence, licences, near_dedup, order_minhash, packing, redirects, site_tree, toxicity, warc, word_bpe

QUERIES = {
    "op1_toxicity": (toxicity.query, None),
    "op2_url_filters": (redirects.query, redirects.ORACLE),
    "op3_order_minhash": (order_minhash.query, None),
    "op4_simhash_near_dedup": (near_dedup.query, None),
    "op5_warc": (warc.query, None),
    "op6_licence_scan": (licences.query, None),
    "op7_decontamination": (decontaminate.query, None),
    "op8_lm_scoring": (context_tree.query, None),
    "op9_html_extraction": (site_tree.query, None),
    "op10_packing": (packing.query, None),
    "op11_centroid_clustering": (centroids.query, centroids.ORACLE),
    "op12_source_divergence": (divergence.query, divergence.ORACLE),
    "op13_word_bpe": (word_bpe.query, None),
}
