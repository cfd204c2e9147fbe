"""Queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from cairn.llm import bpe_reuse, chat_masks, jaccard_join, lm_trie, metric_join, mixing, quality_rules, substring_dedup, toxicity, url_filter
from cairn.llm.common import table

LLM_QUERIES = {
    "op1_lm_trie": lambda spark, sf: lm_trie.score_documents(table(spark, sf, "documents"), lm_trie.ALL),
    "op2_url_reputation": lambda spark, sf: url_filter.filter_urls(table(spark, sf, "pages"), table(spark, sf, "labels")),
    "op3_jaccard_join": lambda spark, sf: jaccard_join.jaccard_classes(table(spark, sf, "documents")),
    "op4_repeated_spans": lambda spark, sf: substring_dedup.repeated_spans(table(spark, sf, "documents")),
    "op5_metric_join": lambda spark, sf: metric_join.near_classes(table(spark, sf, "embeddings")),
    "op6_mix_sources": lambda spark, sf: mixing.mix_documents(table(spark, sf, "documents")),
    "op9_chat_masks": lambda spark, sf: chat_masks.format_chats(table(spark, sf, "conversations")),
    "op10_bpe_reuse": lambda spark, sf: bpe_reuse.encode_documents(table(spark, sf, "documents")),
    "op7_toxicity": lambda spark, sf: toxicity.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op8_host_rules": lambda spark, sf: quality_rules.quality_verdicts(table(spark, sf, "documents")),
    "metric_join_loose": lambda spark, sf: metric_join.near_pairs(table(spark, sf, "embeddings"), metric_join.LOOSE),
    "pipeline": corpus_pipeline.run,
}
LLM_SQL = {"op2_url_reputation": url_filter.SQL, "op3_jaccard_join": jaccard_join.SQL, "op4_repeated_spans": substring_dedup.SQL, "op5_metric_join": metric_join.SQL, "metric_join_loose": metric_join.sql(metric_join.LOOSE), "op6_mix_sources": mixing.SQL, "op7_toxicity": toxicity.SQL, "op8_host_rules": quality_rules.SQL}
