"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from nodetide.llm import (
    byte_bpe,
    graph_ann,
    html_text,
    language_id,
    quality_classifier,
    quality_rules,
    simhash,
    source_mix,
    suffix_dedup,
    window_dedup,
)
from nodetide.llm.common import table


def op1_graph_ann(spark, sf_dir):
    return graph_ann.nearest_of_every_fiftieth(table(spark, sf_dir, "embeddings"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op6_window_dedup(spark, sf_dir):
    return window_dedup.report(table(spark, sf_dir, "documents"))


def op3_source_mix(spark, sf_dir):
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op7_language_id(spark, sf_dir):
    return language_id.predict_documents(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark, sf_dir, vocabulary: str | None = None):
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_quality_classifier(spark, sf_dir):
    return quality_classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_text(spark, sf_dir):
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_graph_ann,
        op2_suffix_dedup,
        op3_source_mix,
        op4_simhash,
        op5_quality_rules,
        op6_window_dedup,
        op7_language_id,
        op8_byte_bpe,
        op9_quality_classifier,
        op10_html_text,
    )
}
#: The others are tested against brute force, an exact round trip or held-out accuracy.
ORACLE_SQL = {"op3_source_mix": source_mix.oracle_sql(), "op5_quality_rules": quality_rules.ORACLE_SQL}
