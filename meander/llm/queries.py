"""Queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, fill_middle, line_dedup, minhash_dedup, packing, piece_codec, prefix_trie, quality_classifier, quality_rules, toxicity, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.query,
        "op2_packing": packing.query,
        "op3_toxicity": toxicity.query,
        "op4_line_dedup": line_dedup.query,
        "op5_minhash_dedup": minhash_dedup.query,
        "op6_url_filter": url_filter.query,
        "op7_warc": warc.query,
        "op8_quality_rules": quality_rules.query,
        "op9_quality_classifier": quality_classifier.query,
        "op10_chat_format": chat_format.query,
        "op11_fill_middle": fill_middle.query,
        "op12_prefix_trie": prefix_trie.query,
        "op13_piece_codec": piece_codec.query,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op1_decontaminate": decontaminate.ORACLE_SQL, "op4_line_dedup": line_dedup.ORACLE_SQL, "op5_minhash_dedup": minhash_dedup.ORACLE_SQL}
    return found | {"op6_url_filter": url_filter.ORACLE_SQL, "op7_warc": warc.ORACLE_SQL, "op10_chat_format": chat_format.ORACLE_SQL, "op11_fill_middle": fill_middle.ORACLE_SQL, "op12_prefix_trie": prefix_trie.ORACLE_SQL}
