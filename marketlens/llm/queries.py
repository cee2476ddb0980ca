"""The registered queries of this subpackage; ``__spark_entry__`` adds them where it can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_trie, fingerprints, language_id, lexical_search, licenses, mixing, ngram_join, packing, pii, quality, simhash, suffix_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scans": licenses.query,
        "op2_simhash_near_dedup": simhash.query,
        "op3_packing": packing.query,
        "op4_suffix_array_dedup": suffix_dedup.query,
        "op5_quality_rules": quality.query,
        "op6_toxicity": toxicity.query,
        "op7_language_id": language_id.query,
        "op8_pii": pii.query,
        "op9_mixing_sources": mixing.query,
        "op10_document_fingerprints": fingerprints.query,
        "op11_ngram_jaccard_join": ngram_join.query,
        "op12_conversation_trie": conversation_trie.query,
        "op13_lexical_search": lexical_search.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_ngram_jaccard_join": ngram_join.SQL, "op12_conversation_trie": conversation_trie.SQL, "op13_lexical_search": lexical_search.SQL}
