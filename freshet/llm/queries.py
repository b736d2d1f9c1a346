"""The corpus operators as queries over the test tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from freshet.llm.language_filters import language_query
from freshet.llm import decontaminate, hash_tree, line_frequency, minmax_dedup, mixing, prefix_trie, quotation, secret_ledger, shared_ranking, warc_archive
from freshet.llm.pii_transducer import personal_data_query
from freshet.llm.token_store import tokens_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": tokens_query,
    "op2_mixing": mixing.mixing_query,
    "op3_secret_ledger": secret_ledger.secrets_query,
    "op4_pii_transducer": personal_data_query,
    "op5_minmax_dedup": minmax_dedup.near_duplicates_query,
    "op6_decontaminate": decontaminate.contamination_query,
    "op7_line_frequency": line_frequency.line_quality_query,
    "op8_warc_archive": warc_archive.archive_query,
    "op9_language_filters": language_query,
    "op10_quotation": quotation.quotation_query,
    "op11_shared_ranking": shared_ranking.ranking_query,
    "op12_hash_tree": hash_tree.shards_query,
    "op13_prefix_trie": prefix_trie.trie_query,
}

ORACLE: dict[str, str] = {
    "op11_shared_ranking": shared_ranking.oracle_sql(),
    "op12_hash_tree": hash_tree.oracle_sql(),
    "op13_prefix_trie": prefix_trie.oracle_sql(),
    "op10_quotation": quotation.oracle_sql(),
    "op2_mixing": mixing.oracle_sql(),
    "op3_secret_ledger": secret_ledger.oracle_sql(),
    "op5_minmax_dedup": minmax_dedup.oracle_sql(),
    "op6_decontaminate": decontaminate.oracle_sql(),
    "op7_line_frequency": line_frequency.oracle_sql(),
    "op8_warc_archive": warc_archive.oracle_sql(),
}
