"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from kbloom.llm.bpe import op5_bpe
from kbloom.llm.decontaminate import op8_decontaminate
from kbloom.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from kbloom.llm.html_extract import op6_html_extract
from kbloom.llm.language_id import op1_language_id
from kbloom.llm.licenses import op10_license_scan
from kbloom.llm.oracles import OP3_SQL, OP8_SQL, OP9_SQL
from kbloom.llm.quality_rules import op4_quality_rules
from kbloom.llm.sharding import OP7_SQL, op7_sharding
from kbloom.llm.simhash_dedup import op2_simhash_dedup
from kbloom.llm.source_divergence import OP11_SQL, op11_source_divergence
from kbloom.llm.substring_dedup import op9_substring_dedup
from kbloom.llm.topk_search import OP12_SQL, op12_exact_topk
from kbloom.llm.url_filters import op3_url_filters

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_url_filters": op3_url_filters,
    "op4_quality_rules": op4_quality_rules,
    "op5_bpe": op5_bpe,
    "op6_html_extract": op6_html_extract,
    "op7_sharding": op7_sharding,
    "op8_decontaminate": op8_decontaminate,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_source_divergence": op11_source_divergence,
    "op12_exact_topk": op12_exact_topk,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op3_url_filters": OP3_SQL,
    "op7_sharding": OP7_SQL,
    "op8_decontaminate": OP8_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_exact_topk": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
