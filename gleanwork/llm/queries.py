"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanwork.llm import license_scan, prefix_trie, topk_search
from gleanwork.llm.jaccard_join import op4_jaccard_join
from gleanwork.llm.license_scan import op5_license_scan
from gleanwork.llm.media_copies import op7_media_copies
from gleanwork.llm.mixing import op10_mix_min_cost_flow
from gleanwork.llm.packing import op1_pack_best_fit
from gleanwork.llm.prefix_trie import op13_prefix_trie
from gleanwork.llm.secret_scan import op8_secret_scan
from gleanwork.llm.simhash import op12_simhash_balls
from gleanwork.llm.substring_dedup import op2_substring_dedup
from gleanwork.llm.token_counts import op3_token_counts
from gleanwork.llm.topk_search import op6_exact_topk
from gleanwork.llm.toxicity import op9_toxicity
from gleanwork.llm.whitening import op11_whiten_chebyshev

_ALL = [op1_pack_best_fit, op2_substring_dedup, op3_token_counts, op4_jaccard_join, op5_license_scan, op6_exact_topk, op7_media_copies, op8_secret_scan, op9_toxicity, op10_mix_min_cost_flow, op11_whiten_chebyshev, op12_simhash_balls, op13_prefix_trie]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op5_license_scan": license_scan.ORACLE, "op6_exact_topk": topk_search.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
