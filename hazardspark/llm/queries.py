"""Queries of this subpackage for ``__spark_entry__``: name to callable, and SQL where SQL can express one."""

from __future__ import annotations

from .ann import op3_nearest_neighbours
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import OP4_SQL, op4_mixing
from .ngram_join import op7_ngram_jaccard_join
from .packing import op8_best_fit_packing
from .quality import op5_quality_classifier
from .reference_sql import OP6_SQL, OP7_SQL
from .sharding import OP2_SQL, op2_sharding
from .trie import OP11_SQL, op11_prefix_trie
from .windows import op13_concat_packing
from .substring_dedup import op6_substring_dedup
from .suffix_dedup import op9_suffix_array_dedup
from .toxicity import op10_toxicity

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sharding": op2_sharding,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_mixing": op4_mixing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_concat_packing": op13_concat_packing,
}

SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op2_sharding": OP2_SQL,
    "op4_mixing": OP4_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op7_ngram_jaccard_join": OP7_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
