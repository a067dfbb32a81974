"""The registered queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .chat_format import OP1_SQL, op1_chat_formatting
from .common import bounded
from .context_tree import op10_ctw_scoring
from .edit_decontamination import op6_cgk_decontamination
from .filter_audit import OP12_SQL, op12_filter_audit
from .hamming_index import op4_multi_index_hashing
from .jaccard_join import OP9_SQL, op9_adaptive_prefix_join
from .language_id import op7_hierarchical_langid
from .packing import op3_dp_packing
from .sharding import OP2_SQL, op2_hilbert_sharding
from .sorted_projections import OP13_SQL, op13_sorted_projections
from .spelling_variants import OP11_SQL, op11_spelling_variants
from .suffix_array import OP8_SQL, op8_induced_suffix_dedup
from .suffix_tree import OP5_SQL, op5_suffix_tree_dedup

QUERIES = {
    f.__name__: bounded(f)
    for f in (
        op1_chat_formatting,
        op2_hilbert_sharding,
        op3_dp_packing,
        op4_multi_index_hashing,
        op5_suffix_tree_dedup,
        op6_cgk_decontamination,
        op7_hierarchical_langid,
        op8_induced_suffix_dedup,
        op9_adaptive_prefix_join,
        op10_ctw_scoring,
        op11_spelling_variants,
        op12_filter_audit,
        op13_sorted_projections,
    )
}

ORACLES = {
    "op1_chat_formatting": OP1_SQL,
    "op2_hilbert_sharding": OP2_SQL,
    "op5_suffix_tree_dedup": OP5_SQL,
    "op8_induced_suffix_dedup": OP8_SQL,
    "op9_adaptive_prefix_join": OP9_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_sorted_projections": OP13_SQL,
}
