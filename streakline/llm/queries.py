"""The queries of the subpackage and their SQL."""

from __future__ import annotations

from .bpe import op5_bpe_trie
from .decontamination import OP9_SQL, op9_decontaminate
from .embedding_dedup import OP10_SQL, op10_embedding_dedup
from .html_extraction import OP3_SQL, op3_site_style_tree
from .jaccard_join import OP7_SQL, op7_jaccard_join
from .line_dedup import OP6_SQL, op6_line_dedup
from .substring_dedup import OP2_SQL, op2_debruijn_substrings
from .suffix_dedup import OP1_SQL, op1_suffix_dedup
from .token_counts import op4_token_counts
from .toxicity import op8_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_debruijn_substrings": op2_debruijn_substrings,
    "op3_site_style_tree": op3_site_style_tree,
    "op4_token_counts": op4_token_counts,
    "op5_bpe_trie": op5_bpe_trie,
    "op6_line_dedup": op6_line_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_toxicity": op8_toxicity,
    "op9_decontaminate": op9_decontaminate,
    "op10_embedding_dedup": op10_embedding_dedup,
}
SQL = {"op1_suffix_dedup": OP1_SQL, "op2_debruijn_substrings": OP2_SQL, "op3_site_style_tree": OP3_SQL, "op6_line_dedup": OP6_SQL, "op7_jaccard_join": OP7_SQL, "op9_decontaminate": OP9_SQL, "op10_embedding_dedup": OP10_SQL}
