"""The queries of this package and their SQL."""

from __future__ import annotations

from .decontaminate import OP8_SQL, op8_decontamination
from .embedding_dedup import op10_embedding_near_dedup
from .line_dedup import OP7_SQL, op7_line_dedup
from .mixing import op5_mixing
from .near_dedup import op2_minhash_near_dedup
from .sharding import OP1_SQL, op1_sharding
from .substring_dedup import op3_substring_dedup
from .suffix_dedup import op4_suffix_dedup
from .token_counts import op6_token_counts
from .toxicity import op9_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_mixing": op5_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}
#: Where SQL can't express a query, or only by work that grows with the square of the input, tests have a brute force.
SQL = {"op1_sharding": OP1_SQL, "op7_line_dedup": OP7_SQL, "op8_decontamination": OP8_SQL}
