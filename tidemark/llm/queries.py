"""The queries of this subpackage by name."""

from __future__ import annotations

from .fill_in_middle import OP11_SQL, op11_fill_in_middle
from .fingerprints import op3_fingerprints
from .mixing import OP10_SQL, op10_mixing
from .near_duplicates import op9_minhash
from .packing import op2_packing
from .quality import op13_quality
from .repeats import op1_repeats
from .secrets import op7_secrets
from .token_counts import op5_token_counts
from .token_files import op6_token_files
from .topk import OP4_SQL, op4_top_k
from .toxicity import op8_toxicity
from .whitening import op12_whitening

QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_packing": op2_packing,
    "op3_fingerprints": op3_fingerprints,
    "op4_top_k": op4_top_k,
    "op5_token_counts": op5_token_counts,
    "op6_token_files": op6_token_files,
    "op7_secrets": op7_secrets,
    "op8_toxicity": op8_toxicity,
    "op9_minhash": op9_minhash,
    "op10_mixing": op10_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_whitening": op12_whitening,
    "op13_quality": op13_quality,
}

ORACLE_SQL: dict[str, str] = {"op4_top_k": OP4_SQL, "op10_mixing": OP10_SQL, "op11_fill_in_middle": OP11_SQL}
