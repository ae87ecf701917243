"""Queries of the training-data operators and their DuckDB SQL."""

from .bpe import op8_bpe
from .decontaminate import OP3_SQL, op3_decontaminate
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .fill_middle import OP11_SQL, op11_fill_in_middle
from .importance import op12_importance
from .minhash import OP7_SQL, op7_near_dedup
from .passages import op9_fuzzy_passages
from .pii import op4_pii
from .quality import op13_quality
from .secrets import OP6_SQL, op6_secrets
from .suffix_dedup import op10_suffix_dedup
from .token_store import op2_token_store
from .toxicity import op5_toxicity

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_store": op2_token_store,
    "op3_decontaminate": op3_decontaminate,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_secrets": op6_secrets,
    "op7_near_dedup": op7_near_dedup,
    "op8_bpe": op8_bpe,
    "op9_fuzzy_passages": op9_fuzzy_passages,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_importance": op12_importance,
    "op13_quality": op13_quality,
}

ORACLES = {
    "op1_exact_dedup": OP1_SQL,
    "op3_decontaminate": OP3_SQL,
    "op6_secrets": OP6_SQL,
    "op7_near_dedup": OP7_SQL,
    "op11_fill_in_middle": OP11_SQL,
}
