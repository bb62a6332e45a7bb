"""The registered queries of this package and their SQL."""

from __future__ import annotations

from claimspark.llm.bpe import op5_bpe
from claimspark.llm.conversations import OP12_SQL, op12_conversation_repair
from claimspark.llm.decontamination import OP3_SQL, op3_decontamination
from claimspark.llm.exact import OP13_SQL, op13_exact_dedup
from claimspark.llm.fingerprints import op6_fingerprints
from claimspark.llm.language import op4_language_id
from claimspark.llm.minhash import OP7_SQL, op7_minhash_dedup
from claimspark.llm.pii import op9_pii
from claimspark.llm.quality import op2_quality_classifier
from claimspark.llm.sharding import OP1_SQL, op1_sharding
from claimspark.llm.token_counts import op10_token_counts
from claimspark.llm.toxicity import op8_toxicity
from claimspark.llm.vectors import OP11_SQL, op11_vector_codes

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_decontamination": op3_decontamination,
    "op5_bpe": op5_bpe,
    "op6_fingerprints": op6_fingerprints,
    "op4_language_id": op4_language_id,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_token_counts": op10_token_counts,
    "op11_vector_codes": op11_vector_codes,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_exact_dedup": op13_exact_dedup,
}
ORACLES: dict[str, str] = {
    "op1_sharding": OP1_SQL,
    "op3_decontamination": OP3_SQL,
    "op7_minhash_dedup": OP7_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
    "op13_exact_dedup": OP13_SQL,
}
