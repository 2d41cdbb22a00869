"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from isolates.llm.op1_toxicity import op1_toxicity
from isolates.llm.op2_wumanber import ORACLE as WINDOW_ORACLE
from isolates.llm.op2_wumanber import op2_decontamination
from isolates.llm.op3_sharding import op3_resharding
from isolates.llm.op4_langid import op4_language_id
from isolates.llm.op5_chunks import op5_substring_dedup
from isolates.llm.op6_packing import op6_packing
from isolates.llm.op7_quality import op7_quality
from isolates.llm.op8_bm25 import ORACLE as BM25_ORACLE
from isolates.llm.op8_bm25 import op8_bm25_search
from isolates.llm.op9_maxent import BASE_ORACLE, lm_base_scores, op9_lm_scoring
from isolates.llm.op10_simhash import op10_simhash
from isolates.llm.op11_dialogue import ORACLE as REPAIR_ORACLE
from isolates.llm.op11_dialogue import op11_conversation_repair
from isolates.llm.op12_minhash import ORACLE as MINHASH_ORACLE
from isolates.llm.op12_minhash import op12_minhash
from isolates.llm.op13_hybrid import ORACLE as RANKED_ORACLE
from isolates.llm.op13_hybrid import op13_ranked_search

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_resharding": op3_resharding,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_bm25_search": op8_bm25_search,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_simhash": op10_simhash,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_minhash": op12_minhash,
    "op13_ranked_search": op13_ranked_search,
    "lm_base_scores": lm_base_scores,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": WINDOW_ORACLE,
    "op8_bm25_search": BM25_ORACLE,
    "op11_conversation_repair": REPAIR_ORACLE,
    "op12_minhash": MINHASH_ORACLE,
    "op13_ranked_search": RANKED_ORACLE,
    "lm_base_scores": BASE_ORACLE,
}
