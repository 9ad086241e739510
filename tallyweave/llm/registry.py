"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from . import decontamination, embedding_links, lm_scores, merkle, personal_data, quality, secret_scan, vector_codes, weighted_minhash
from .decontamination import op6_decontamination
from .embedding_links import op3_embedding_links
from .lm_scores import op8_lm_scores
from .merkle import op12_manifest
from .packing import op7_packing
from .personal_data import op4_personal_data
from .quality import op11_quality
from .secret_scan import op10_secret_scan
from .shards import op9_shards
from .token_counts import op2_token_counts
from .toxicity import op1_toxicity
from .vector_codes import op13_vector_codes
from .weighted_minhash import op5_near_duplicates


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_embedding_links, op4_personal_data, op5_near_duplicates, op6_decontamination, op7_packing, op8_lm_scores, op9_shards, op10_secret_scan, op11_quality, op12_manifest, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    modules = {
        "op3_embedding_links": embedding_links, "op4_personal_data": personal_data, "op5_near_duplicates": weighted_minhash, "op6_decontamination": decontamination,
        "op8_lm_scores": lm_scores, "op10_secret_scan": secret_scan, "op11_quality": quality, "op12_manifest": merkle, "op13_vector_codes": vector_codes,
    }
    return {name: m.ORACLE for name, m in modules.items()}
