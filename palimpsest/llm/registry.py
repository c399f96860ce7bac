"""The queries of the corpus operators by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from palimpsest.llm.bpe import op8_bpe
from palimpsest.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from palimpsest.llm.language_id import op7_language_id
from palimpsest.llm.mixing import op10_mixing
from palimpsest.llm.near_dedup import op2_near_dedup
from palimpsest.llm.pii import op4_pii
from palimpsest.llm.quality import op3_quality
from palimpsest.llm.token_count import op9_token_count
from palimpsest.llm.topk import OP6_SQL, op6_topk
from palimpsest.llm.url_filter import OP5_SQL, op5_url_filter


def queries():
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_near_dedup": op2_near_dedup,
        "op3_quality": op3_quality,
        "op4_pii": op4_pii,
        "op5_url_filter": op5_url_filter,
        "op6_topk": op6_topk,
        "op7_language_id": op7_language_id,
        "op8_bpe": op8_bpe,
        "op9_token_count": op9_token_count,
        "op10_mixing": op10_mixing,
    }


def oracle_sql():
    return {"op1_exact_dedup": OP1_SQL, "op5_url_filter": OP5_SQL, "op6_topk": OP6_SQL}
