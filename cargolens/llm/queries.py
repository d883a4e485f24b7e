"""The corpus queries and their SQL twins."""

from __future__ import annotations

from cargolens.llm.decontaminate import op9_decontaminate
from cargolens.llm.language import op5_language
from cargolens.llm.lm_score import op4_lm_score
from cargolens.llm.packing import op2_packing
from cargolens.llm.pii import op10_pii
from cargolens.llm.quality import op8_quality
from cargolens.llm.secret_scan import OP1_SQL, op1_secret_scan
from cargolens.llm.simhash import op3_simhash
from cargolens.llm.tokens import op7_token_count
from cargolens.llm.url_filter import OP6_SQL, op6_url_filter

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_lm_score": op4_lm_score,
    "op5_language": op5_language,
    "op6_url_filter": op6_url_filter,
    "op7_token_count": op7_token_count,
    "op8_quality": op8_quality,
    "op9_decontaminate": op9_decontaminate,
    "op10_pii": op10_pii,
}
ORACLES = {"op1_secret_scan": OP1_SQL, "op6_url_filter": OP6_SQL}
