"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from graphloom.llm.chat import op3_chat_format
from graphloom.llm.decontaminate import OP10_SQL, op10_decontaminate
from graphloom.llm.packing import op4_pack
from graphloom.llm.pii import op7_pii
from graphloom.llm.simhash import op2_simhash
from graphloom.llm.suffix_dedup import op1_suffix_dedup
from graphloom.llm.token_counts import op6_token_counts
from graphloom.llm.token_files import op5_token_files
from graphloom.llm.topk import OP9_SQL, op9_topk
from graphloom.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_simhash": op2_simhash,
    "op3_chat_format": op3_chat_format,
    "op4_pack": op4_pack,
    "op5_token_files": op5_token_files,
    "op6_token_counts": op6_token_counts,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_topk": op9_topk,
    "op10_decontaminate": op10_decontaminate,
}
ORACLES: dict[str, str] = {"op9_topk": OP9_SQL, "op10_decontaminate": OP10_SQL}
