"""The dealt queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from hopgraph.llm.chat import OP7_SQL, op7_chat_format
from hopgraph.llm.decontaminate import OP1_SQL, op1_contamination
from hopgraph.llm.dialogue import OP13_SQL, op13_repair
from hopgraph.llm.html import op6_main_text
from hopgraph.llm.merkle import OP12_SQL, op12_manifest
from hopgraph.llm.pack import op5_packing
from hopgraph.llm.ppm import op4_lm_score
from hopgraph.llm.quality import op3_quality
from hopgraph.llm.repeats import OP10_SQL, op10_repeats
from hopgraph.llm.shard import OP8_SQL, op8_sharding
from hopgraph.llm.simhash import op2_near_duplicates
from hopgraph.llm.topk import OP9_SQL, op9_top_k
from hopgraph.llm.toxicity import op11_toxicity

QUERIES = {
    "op1_contamination": op1_contamination,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_quality": op3_quality,
    "op4_lm_score": op4_lm_score,
    "op5_packing": op5_packing,
    "op6_main_text": op6_main_text,
    "op7_chat_format": op7_chat_format,
    "op8_sharding": op8_sharding,
    "op9_top_k": op9_top_k,
    "op10_repeats": op10_repeats,
    "op11_toxicity": op11_toxicity,
    "op12_manifest": op12_manifest,
    "op13_repair": op13_repair,
}

SQL = {
    "op1_contamination": OP1_SQL,
    "op7_chat_format": OP7_SQL,
    "op8_sharding": OP8_SQL,
    "op9_top_k": OP9_SQL,
    "op10_repeats": OP10_SQL,
    "op12_manifest": OP12_SQL,
    "op13_repair": OP13_SQL,
}
