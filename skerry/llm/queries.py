"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from skerry.llm import chat, decontaminate
from skerry.llm.edits import op3_edited_counts
from skerry.llm.embeddings import op10_embedding_dedup
from skerry.llm.minhash import op8_minhash_dedup
from skerry.llm.packing import op7_packing
from skerry.llm.pii import op6_pii
from skerry.llm.records import op4_token_records
from skerry.llm.repeats import op2_repeated_passages
from skerry.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_repeated_passages": op2_repeated_passages,
    "op3_edited_counts": op3_edited_counts,
    "op4_token_records": op4_token_records,
    "op5_quote_links": chat.op5_quote_links,
    "op6_pii": op6_pii,
    "op7_packing": op7_packing,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_embedding_dedup": op10_embedding_dedup,
}
ORACLES: dict[str, str] = {
    "op5_quote_links": chat.ORACLE,
    "op9_decontamination": decontaminate.ORACLE,
}
