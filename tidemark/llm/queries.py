"""The registered queries of this subpackage and, where SQL can express them, their equivalents."""

from __future__ import annotations

from tidemark.llm import chat, collocations, decontaminate, mixing, near_dedup, page_text, periodic, quality, repeats, sharding, simhash, token_files, warc

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_chat_prefixes": chat.op2_chat_prefixes,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_sharding": sharding.op4_sharding,
    "op5_mixing": mixing.op5_mixing,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_warc": warc.op7_warc,
    "op8_repeats": repeats.op8_repeats,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_page_text": page_text.op10_page_text,
    "op11_collocations": collocations.op11_collocations,
    "op12_simhash": simhash.op12_simhash,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
ORACLES = {"op2_chat_prefixes": chat.OP2_SQL, "op3_quality_rules": quality.OP3_SQL, "op5_mixing": mixing.OP5_SQL, "op6_decontaminate": decontaminate.OP6_SQL, "op7_warc": warc.OP7_SQL, "op8_repeats": repeats.OP8_SQL, "op10_page_text": page_text.OP10_SQL, "op11_collocations": collocations.OP11_SQL}
