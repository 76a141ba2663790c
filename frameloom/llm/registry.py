"""The queries and SQL of the corpus operators, gathered from their modules.

Everything is imported here, so that whoever guards this import guards all of it.
"""

import corpus_pipeline  # beside the entry points
from frameloom.llm import op1_langid, op2_warc, op3_decontaminate, op4_topk, op5_mix, op6_paragraphs, op7_simhash, op8_suffix, op9_html, op10_secrets, op11_fim, op12_repair, op13_quality

MODULES = (op1_langid, op2_warc, op3_decontaminate, op4_topk, op5_mix, op6_paragraphs, op7_simhash, op8_suffix, op9_html, op10_secrets, op11_fim, op12_repair, op13_quality)


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run} | {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}) | {name: q for m in MODULES for name, q in m.ORACLES.items()}
