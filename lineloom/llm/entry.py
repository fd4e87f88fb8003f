"""The corpus operators' queries over their whole tables, and their SQL where there is any."""

from __future__ import annotations

from lineloom.llm import op1_warc, op2_ngram_join, op3_chat, op4_line_dedup, op5_pii, op6_html, op7_langid, op8_mixing, op9_exact_dedup, op10_decontam

MODULES = (op1_warc, op2_ngram_join, op3_chat, op4_line_dedup, op5_pii, op6_html, op7_langid, op8_mixing, op9_exact_dedup, op10_decontam)

QUERIES = {(name := m.__name__.rpartition(".")[2]): getattr(m, name) for m in MODULES}
ORACLES = {m.__name__.rpartition(".")[2]: m.ORACLE for m in MODULES if hasattr(m, "ORACLE")}
