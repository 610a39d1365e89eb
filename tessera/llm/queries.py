"""Queries of this package by name, and their SQL where there is one."""

from __future__ import annotations

from tessera.llm import ann, chat, decontaminate, langid, mixing, passages, simhash, tokens, urls, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_warc": warc.op2_warc,
    "op3_passages": passages.op3_passages,
    "op4_ann": ann.op4_ann,
    "op5_urls": urls.op5_urls,
    "op6_tokens": tokens.op6_tokens,
    "op7_chat": chat.op7_chat,
    "op8_simhash": simhash.op8_simhash,
    "op9_mixing": mixing.op9_mixing,
    "op10_langid": langid.op10_langid,
}
SQL = {"op2_warc": warc.OP2_SQL, "op4_ann": ann.OP4_SQL, "op7_chat": chat.OP7_SQL, "op9_mixing": mixing.OP9_SQL}
