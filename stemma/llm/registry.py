"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from stemma.llm import chat, chunks, langid, linededup, mixing, pieces, quality, sharding, simhash, urls

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_urls": urls.op2_urls,
    "op3_chat": chat.op3_chat,
    "op4_quality": quality.op4_quality,
    "op5_mixing": mixing.op5_mixing,
    "op6_chunks": chunks.op6_chunks,
    "op7_sharding": sharding.op7_sharding,
    "op8_pieces": pieces.op8_pieces,
    "op9_langid": langid.op9_langid,
    "op10_linededup": linededup.op10_linededup,
}

ORACLES = {
    "op3_chat": chat.OP3_SQL,
    "op7_sharding": sharding.OP7_SQL,
    "op10_linededup": linededup.OP10_SQL,
}
