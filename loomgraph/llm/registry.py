"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import align, chat, decontam, language, linededup, mixing, neardup, neighbours, pii, quality, repair, sharding, tokens


def queries() -> dict:
    return {
        "op1_shards": sharding.op1_shards,
        "op2_language": language.op2_language,
        "op3_token_ids": tokens.op3_token_ids,
        "op4_chat": chat.op4_chat,
        "op5_quality": quality.op5_quality,
        "op6_pii": pii.op6_pii,
        "op7_neardup": neardup.op7_neardup,
        "op8_mix": mixing.op8_mix,
        "op9_neighbours": neighbours.op9_neighbours,
        "op10_decontam": decontam.op10_decontam,
        "op11_align": align.op11_align,
        "op12_line_dedup": linededup.op12_line_dedup,
        "op13_repair": repair.op13_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": chat.ORACLE_SQL, "op12_line_dedup": linededup.ORACLE_SQL, "op13_repair": repair.ORACLE_SQL}
