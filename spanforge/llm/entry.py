"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, cotraining, fingerprint, linededup, mixing, ngramjoin, packing, records, secrets, vafile


def queries():
    return {
        "op1_mix": mixing.op1_mix,
        "op2_fingerprint": fingerprint.op2_fingerprint,
        "op3_cotraining": cotraining.op3_cotraining,
        "op4_secrets": secrets.op4_secrets,
        "op5_records": records.op5_records,
        "op6_linededup": linededup.op6_linededup,
        "op7_chat": chat.op7_chat,
        "op8_ngramjoin": ngramjoin.op8_ngramjoin,
        "op9_packing": packing.op9_packing,
        "op10_vafile": vafile.op10_vafile,
    }


def oracle_sql():
    return {"op7_chat": chat.OP7_SQL, "op10_vafile": vafile.OP10_SQL}
