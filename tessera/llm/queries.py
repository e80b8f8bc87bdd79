"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import exact, langid, media, mixing, packing, quality, runindex, sharding, simhash, substring


def queries():
    return {
        "op1_ordinal": quality.op1_ordinal,
        "op2_webp": media.op2_webp,
        "op3_best_fit": packing.op3_best_fit,
        "op4_rabin_karp": substring.op4_rabin_karp,
        "op5_simhash": simhash.op5_simhash,
        "op6_exact": exact.op6_exact,
        "op7_run_index": runindex.op7_run_index,
        "op8_virtual_slots": sharding.op8_virtual_slots,
        "op9_systematic": mixing.op9_systematic,
        "op10_crf": langid.op10_crf,
    }


def oracle_sql():
    return {
        "op4_rabin_karp": substring.OP4_SQL,
        "op6_exact": exact.OP6_SQL,
        "op7_run_index": runindex.OP7_SQL,
        "op8_virtual_slots": sharding.OP8_SQL,
        "op9_systematic": mixing.OP9_SQL,
    }
