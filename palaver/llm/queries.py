"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from palaver.llm import chat, decontaminate, langid, lattice, licenses, minhash, packing, quality, urls, warc


def queries():
    return {
        "pipeline": corpus_pipeline.run,
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_warc": warc.op2_warc,
        "op3_packing": packing.op3_packing,
        "op4_chat_format": chat.op4_chat_format,
        "op5_quality": quality.op5_quality,
        "op6_near_dedup": minhash.op6_near_dedup,
        "op7_license_scan": licenses.op7_license_scan,
        "op8_language": langid.op8_language,
        "op9_url_filter": urls.op9_url_filter,
        "op10_embedding_dedup": lattice.op10_embedding_dedup,
    }


def oracle_sql():
    return {"op9_url_filter": urls.SQL, "op10_embedding_dedup": lattice.SQL}
