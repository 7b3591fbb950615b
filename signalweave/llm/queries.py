"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import audit, decontaminate, licenses, manifest, media, mixing, neardup, packing, quality, suffix, urls, warc, wordpiece

QUERIES = {
    "op1_minhash_neardup": neardup.op1_minhash_neardup,
    "op2_media_columns": media.op2_media_columns,
    "op3_packing": packing.op3_packing,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_url_filters": urls.op6_url_filters,
    "op7_suffix_dedup": suffix.op7_suffix_dedup,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_warc_revisits": warc.op9_warc_revisits,
    "op10_token_counts": wordpiece.op10_token_counts,
    "op11_source_mixing": mixing.op11_source_mixing,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
}
ORACLES: dict[str, str] = {
    "op1_minhash_neardup": neardup.OP1_SQL,
    "op5_license_scan": licenses.OP5_SQL,
    "op6_url_filters": urls.OP6_SQL,
    "op7_suffix_dedup": suffix.OP7_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
    "op9_warc_revisits": warc.OP9_SQL,
    "op11_source_mixing": mixing.OP11_SQL,
    "op12_filter_audit": audit.OP12_SQL,
    "op13_merkle_manifest": manifest.OP13_SQL,
}
