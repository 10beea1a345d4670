"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import (
    chat_format, decontamination, gif_media, jaccard_join, language_id, license_scan, line_dedup, merkle_manifest, page_text, piece_bpe, secrets,
    tiered_search, toxicity,
)

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_piece_bpe": piece_bpe.op3_piece_bpe,
    "op4_language_id": language_id.op4_language_id,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_gif_media": gif_media.op10_gif_media,
    "op11_page_text": page_text.op11_page_text,
    "op12_tiered_search": tiered_search.op12_tiered_search,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}

SQL = {
    "op2_decontamination": decontamination.OP2_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op6_chat_format": chat_format.OP6_SQL,
    "op12_tiered_search": tiered_search.OP12_SQL,
    "op13_merkle_manifest": merkle_manifest.OP13_SQL,
}
