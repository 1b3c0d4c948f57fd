"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import op01_mix, op02_quality, op03_shards, op04_toxicity, op05_substrings, op06_media, op07_decontaminate, op08_urls, op09_neardup, op10_html, op11_bpe, op12_resample, op13_align

QUERIES = {
    "op1_mix": op01_mix.op1_mix,
    "op2_quality": op02_quality.op2_quality,
    "op3_shards": op03_shards.op3_shards,
    "op4_toxicity": op04_toxicity.op4_toxicity,
    "op5_substrings": op05_substrings.op5_substrings,
    "op6_media": op06_media.op6_media,
    "op7_decontaminate": op07_decontaminate.op7_decontaminate,
    "op8_url_filter": op08_urls.op8_url_filter,
    "op9_neardup": op09_neardup.op9_neardup,
    "op10_html": op10_html.op10_html,
    "op11_bpe": op11_bpe.op11_bpe,
    "op12_resample": op12_resample.op12_resample,
    "op13_align": op13_align.op13_align,
}
ORACLE_SQL = {
    "op5_substrings": op05_substrings.ORACLE_SQL,
    "op7_decontaminate": op07_decontaminate.ORACLE_SQL,
    "op8_url_filter": op08_urls.ORACLE_SQL,
    "op9_neardup": op09_neardup.ORACLE_SQL,
}
