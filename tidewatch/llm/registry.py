"""The queries of this subpackage and, where SQL can state the result, the DuckDB text."""

from __future__ import annotations

from tidewatch.llm import decontaminate, embed_dedup, mixing, ngram_join, pii, quality, secrets, tokenout, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_pii": pii.query,
    "op3_decontaminate": decontaminate.query,
    "op4_embed_dedup": embed_dedup.query,
    "op5_warc": warc.query,
    "op6_mixing": mixing.query,
    "op7_ngram_join": ngram_join.query,
    "op8_secrets": secrets.query,
    "op9_quality": quality.query,
    "op10_tokens": tokenout.query,
}

ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op3_decontaminate": decontaminate.ORACLE,
    "op4_embed_dedup": embed_dedup.ORACLE,
    "op5_warc": warc.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op7_ngram_join": ngram_join.ORACLE,
}
