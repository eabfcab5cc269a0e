"""Operators for training data. Nothing else in the library imports this package."""

from __future__ import annotations

from . import collocation, fingerprint, html, language, matroska, mixing, pieces, quality, simhash, toxicity, urls, vector_codes, warc

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_html": html.query,
    "op3_fingerprint": fingerprint.query,
    "op4_quality": quality.query,
    "op5_simhash": simhash.query,
    "op6_sentencepiece": pieces.query,
    "op7_matroska": matroska.query,
    "op8_language": language.query,
    "op9_warc": warc.query,
    "op10_toxicity": toxicity.query,
    "op11_urls": urls.query,
    "op12_collocation": collocation.query,
    "op13_vector_codes": vector_codes.query,
}
ORACLES = {"op1_mixing": mixing.SQL, "op9_warc": warc.SQL, "op12_collocation": collocation.SQL, "op13_vector_codes": vector_codes.SQL}
