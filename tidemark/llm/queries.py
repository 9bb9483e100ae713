"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html_extract, language_id, mixing, near_dedup, phrases, pitman_yor, quality, secrets, spelling, suffix_dedup, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_pitman_yor": pitman_yor.op2_pitman_yor,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_repeats": suffix_dedup.op4_repeats,
    "op5_warc": warc.op5_warc,
    "op6_bpe": bpe.op6_bpe,
    "op7_secrets": secrets.op7_secrets,
    "op8_html_text": html_extract.op8_html_text,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_mixing": mixing.op10_mixing,
    "op11_collocations": phrases.op11_collocations,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_language_id": language_id.op13_language_id,
}

SQL: dict[str, str] = {
    "op1_quality": quality.OP1_SQL,
    "op5_warc": warc.OP5_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_collocations": phrases.OP11_SQL,
}
