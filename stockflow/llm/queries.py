"""The query of each text operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontaminate, fingerprints, html_extract, inner_products, language_id, lm_score, near_dup, packing, secrets, token_counts, vector_codes, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_secrets": secrets.op3_secrets,
    "op4_near_dup": near_dup.op4_near_dup,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_packing": packing.op6_packing,
    "op7_lm_score": lm_score.op7_lm_score,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_language_id": language_id.op9_language_id,
    "op10_html_text": html_extract.op10_html_text,
    "op11_collocations": collocations.op11_collocations,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_inner_products": inner_products.op13_inner_products,
}

ORACLES: dict[str, str] = {
    "op1_warc": warc.OP1_SQL,
    "op3_secrets": secrets.OP3_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_inner_products": inner_products.OP13_SQL,
}
