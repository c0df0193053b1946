"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, chat_format, embedding_dedup, hard_negatives, html_text, mixing, quality, simhash, spelling, toxicity, training_order, url_filter, warc
from .common import table


def op10(spark, sf_dir: str):
    found = simhash.near_classes(table(spark, sf_dir, "documents"))
    return found.select(found["id"].alias("doc_id"), simhash.hex16(found["fp"]).alias("fingerprint"), found["component"].alias("component_id"))


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1,
        "op2_quality_rules": quality.op2,
        "op3_url_filters": url_filter.op3,
        "op4_warc": warc.op4,
        "op5_toxicity": toxicity.op5,
        "op6_embedding_dedup": embedding_dedup.op6,
        "op7_bpe": bpe.op7,
        "op8_training_order": training_order.op8,
        "op9_html_text": html_text.op9,
        "op10_simhash": op10,
        "op11_chat_format": chat_format.op11,
        "op12_hard_negatives": hard_negatives.op12,
        "op13_spelling": spelling.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.OP1_SQL,
        "op2_quality_rules": quality.OP2_SQL,
        "op3_url_filters": url_filter.OP3_SQL,
        "op4_warc": warc.OP4_SQL,
        "op6_embedding_dedup": embedding_dedup.OP6_SQL,
        "op11_chat_format": chat_format.OP11_SQL,
        "op12_hard_negatives": hard_negatives.OP12_SQL,
        "op13_spelling": spelling.OP13_SQL,
    }
