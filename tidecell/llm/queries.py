"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bottomk, decontam, html, infill, langid, merkle, mixing, paragraphs, pii, sharding, simhash, suffix, vafile
from .common import table
from .sql import ORACLES


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


QUERIES = {
    "op1_suffix": lambda s, d: suffix.report(_docs(s, d)),
    "op2_decontam": lambda s, d: decontam.report(_docs(s, d), table(s, d, "benchmark")),
    "op3_sharding": lambda s, d: sharding.assign(_docs(s, d).select("doc_id", "text")).drop("text"),
    "op4_mixing": lambda s, d: mixing.report(_docs(s, d)),
    "op7_html": lambda s, d: html.report(table(s, d, "pages")),
    "op8_langid": lambda s, d: langid.report(_docs(s, d)),
    "op9_vafile": lambda s, d: vafile.report(table(s, d, "embeddings")),
    "op5_paragraphs": lambda s, d: paragraphs.report(_docs(s, d)),
    "op10_simhash": lambda s, d: simhash.report(_docs(s, d)),
    "op6_pii": lambda s, d: pii.report(_docs(s, d)),
    "op13_bottomk": lambda s, d: bottomk.report(_docs(s, d)),
    "op11_merkle": lambda s, d: merkle.report(_docs(s, d)),
    "op12_infill": lambda s, d: infill.report(_docs(s, d)),
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
