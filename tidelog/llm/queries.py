"""Registered queries of the corpus operators."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, edit_embedding, licences, packing, pieces, quality, set_join, sharding, suffix_dedup, warc
from .common import Query, table


def queries() -> dict[str, Query]:
    docs = lambda operator: lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))
    return {
        "op1_packing": docs(packing.op1),
        "op2_set_join": docs(set_join.op2),
        "op3_pieces": docs(pieces.op3),
        "op4_licences": docs(licences.op4),
        "op5_suffix_dedup": docs(suffix_dedup.op5),
        "op6_decontaminate": lambda spark, sf_dir: decontaminate.op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op7_quality": lambda spark, sf_dir: quality.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op8_edit_embedding": docs(edit_embedding.op8),
        "op9_warc": lambda spark, sf_dir: warc.op9(table(spark, sf_dir, "pages")),
        "op10_sharding": docs(sharding.op10),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """For the operators that SQL can express; the others are tested against versions of their own in tests/llm."""
    return {"op2_set_join": set_join.oracle(), "op4_licences": licences.oracle(), "op5_suffix_dedup": suffix_dedup.oracle(), "op9_warc": warc.oracle()}
