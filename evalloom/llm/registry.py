"""Queries and SQL of the corpus operators."""

from __future__ import annotations

import corpus_pipeline
from evalloom.llm import bpe, imatch, langid, mixing, negatives, nndescent, pst, pstable, quality, simhash, toxicity, training_order, whitening


def queries() -> dict:
    return {
        "op1_quality_gam": quality.op1_quality_gam,
        "op2_suffix_tree_scoring": pst.op2_suffix_tree_scoring,
        "op3_source_mixing": mixing.op3_source_mixing,
        "op4_embedding_near_dedup": nndescent.op4_embedding_near_dedup,
        "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
        "op6_training_order": training_order.op6_training_order,
        "op7_byte_level_bpe": bpe.op7_byte_level_bpe,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_language_bigru": langid.op9_language_bigru,
        "op10_imatch_fingerprints": imatch.op10_imatch_fingerprints,
        "op11_norm_bucket_negatives": negatives.op11_norm_bucket_negatives,
        "op12_multiprobe_neighbours": pstable.op12_multiprobe_neighbours,
        "op13_embedding_whitening": whitening.op13_embedding_whitening,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    known = {"op4_embedding_near_dedup": nndescent.OP4_SQL, "op11_norm_bucket_negatives": negatives.OP11_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in known.items() if sql}
