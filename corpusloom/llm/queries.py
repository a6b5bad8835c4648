"""The queries of this subpackage, by name, with their SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, covertree, frames, lengths, mixing, neardup, packing, pii, quality, secrets, variants, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_arc_to_warc": warc.op1_arc_to_warc,
        "op2_bpe_automaton": bpe.op2_bpe_automaton,
        "op3_mixture_raking": mixing.op3_mixture_raking,
        "op4_length_histogram": lengths.op4_length_histogram,
        "op5_token_frames": frames.op5_token_frames,
        "op6_secret_trigrams": secrets.op6_secret_trigrams,
        "op7_pii_boosting": pii.op7_pii_boosting,
        "op8_setsketch_neardup": neardup.op8_setsketch_neardup,
        "op9_cover_tree_top5": covertree.op9_cover_tree_top5,
        "op10_quality_ledger": quality.op10_quality_ledger,
        "op11_dynamic_collocations": collocations.op11_dynamic_collocations,
        "op12_gram_spelling_variants": variants.op12_gram_spelling_variants,
        "op13_sum_of_squares_packing": packing.op13_sum_of_squares_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_arc_to_warc": warc.OP1_SQL,
        "op8_setsketch_neardup": neardup.OP8_SQL,
        "op9_cover_tree_top5": covertree.OP9_SQL,
        "op10_quality_ledger": quality.OP10_SQL,
        "op11_dynamic_collocations": collocations.OP11_SQL,
    }
