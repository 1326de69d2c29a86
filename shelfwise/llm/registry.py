"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import collocations, decontamination, fill_in_middle, licences, near_duplicates, packing, personal_data, quality, repeats, revisits, scoring, url_filter, wavelet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_trust_propagation": url_filter.op1,
    "op2_sum_of_squares_packing": packing.op2,
    "op3_wavelet_shards": wavelet.op3,
    "op4_revisit_resolution": revisits.op4,
    "op5_licence_index": licences.op5,
    "op6_context_mixing": scoring.op6,
    "op7_compression_bands": quality.op7,
    "op8_deep_shallow_repeats": repeats.op8,
    "op9_suffix_automaton": decontamination.op9,
    "op10_tensored_minhash": near_duplicates.op10,
    "op11_branch_and_bound_collocations": collocations.op11,
    "op12_checked_personal_data": personal_data.op12,
    "op13_skip_list_fill_in_middle": fill_in_middle.op13,
}

ORACLES: dict[str, str] = {
    "op4_revisit_resolution": revisits.ORACLE,
    "op11_branch_and_bound_collocations": collocations.ORACLE,
    "op13_skip_list_fill_in_middle": fill_in_middle.ORACLE,
}
