"""Queries of this subpackage and the SQL that gives the same rows, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cap_filters, infill, language_id, licenses, mixing, near_dups, packing, quality, runs, secrets, token_counts, token_output, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": mixing.op1,
        "op2_token_output": token_output.op2,
        "op3_minmax_near_dups": near_dups.op3,
        "op4_secret_scan": secrets.op4,
        "op5_voronoi_topk": topk.op5,
        "op6_cap_filter_links": cap_filters.op6,
        "op7_prefix_token_counts": token_counts.op7,
        "op8_best_fit_packing": packing.op8,
        "op9_language_id": language_id.op9,
        "op10_quality": quality.op10,
        "op11_fill_in_middle": infill.op11,
        "op12_periodic_runs": runs.op12,
        "op13_license_scan": licenses.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.SQL, "op3_minmax_near_dups": near_dups.SQL, "op5_voronoi_topk": topk.SQL, "op6_cap_filter_links": cap_filters.SQL, "op11_fill_in_middle": infill.SQL}
