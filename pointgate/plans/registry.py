"""Named queries and their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointgate.session import ship

Query = Callable[[SparkSession, str], DataFrame]

#: Columns that DuckDB counts in a wider type than a 64-bit integer.
COUNTS = {
    "answers_ingest": ["unknown", "out_of_range", "duplicates"], "future_dates": ["not_before_gate"], "probability_diagnostics": ["confident_wrong", "extreme"], "value_ledger": ["over50", "over25"],
    "claim_lift_sets": ["n_c", "k_c", "n_u", "k_u"], "usage_rollup": ["returned"], "distribution_profile": ["tier1", "tier2"], "band_audit": ["n_kept"], "classifier_metrics": ["tp", "fp", "fn"],
    "pivot_summary": ["f_n", "o_n"], "sequence_windows": ["repeats"], "episode_state": ["lookups"], "array_feasibility": ["missing", "bench"], "contender_registry": ["hits"],
    "flag_join": ["unmatched", "flagged", "flagged_hits", "others", "other_hits"], "accuracy_gap": ["unranked"], "answer_files": ["unknown", "out_of_range", "duplicates", "kept"],
}

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the DuckDB statement with the same result."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql and name in COUNTS:
            SQL[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in COUNTS[name])}) FROM ({sql})"
        elif sql:
            SQL[name] = sql
        return f

    return add
