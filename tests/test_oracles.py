"""Every query with SQL gives DuckDB's rows, and few give none."""

import pytest
from support import same_as_sql

from quarry import queries

MAY_BE_EMPTY = {"hexlike_values", "text_intel", "rule_hits", "unknown_types", "containment_semi", "hash_duplicates", "duplicate_top_boxes", "interval_gaps", "box_anomalies", "arg_min_choice", "quality_gate", "patch_overlap", "flash_frames_semi", "frozen_runs"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(name, spark, duck):
    n = same_as_sql(queries.QUERIES[name], queries.ORACLES[name], spark, duck)
    assert n or name in MAY_BE_EMPTY


def test_container_findings_find_what_was_planted(spark):
    from support import SF

    rows = queries.QUERIES["container_findings"](spark, SF).collect()
    by_rule = {(r.rule_id, r.severity, int(r.video_id) % 5) for r in rows}
    assert ("R8", "HIGH", 1) in by_rule and ("R8", "INFO", 0) in by_rule
    assert ("R2", "HIGH", 3) in by_rule and ("R9", "HIGH", 2) in by_rule and ("R7", "MED", 2) in by_rule
    assert not any(rule == "R8" and severity == "HIGH" and k != 1 for rule, severity, k in by_rule)
