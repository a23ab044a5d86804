"""The same queries on tables in which one user, part, supplier, order, customer and source holds a third of all rows."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from oracle import TABLES, compare, connect

HOT = {
    "events": "select * replace (case when event_id % 3 = 0 then 7 else user_id end as user_id) from events",
    "lineitem": """select * replace (case when l_orderkey % 3 = 0 then 3 else l_partkey end as l_partkey,
        case when l_quantity % 3 = 0 then 5 else l_suppkey end as l_suppkey,
        case when l_linenumber % 3 = 0 then 11 else l_orderkey end as l_orderkey) from lineitem""",
    "orders": "select * replace (case when o_orderkey % 3 = 0 then 2 else o_custkey end as o_custkey) from orders",
    "documents": "select * replace (case when doc_id % 3 = 0 then 'src1' else source end as source) from documents",
}
NAMES = """prompt_gap cell_gap saturation_curve bootstrap_ci sc_vote m_convergence validate_rectangular score_numeric pattern_rates
    score_boxed score_dispatch stdout_match json_match all_tests_pass majority_vote krippendorff_alpha position_bias l_sensitivity read_samples
    write_samples cache_partition read_verdict_log compute_budget resume_ledger union_subsets sample_worklist reverify index_cells
    pivot_models gpu_hours gap_by_bucket spike_by_bucket stream_verdict_dedup stream_cell_gap""".split()


@pytest.fixture(scope="module")
def hot_dir(tmp_path_factory):
    path = tmp_path_factory.mktemp("hot")
    con = connect("/root/testdata/sf0.001")
    for name in TABLES:
        con.execute(f"copy ({HOT.get(name, f'select * from {name}')}) to '{path}/{name}.parquet'")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys(spark, hot_dir, name):
    ok, note = compare(entry.queries()[name](spark, hot_dir), entry.oracle_sql()[name], connect(hot_dir))
    assert ok, note


# Plans as they are before statistics shrink anything: no broadcast by size.
@pytest.mark.parametrize("name", entry.queries())
def test_no_cross_join_and_no_row_wise_python(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"NestedLoopJoin|CartesianProduct|BatchEvalPython", plan)
