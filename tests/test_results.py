"""Query results against their SQL twins.

The default run takes a cross-section; SKYCADENCE_ALL=1 runs every query.
"""

import os

import pytest
from compare import compare, open_tables

from skycadence.plans.catalog import CATALOG

CHECKED = [n for n, q in CATALOG.items() if q.sql]
CROSS_SECTION = ["smart_persistence_skill", "recipe_50_features", "rsm_10min_bins", "grd_hourly_grid", "ddp_priority", "jn_interval_aggregate", "jn_asof_on_grid",
                 "win_min_periods", "win_runs", "anc_rule_flags", "seg_windows_inside", "spl_walk_forward_counts", "qc_repair_diffuse", "qc_cross_correlation",
                 "imp_segment_fill", "cal_rolling_corrections", "sig_pair_tests", "agg_exact_quantiles", "snk_incremental_append", "str_tumbling_bins", "ml_analog_ensemble",
                 "ml_sums_table", "cmp_add_one", "cmp_seeds", "evl_season_models", "ml_target_statistics", "ml_quantile_histogram"]


@pytest.fixture(scope="module")
def con(sf01):
    return open_tables(sf01)


@pytest.mark.parametrize("name", CHECKED if os.environ.get("SKYCADENCE_ALL") else CROSS_SECTION)
def test_equals_sql(spark, con, sf01, name):
    assert compare(CATALOG[name](spark, sf01), con, CATALOG[name].sql) is None


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.sql])
def test_builds_on_the_smallest_tables(spark, name):
    assert CATALOG[name](spark, "/root/testdata/sf0.001").columns


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if not q.sql])
def test_runs_without_a_twin(spark, sf01, name):
    assert CATALOG[name](spark, sf01).count() > 0
