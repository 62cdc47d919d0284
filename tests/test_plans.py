"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wellspring.operators.combination_rules import flag_combinations, rule_counts
from wellspring.operators.ordered import running_totals
from wellspring.operators.outliers import flag_outliers
from wellspring.vocabulary import to_canonical
from workloads.inputs import table, telemetry

# Streams and model runs write their results before the plan returned here begins.
LAZY = [n for n in entry.queries() if not n.startswith(("stream_", "impute_", "classifier", "damage_classifier", "clusters",
                                                        "processing", "isolation", "split_sink", "quantile_table"))]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text: str) -> set[str]:
    return {c.split(":")[0] for part in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in part.split(",")}


@pytest.mark.parametrize("name", LAZY)
def test_no_row_by_row_joins_or_python(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert word not in text, f"{word} in {name}"


def test_scans_read_only_what_is_needed(spark, sf):
    text = plan(rule_counts(telemetry(spark, sf).select("formation_type", "formation_permeability")))
    assert read_columns(text) == {"l_partkey"}
    flagged = flag_outliers(table(spark, sf, "lineitem"), ["l_quantity"], ["l_suppkey"])
    assert read_columns(plan(flagged.groupBy("l_suppkey").agg(F.count_if("is_outlier")))) >= {"l_suppkey", "l_quantity"}
    assert "l_extendedprice" not in plan(flagged.groupBy("l_suppkey").agg(F.count_if("is_outlier")))


def test_filters_reach_the_scan(spark, sf):
    renamed = to_canonical(table(spark, sf, "lineitem").withColumnRenamed("l_quantity", "Viscosity_cP"))
    text = plan(flag_combinations(renamed).where("viscosity > 49 AND l_returnflag = 'A'"))
    assert "GreaterThan(l_quantity,49.0)" in text and "EqualTo(l_returnflag,A)" in text


def test_rules_shuffle_nothing(spark, sf):
    assert "Exchange" not in plan(flag_combinations(telemetry(spark, sf)))


def test_running_totals_have_no_join_and_partition_by_run(spark, sf):
    text = plan(running_totals(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], {"t": F.col("value")}, rows_per_run=100))
    assert "Join" not in text
    assert re.search(r"hashpartitioning\(user_id#\d+L, _run#\d+", text)
