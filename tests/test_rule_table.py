"""Rules as a table: both ways of matching against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from wellspring.operators import rule_table as table_module
from wellspring.operators.mud import PROGRAMS, mud_program, rule_table, with_mud_program
from wellspring.operators.rule_table import match_rules
from workloads.inputs import telemetry

RULES = "priority int, id int, low double, high double, small double, large double, kinds array<string>"
RANGES = {"x": ("low", "high"), "y": ("small", "large")}


def winner(row, rules):
    _, x, y, kind = row
    x = None if x is None or x != x else x
    met = []
    for rule in rules:
        priority, number, low, high, small, large, kinds = rule
        bounds = [(x, low, high), (y, small, large)]
        if any((a is not None and (v is None or v < a)) or (b is not None and (v is None or v >= b)) for v, a, b in bounds):
            continue
        if kinds is None or kind in kinds:
            met.append((priority, number))
    return min(met, default=None)


def cases(n_rules, seed):
    draw = random.Random(seed)
    some = lambda f: f() if draw.random() < 0.8 else None
    rules = []
    for i in range(n_rules):
        low = some(lambda: round(draw.uniform(0, 100), 1))
        rules.append((draw.randint(0, 20), i, low, some(lambda: round((low or 0.0) + draw.choice([0, 0.5, 3, 40]), 1)), some(lambda: draw.uniform(0, 5)),
                      some(lambda: draw.uniform(5, 9)), some(lambda: draw.sample("abc", draw.randint(0, 2)))))
    values = [None, float("nan"), -5.0, 0.0, 100.0, 1e9]
    rows = [(i, draw.choice(values) if draw.random() < 0.1 else round(draw.uniform(-1, 110), 1), some(lambda: draw.uniform(0, 9)), draw.choice(["a", "b", "d", None]))
            for i in range(400)]
    return rows, rules


@pytest.mark.parametrize("n_rules,few", [(0, 256), (3, 256), (3, 0), (1, 0), (60, 256), (60, 0), (500, 0)])
def test_one_rule_wins(spark, n_rules, few):
    rows, rules = cases(n_rules, n_rules + few)
    df = spark.createDataFrame(rows, "row int, x double, y double, kind string").repartition(3)
    found = match_rules(df, spark.createDataFrame(rules, RULES), RANGES, {"kind": "kinds"}, few_rules=few).collect()
    assert len(found) == len(rows)
    want = {r[0]: winner(r, rules) for r in rows}
    assert {r.row: r.rule and (r.rule.priority, r.rule.id) for r in found} == want


def test_unbounded_rules_and_repeated_rows(spark):
    rules = [(2, 1, None, None, None, None, None), (2, 0, None, None, None, None, None), (1, 5, 1.0, 2.0, None, None, [])]
    df = spark.createDataFrame([(1, 1.5, None, "a")] * 3 + [(2, None, None, None)], "row int, x double, y double, kind string")
    for few in (256, 0):
        found = match_rules(df, spark.createDataFrame(rules, RULES), RANGES, {"kind": "kinds"}, few_rules=few)
        assert [r.rule.id for r in found.collect()] == [0] * 4
    with pytest.raises(ValueError, match="rule"):
        match_rules(df.withColumn("rule", F.lit(1)), spark.createDataFrame(rules, RULES), RANGES)


def test_large_rule_tables_need_no_cross_join(spark, sf):
    rows, rules = cases(300, 1)
    df = spark.createDataFrame(rows, "row int, x double, y double, kind string")
    found = match_rules(df, spark.createDataFrame(rules, RULES), RANGES, {"kind": "kinds"}, few_rules=0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("few", [256, 0])
def test_programs_from_a_table_equal_the_constants(spark, sf, few):
    tel = telemetry(spark, sf).where("well_id < 4")
    c = F.col
    by_constant = tel.withColumn("mud", mud_program(c("depth_measured"), c("formation_type"), c("is_seal"), c("is_reservoir"), c("is_horizontal")))
    by_table = with_mud_program(tel, rule_table(spark, PROGRAMS), few_rules=few)
    assert by_table.columns == by_constant.columns
    assert by_constant.exceptAll(by_table).isEmpty() and by_table.count() == by_constant.count()


@pytest.mark.parametrize("most", [1, 20])
def test_rules_that_end_inside_an_interval(spark, monkeypatch, most):
    monkeypatch.setattr(table_module, "MOST_CUTS", most)
    rows, rules = cases(120, 7)
    df = spark.createDataFrame(rows, "row int, x double, y double, kind string").repartition(3)
    found = match_rules(df, spark.createDataFrame(rules, RULES), RANGES, {"kind": "kinds"}, few_rules=0).collect()
    assert {r.row: r.rule and (r.rule.priority, r.rule.id) for r in found} == {r[0]: winner(r, rules) for r in rows}


def test_rules_with_one_bound_meet_few_rows(spark, monkeypatch):
    """Half of the rules hold in a row, yet only the first of them may be looked at."""
    rules = [(i % 7, i, float(i % 50) if i % 2 else None, None if i % 2 else float(i % 50), None, 8.0 if i % 3 else None, None) for i in range(2000)]
    rows = [(i, i % 50 + 0.5, float(i % 9), "a") for i in range(1000)]
    met, join = [], table_module.null_safe_join

    def counted(left, right, keys, how="left", also=None):
        joined = join(left, right, keys, how, also)
        met.append(joined.count())
        return joined

    monkeypatch.setattr(table_module, "null_safe_join", counted)
    attach = table_module.attach_by_key
    monkeypatch.setattr(table_module, "attach_by_key", lambda *a, **o: [attach(*a, **o), met.append(attach(*a, **o).count())][0])
    df = spark.createDataFrame(rows, "row int, x double, y double, kind string")
    found = match_rules(df, spark.createDataFrame(rules, RULES), RANGES, {"kind": "kinds"}, few_rules=0).collect()
    assert {r.row: (r.rule.priority, r.rule.id) for r in found} == {r[0]: winner(r, rules) for r in rows}
    assert max(met) < 20 * len(rows)
