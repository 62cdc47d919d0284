"""Matching rows against a table of rules with nullable bounds; one rule wins.

A rule has a priority, for some row columns a lower and an upper bound, and for some a list of allowed values. A null
bound or list asks nothing. The rule of the lowest priority whose conditions all hold is attached; among equal
priorities the least in its other columns.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.functions.nulls import holds, nan_to_null, number
from wellspring.operators.keyed import attach_by_key, fits_broadcast, null_safe_join
from wellspring.session import settle

FEW_RULES = 256
MOST_CUTS = 4096
RULES_PER_CUT = 8
AXES = 2
ANYWHERE = -1
EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)  # doubles tell their bounds apart, up to 2^53

Ranges = Mapping[str, tuple[str, str]]
Lists = Mapping[str, str]


def match_rules(rows: DataFrame, rules: DataFrame, ranges: Ranges, lists: Lists | None = None, priority: str = "priority",
                name: str = "rule", few_rules: int = FEW_RULES) -> DataFrame:
    """Add the winning rule as a struct ``name`` of all columns of ``rules``; null where no rule holds.

    ``ranges`` maps a row column to the rule's columns for its bounds (lower <= value < upper), ``lists`` to the column
    of allowed values. An unknown value, NaN included, meets no condition, so only rules without one on that column hold.

    Up to ``few_rules`` rules travel to the rows as one sorted array in which the first that holds is taken: one pass
    and no shuffle. More rules are placed on two axes, the first two ranges: cuts at their bounds make intervals, and a rule
    stands at the few nodes of a binary tree over them that make up its range. Of the rules at a node of both axes with the
    same allowed value the first one is kept, and rows in the same intervals with the same value ask together, so the work
    does not grow with the number of rules that hold in a row. With more than ``MOST_CUTS`` different bounds on an axis
    the cuts are quantiles, and rules that end inside an interval are compared with the rows in it. Conditions on
    further ranges and lists are compared with all rows at a node of the first range, so put those that most rules ask first.
    """
    lists = dict(lists or {})
    rules = settle(nan_to_null(rules))
    clash = [c for c in (name, "_row", "_rows", "_rules", "_rank", "_of", "_at0", "_at1", "_n0", "_m") if c in rows.columns]
    if clash:
        raise ValueError(f"rows already have {', '.join(clash)}")
    total = rules.count()
    if total <= few_rules and fits_broadcast(rules):
        return _by_array(rows, rules, ranges, lists, priority, name)
    return _by_tree(rows, rules, ranges, lists, priority, name, total)


def _ordered(rules: DataFrame, priority: str) -> Column:
    """A rule with its priority first, so that the least struct wins."""
    return F.struct(F.col(f"`{priority}`").alias("_first"), F.struct(*[F.col(f"`{c}`") for c in rules.columns]).alias("_rule"))


def _holds(rule: Column, ranges: Ranges, lists: Lists) -> Column:
    met = F.lit(True)
    for column, (low, high) in ranges.items():
        value = number(F.col(f"`{column}`"))
        met = met & (rule[low].isNull() | (value >= rule[low])) & (rule[high].isNull() | (value < rule[high]))
    for column, allowed in lists.items():
        met = met & (rule[allowed].isNull() | F.array_contains(rule[allowed], F.col(f"`{column}`")))
    return holds(met)


def _by_array(rows: DataFrame, rules: DataFrame, ranges: Ranges, lists: Lists, priority: str, name: str) -> DataFrame:
    known = rules.agg(F.array_sort(F.collect_list(_ordered(rules, priority))))
    first = F.get(F.filter("_rules", lambda r: _holds(r["_rule"], ranges, lists)), 0)
    return rows.withColumn("_rules", known.scalar()).withColumn(name, first["_rule"]).drop("_rules")


def _array(cuts: Sequence[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")


def _interval(value: Column, cuts: Sequence[float]) -> Column:
    """How many of the sorted cuts are not above the value, by halving; null for an unknown value."""
    array, size = _array(cuts), len(cuts)
    steps = [1 << k for k in reversed(range(size.bit_length()))]
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when((at + step <= size) & holds(F.get(array, at + step - 1) <= value), at + step).otherwise(at)) if steps else F.lit(0)
    return F.when(value.isNotNull(), found.cast("long"))


def _by_tree(rows: DataFrame, rules: DataFrame, ranges: Ranges, lists: Lists, priority: str, name: str, total: int) -> DataFrame:
    axes = list(ranges.items())[:AXES]
    of = next(iter(lists.items()), None)
    cuts = [_cuts(rules, low, high, total) for _, (low, high) in axes]
    ranked = rules.select(_ordered(rules, priority).alias("_candidate")).repartitionByRange("_candidate").sortWithinPartitions("_candidate").select(
        F.col("_candidate._rule").alias("_rule"), F.monotonically_increasing_id().alias("_rank"))
    rule, nodes = F.col("_rule"), [f"_n{i}" for i in range(len(axes))]
    for i, (column, (low, high)) in enumerate(axes):
        exact = all(isinstance(t, EXACT) for t in (rows.schema[column].dataType, rules.schema[low].dataType, rules.schema[high].dataType))
        ranked = settle(ranked.withColumn(f"_a{i}", _ends(rule[low].cast("double"), rule[high].cast("double"), cuts[i], exact)))
    placed = ranked
    for i in range(len(axes)):
        placed = placed.withColumn("_at", F.explode(_rule_nodes(F.col(f"_a{i}"), len(cuts[i]).bit_length()))).withColumns(
            {f"_n{i}": F.col("_at.node"), f"_e{i}": F.col("_at.edge")}).drop("_at", f"_a{i}")
    asked_more = F.lit(False)
    for column in [c for pair in list(ranges.values())[AXES:] for c in pair] + list(lists.values())[1:]:
        asked_more = asked_more | rule[column].isNotNull()
    edges = [F.col(f"_e{i}") for i in range(len(axes))]
    unsure = edges[0] | edges[-1] | asked_more
    sure = placed.where(~unsure)
    if of:
        values = F.array_distinct(F.filter(rule[of[1]], lambda v: v.isNotNull()))
        kind = lambda v, every: F.struct(F.lit(every).alias("every"), v.alias("value"))
        none = F.lit(None).cast(rules.schema[of[1]].dataType.elementType)
        sure = sure.withColumn("_kind", F.explode(F.when(rule[of[1]].isNull(), F.array(kind(none, True))).otherwise(F.transform(values, lambda v: kind(v, False)))))
        sure = sure.withColumns({"_every": F.col("_kind.every"), "_value": F.col("_kind.value")})
    # All that such rules ask is asked by the place itself, so one rule of each place can win.
    sure = settle(sure.groupBy(*nodes, *(["_every", "_value"] if of else [])).agg(F.min("_rank").alias("_rank")))

    ats = [f"_at{i}" for i in range(len(axes))]
    kept = settle(rows.withColumns({
        "_row": F.monotonically_increasing_id(), **({"_of": F.col(f"`{of[0]}`")} if of else {}),
        **{f"_at{i}": F.coalesce(_interval(number(F.col(f"`{column}`")), cuts[i]), F.lit(-1).cast("long")) for i, (column, _) in enumerate(axes)}}))
    cell = ats + (["_of"] if of else [])
    cells = settle(kept.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows")))
    best = null_safe_join(cells, settle(_least(cells.select(*cell), sure, cuts, 0, bool(of))), cell)
    named = ranked.select("_rank", rule.alias(name))
    waiting = placed.where(unsure)
    if waiting.isEmpty():
        best = settle(best.join(named, "_rank", "left").drop("_rank"))
        return attach_by_key(kept, best, cell, weight="_rows", salt_by=["_row"]).drop("_row", "_rows", *cell)

    # A rule that ends inside an interval, or asks more, is compared with the rows there.
    alone = ~edges[0] & edges[-1] & F.lit(len(axes) > 1)
    rest = settle(waiting.select("_n0", F.when(alone, F.col(nodes[-1])).otherwise(ANYWHERE).alias("_m"), "_rank", "_rule").dropDuplicates(["_n0", "_m", "_rank"]))
    leaf = F.when(F.col(ats[-1]) >= 0, (1 << len(cuts[-1]).bit_length()) + F.col(ats[-1])).otherwise(ANYWHERE)
    needed = [F.col(f"`{c}`") for c in dict.fromkeys([*ranges, *lists])]
    asking = kept.withColumn("_n0", F.explode(_row_nodes(F.col("_at0"), cuts[0]))).withColumn("_m", F.explode(F.array_distinct(F.array(leaf, F.lit(ANYWHERE)))))
    met = attach_by_key(asking.select("_row", "_n0", "_m", *needed), rest, ["_n0", "_m"], how="inner", also=_holds(rule, ranges, lists), salt_by=["_row"])
    compared = met.groupBy("_row").agg(F.min("_rank").alias("_other"))
    by_cell = attach_by_key(kept.select("_row", *cell), settle(best), cell, weight="_rows", salt_by=["_row"]).select("_row", "_rank")
    winners = by_cell.join(compared, "_row", "left").select("_row", F.least("_rank", "_other").alias("_rank")).where("_rank IS NOT NULL")
    winners = settle(winners.join(named, "_rank").drop("_rank"))
    return null_safe_join(kept, winners, ["_row"]).drop("_row", *cell)


def _least(asked: DataFrame, sure: DataFrame, cuts: Sequence[Sequence[float]], i: int, listed: bool) -> DataFrame:
    """The least rank for each asked place: its nodes on the axes before ``i``, its intervals on the others and its value.

    An axis at a time: places that share a node are looked up once for it.
    """
    up = asked.withColumn(f"_n{i}", F.explode(_row_nodes(F.col(f"_at{i}"), cuts[i])))
    if i + 1 < len(cuts):
        below = up.drop(f"_at{i}").distinct()
        facts = settle(_least(below, sure, cuts, i + 1, listed))
        keys = below.columns
    else:
        facts, keys = sure, [f"_n{k}" for k in range(len(cuts))]
        if listed:
            every = F.struct(F.lit(True).alias("every"), F.when(F.lit(False), F.col("_of")).alias("value"))
            own = F.struct(F.lit(False).alias("every"), F.col("_of").alias("value"))
            up = up.withColumn("_kind", F.explode(F.when(F.col("_of").isNull(), F.array(every)).otherwise(F.array(every, own)))).withColumns(
                {"_every": F.col("_kind.every"), "_value": F.col("_kind.value")}).drop("_kind")
            keys += ["_every", "_value"]
    return null_safe_join(up, facts, keys, "inner").groupBy(*asked.columns).agg(F.min("_rank").alias("_rank"))


def _cuts(rules: DataFrame, low: str, high: str, total: int) -> list[float]:
    """All bounds on the axis; where they are more than ``MOST_CUTS``, quantiles of them, as many at most."""
    bounds = rules.select(F.explode(F.array_compact(F.array(F.col(f"`{low}`").cast("double"), F.col(f"`{high}`").cast("double")))).alias("bound"))
    found = [r[0] for r in bounds.distinct().limit(MOST_CUTS + 1).collect()]
    if len(found) > MOST_CUTS:
        wanted = min(MOST_CUTS, max(1, math.ceil(2 * total / RULES_PER_CUT)))
        found = bounds.agg(F.percentile_approx("bound", [i / wanted for i in range(1, wanted + 1)], 10 * wanted)).first()[0]
    return sorted(set(found))


def _ends(low: Column, high: Column, cuts: Sequence[float], exact: bool) -> Column:
    """For each end of a rule whether it has one, the interval of it, and whether that is wholly in or out as the end is a cut."""
    def end(bound: Column) -> Column:
        at = _interval(bound, cuts)
        on_cut = holds((F.get(_array(cuts), at.cast("int") - 1) == bound) & (F.abs(bound) <= 2 ** 53)) if exact and cuts else F.lit(False)
        return F.struct(bound.isNotNull().alias("asks"), at.alias("at"), on_cut.alias("on_cut"))

    return F.struct(end(low).alias("low"), end(high).alias("high"))


def _rule_nodes(ends: Column, levels: int) -> Column:
    """Where a rule stands on an axis: nodes that it covers, and as edges the intervals in which it ends.

    The node of level k above interval i has the number 2^(levels - k) + (i >> k). A rule without bounds stands at ``ANYWHERE``.
    """
    low, high = ends["low"], ends["high"]
    first = F.when(~low["asks"], F.lit(0).cast("long")).when(low["on_cut"], low["at"]).otherwise(low["at"] + 1)
    last = F.when(~high["asks"], F.lit((1 << levels) - 1).cast("long")).otherwise(high["at"] - 1)
    node = lambda number, edge: F.struct(number.cast("long").alias("node"), F.lit(edge).alias("edge"))
    whole = F.array_compact(F.concat(*[
        F.array(*[F.when(at.isNotNull(), node((1 << (levels - level)) + at, False)) for at in _nodes(level, first, last)]) for level in range(levels + 1)]))
    starts = low["asks"] & ~low["on_cut"]
    ends_inside = high["asks"] & ~high["on_cut"] & ~(starts & holds(low["at"] == high["at"]))
    edges = F.array_compact(F.array(*[F.when(inside, node((1 << levels) + at, True)) for inside, at in ((starts, low["at"]), (ends_inside, high["at"]))]))
    return F.when(~low["asks"] & ~high["asks"], F.array(node(F.lit(ANYWHERE), False))).otherwise(F.concat(whole, edges))


def _row_nodes(at: Column, cuts: Sequence[float]) -> Column:
    """The nodes above an interval; an unknown value is only at ``ANYWHERE``."""
    levels = len(cuts).bit_length()
    above = [(F.lit(1 << (levels - k)) + F.shiftright(at, k)).cast("long") for k in range(levels + 1)]
    anywhere = F.lit(ANYWHERE).cast("long")
    return F.when(at < 0, F.array(anywhere)).otherwise(F.array(anywhere, *above))


def _nodes(level: int, low: Column, high: Column) -> tuple[Column, Column]:
    """Nodes of a level that lie in the intervals low..high while their parent does not, null for none."""
    first = F.ceil(low / (1 << level)).cast("long")
    last = (F.floor((high + 1) / (1 << level)) - 1).cast("long")
    left = F.when((first <= last) & (first % 2 == 1), first)
    right = F.when((first <= last) & (last % 2 == 0) & ((first < last) | (first % 2 == 0)), last)
    return left, right
