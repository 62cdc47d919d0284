"""Order-dependent operators that never put a whole well into one task.

The rows of all keys are cut into runs at quantiles of the ordering column, or by their place in a
global sort where that column is too uneven, so a window works on one (key, run) at a time. What a run must know about its past - a total so far, the last value -
comes as one extra *carry row* that sorts before the rows of the run and is dropped again at the
end. The carry rows need only one aggregated row per (key, run).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.functions.nulls import holds, lookup
from wellspring.functions.text import epoch_seconds
from wellspring.operators.keyed import attach_by_key, null_safe_join
from wellspring.session import settle

ROWS_PER_RUN = 1_000_000
MAX_RUNS = 10_000
UNEVEN = 4
POSITION_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType, T.NumericType)
RUN = "_run"
MAIN = "_main"


def order_position(df: DataFrame, column: str) -> Column:
    """A double that never decreases along the ordering column; nulls come first, NaN last, as in a sort.

    A timestamp is its instant, as the sort takes it: a wall clock runs back where the zone changes.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        value = F.col(column).cast("double")
        position = F.when(F.isnan(value), F.lit(float("inf"))).otherwise(value)
    elif isinstance(kind, T.TimestampType):
        position = F.unix_micros(column).cast("double")
    else:
        position = epoch_seconds(F.col(column).cast("timestamp_ntz"))
    return F.coalesce(position, F.lit(float("-inf")))


def cut_into_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  rows_per_run: int = ROWS_PER_RUN) -> tuple[DataFrame, bool]:
    """Add the run number and tell whether there is more than one run.

    One job over the first ordering column finds quantiles as cuts; the plan holds them as constants. A
    second job counts the rows per (key, run). Where many rows of a key share one value of that column, or
    it is no number or time, the rows are instead sorted once by key and all ordering columns and cut at
    equal numbers of rows.
    """
    total = df.count()
    runs = math.ceil(total / rows_per_run)
    if runs <= 1:
        return df.withColumn(RUN, F.lit(0).cast("long")), False
    if runs > MAX_RUNS or not isinstance(df.schema[order[0]].dataType, POSITION_TYPES):
        return _cut_by_place(df, keys, order, rows_per_run), True
    position = order_position(df, order[0])
    shares = [i / runs for i in range(1, runs)]
    found = df.agg(F.percentile_approx(position, shares, 10 * runs)).first()[0]
    splits = [float("-inf"), *sorted({c for c in found if not math.isinf(c)}), float("inf")]
    if len(splits) > 2:
        bucketizer = Bucketizer(splits=splits, inputCol="_position", outputCol=RUN)
        cut = bucketizer.transform(df.withColumn("_position", position)).withColumn(RUN, F.col(RUN).cast("long")).drop("_position")
    else:
        cut = df.withColumn(RUN, F.lit(0).cast("long"))
    longest = cut.groupBy(*keys, RUN).count().agg(F.max("count")).first()[0]
    if longest > UNEVEN * max(rows_per_run, total // runs):
        return _cut_by_place(df, keys, order, rows_per_run), True
    return cut, True


def _cut_by_place(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_run: int) -> DataFrame:
    placed = global_index(df, [*keys, *order], "_index")
    return placed.withColumn(RUN, F.floor(F.col("_index") / rows_per_run).cast("long")).drop("_index")


def _run_window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, RUN).orderBy(MAIN, *order)


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, Column],
                   include_current: bool = True, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """Running sums per key in the given order, with or without the row's own value."""
    valued = df.withColumns({f"_v_{n}": v.cast("double") for n, v in totals.items()})
    cut, several = cut_into_runs(valued, keys, order, rows_per_run)
    rows = cut.withColumn(MAIN, F.lit(True))
    if several:
        per_run = cut.groupBy(*keys, RUN).agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in totals])
        before = Window.partitionBy(*keys).orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
        carried = per_run.select(
            *keys, RUN, *[F.sum(f"_v_{n}").over(before).alias(f"_v_{n}") for n in totals], F.lit(False).alias(MAIN)
        )
        rows = rows.unionByName(carried, allowMissingColumns=True)
    frame = _run_window(keys, order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    summed = rows.withColumns({n: F.coalesce(F.sum(f"_v_{n}").over(frame), F.lit(0.0)) for n in totals})
    return summed.where(MAIN).drop(RUN, MAIN, *[f"_v_{n}" for n in totals])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_number",
             rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """Number the rows of each key from 1."""
    counted = running_totals(df, keys, order, {name: F.lit(1.0)}, rows_per_run=rows_per_run)
    return counted.withColumn(name, F.col(name).cast("long"))


def global_index(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """Number all rows from 0 in the given order, of any column type.

    The rows are range-sorted and written once, which fixes their partition and place in it; the
    rows before each partition come from one count per partition.
    """
    placed = settle(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    numbered_rows = attach_by_key(placed.withColumn("_part", part), offsets, ["_part"])
    inside = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return numbered_rows.withColumn(name, (F.col("_before") + inside).cast("long")).drop("_id", "_part", "_before")


def first_rows_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark trims every input partition to n rows per key before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str,
                  rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """Add the value of ``column`` in the preceding row of the key, and ``<name>_known`` (false in the first row)."""
    cut, several = cut_into_runs(df, keys, order, rows_per_run)
    rows = cut.withColumns({"_seen": F.col(column), MAIN: F.lit(True)})
    if several:
        last = cut.groupBy(*keys, RUN).agg(F.max_by(F.struct(column), F.struct(*order)).alias("_last"))
        carried = (
            last.withColumn("_earlier", F.lag("_last").over(Window.partitionBy(*keys).orderBy(RUN)))
            .where(F.col("_earlier").isNotNull())
            .select(*keys, RUN, F.col(f"_earlier.{column}").alias("_seen"), F.lit(False).alias(MAIN))
        )
        rows = rows.unionByName(carried, allowMissingColumns=True)
    place = _run_window(keys, order)
    return (
        rows.withColumns({
            name: F.lag("_seen").over(place),
            f"{name}_known": F.lag(F.lit(True), 1, False).over(place),
        })
        .where(MAIN)
        .drop(RUN, MAIN, "_seen")
    )


def with_changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str = "changed",
                 rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """True where ``column`` differs from the preceding row of the key."""
    seen = with_previous(df, keys, order, column, "_previous", rows_per_run)
    differs = F.col("_previous_known") & ~F.col("_previous").eqNullSafe(F.col(column))
    return seen.withColumn(name, differs).drop("_previous", "_previous_known")


def sequence_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], feature: str, label: str,
                     steps: int, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """The last ``steps`` values of ``feature`` as an array with the next ``label``; incomplete windows are left out.

    The rows are numbered and put into blocks of equal length. A row near the edge of a block also
    goes to the neighbour that needs it, so each block is complete on its own.
    """
    block = max(rows_per_run, steps + 1)
    place = numbered(df, keys, order, "_place", rows_per_run).withColumn("_place", F.col("_place") - 1)
    home = F.floor(F.col("_place") / block)
    inside = F.col("_place") - home * block
    copies = F.array(
        home,
        F.when(inside >= block - (steps - 1), home + 1),
        F.when(inside < 1, home - 1),
    )
    spread = place.withColumn("_home", home).withColumn("_block", F.explode(F.array_compact(copies)))
    window = Window.partitionBy(*keys, "_block").orderBy("_place")
    return (
        spread.withColumns({
            "window": F.collect_list(F.coalesce(F.col(feature).cast("double"), F.lit(float("nan"))))
            .over(window.rowsBetween(-(steps - 1), 0)),
            "next_label": F.lead(label).over(window),
            "_has_next": F.lead(F.lit(True), 1, False).over(window),
        })
        .where((F.col("_block") == F.col("_home")) & (F.size("window") == steps) & F.col("_has_next"))
        .drop("_place", "_home", "_block", "_has_next")
    )


def running_depth(df, keys, order, rop: str, name: str = "depth", rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """Depth drilled so far in metres when each row lasts one second and ``rop`` is in metres per hour."""
    return running_totals(df, keys, order, {name: F.col(rop) / 3600}, True, rows_per_run)


def capped_running_sum(df, keys, order, step: Column, cap: float, name: str, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """min(cap, sum of the earlier steps); steps must not be negative."""
    summed = running_totals(df, keys, order, {name: step}, False, rows_per_run)
    return summed.withColumn(name, F.least(F.lit(cap), F.col(name)))


def floored_running_loss(df, keys, order, start: Column, step: Column, floor: float, name: str,
                         rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """max(floor, start - sum of the earlier steps); steps must not be negative."""
    summed = running_totals(df, keys, order, {name: step}, False, rows_per_run)
    return summed.withColumn(name, F.greatest(F.lit(floor), start - F.col(name)))


# Wear added per row, wear kept at the change into a formation, contamination added per row.
WEAR_STEP = {"Shale": 0.0003, "Sandstone": 0.0005, "Limestone": 0.0008, "Topsoil": 0.0001, "Weathered_Rock": 0.0002}
WEAR_STEP_DEFAULT = 0.0004
WEAR_KEPT = {"Shale": 0.6, "Sandstone": 0.7, "Limestone": 0.5, "Topsoil": 0.9, "Weathered_Rock": 0.8}
WEAR_KEPT_DEFAULT = 0.7
CONTAMINATION_STEP = {"Shale": 0.0015, "Sandstone": 0.0008, "Limestone": 0.0006, "Topsoil": 0.0020, "Weathered_Rock": 0.0012}
CONTAMINATION_STEP_DEFAULT = 0.0010
CONTAMINATION_STEP_SHALE_KCL = 0.0005
EFFICIENCY_STEP = 0.00002


def contamination_step(formation: Column, additives: Column | None = None) -> Column:
    plain = lookup(formation, CONTAMINATION_STEP, CONTAMINATION_STEP_DEFAULT)
    if additives is None:
        return plain
    treated = holds((formation == "Shale") & F.array_contains(additives, "KCl"))
    return F.when(treated, F.lit(CONTAMINATION_STEP_SHALE_KCL)).otherwise(plain)


def bit_wear(df: DataFrame, keys: Sequence[str], order: Sequence[str], layer: str, formation: str,
             name: str = "bit_wear", cap: float = 1.0, wear_scale: float = 1.0,
             rows_per_run: int = ROWS_PER_RUN, fan_out: int = 64) -> DataFrame:
    """Wear before each row: grows by the step of the formation up to ``cap``, shrinks at each layer change.

    A segment is a stretch of rows in one layer. Inside it the wear is the wear at its start plus the
    steps so far. The starts follow from the segment sums alone, by ``capped_walk``.
    """
    step = lookup(F.col(formation), WEAR_STEP, WEAR_STEP_DEFAULT) * wear_scale
    kept = lookup(F.col(formation), WEAR_KEPT, WEAR_KEPT_DEFAULT)
    changes = with_changes(df, keys, order, layer, "_changed", rows_per_run)
    rows = settle(running_totals(
        changes, keys, order,
        {"_segment": F.col("_changed").cast("double"), "_with_own": step}, True, rows_per_run,
    ).withColumn("_before", F.col("_with_own") - step))
    segments = rows.groupBy(*keys, "_segment").agg(
        F.min("_before").alias("_base"),
        (F.max("_with_own") - F.min("_before")).alias("b"),
        F.min(F.when(F.col("_changed"), kept).otherwise(1.0)).alias("a"),
        F.count(F.lit(1)).alias("_rows"),
    ).withColumn("c", F.lit(cap))
    starts = settle(capped_walk(settle(segments), keys, "_segment", fan_out))
    joined = attach_by_key(rows, starts.select(*keys, "_segment", "_base", "start", "a", "_rows"),
                           [*keys, "_segment"], weight="_rows")
    worn = F.least(F.lit(cap), F.col("start") * F.col("a") + F.col("_before") - F.col("_base"))
    return joined.withColumn(name, worn).drop(
        "_changed", "_segment", "_with_own", "_before", "_base", "start", "a", "_rows")


def capped_walk(steps: DataFrame, keys: Sequence[str], position: str, fan_out: int = 64,
                first: float = 0.0) -> DataFrame:
    """State before each step of x -> min(c, a*x + b), starting from ``first`` at position 0.

    Two such steps in a row are again such a step, so blocks of ``fan_out`` steps are folded into one
    step each and walked at the next level. No group ever holds more than ``fan_out`` steps.
    Positions must count 0, 1, 2, ... without gaps.
    """
    longest = steps.agg(F.max(position)).first()[0]
    if longest is None:
        return steps.withColumn("start", F.lit(None).cast("double"))
    return _walk(steps, keys, position, fan_out, first, int(longest) + 1)


def _step_list(position: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), "a", "b", "c")))


def _walk(steps: DataFrame, keys, position, fan_out, first, longest) -> DataFrame:
    block = f"{position}_block"
    blocked = steps.withColumn(block, F.floor(F.col(position) / fan_out))
    if longest <= fan_out:
        entries = blocked.select(*keys, block).distinct().withColumn("_entry", F.lit(first))
    else:
        no_cap = F.lit(1e300)
        folded = blocked.groupBy(*keys, block).agg(_step_list(position).alias("_list")).withColumn(
            "_whole",
            F.aggregate(
                "_list",
                F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), no_cap.alias("c")),
                lambda s, x: F.struct(
                    (x["a"] * s["a"]).alias("a"),
                    (x["a"] * s["b"] + x["b"]).alias("b"),
                    F.least(x["c"], x["a"] * s["c"] + x["b"]).alias("c"),
                ),
            ),
        ).select(*keys, block, "_whole.a", "_whole.b", "_whole.c")
        entries = _walk(folded, keys, block, fan_out, first, math.ceil(longest / fan_out)).select(
            *keys, block, F.col("start").alias("_entry"))
    lists = blocked.groupBy(*keys, block).agg(_step_list(position).alias("_list"))
    walked = null_safe_join(lists, entries, [*keys, block]).withColumn(
        "_states",
        F.transform(
            "_list",
            lambda x, i: F.struct(
                x["p"].alias("p"),
                F.aggregate(
                    F.slice("_list", 1, i), F.col("_entry"),
                    lambda s, y: F.least(y["c"], y["a"] * s + y["b"]),
                ).alias("start"),
            ),
        ),
    )
    states = walked.select(*keys, F.explode("_states").alias("_s")).select(
        *keys, F.col("_s.p").alias(position), F.col("_s.start").alias("start"))
    return null_safe_join(steps, states, [*keys, position])


def series_by_interval(df: DataFrame, keys: Sequence[str], moment: str, measures: Sequence[str],
                       width: str = "1 minute") -> DataFrame:
    """Average of each measure per key and time interval, for charts."""
    return (
        df.groupBy(*keys, F.window(moment, width).alias("_w"))
        .agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(m).alias(f"avg_{m}") for m in measures])
        .select(*keys, F.col("_w.start").alias("interval_start"), "n_rows", *[f"avg_{m}" for m in measures])
    )
