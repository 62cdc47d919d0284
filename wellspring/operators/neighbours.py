"""k-nearest-neighbour imputation without comparing all rows with all rows.

Distance between two rows: the sum of squared differences over the columns both have, scaled up by
columns / shared columns, then the root. A missing value becomes the mean of the k nearest rows that
have it; of equally near rows those with the smaller value come first.

Equal rows are merged first, with their count. For each column with gaps the rows that have it are its
*donors*. A bounded sample of them is divided into cells by cuts at medians of the column that varies
most, rows without that column apart. The cuts hold for all donors, so every donor has one cell, and
what the cuts say about a cell bounds the distances to its donors from below. The sample's k-th nearest
donor bounds the distance of a row with a gap from above: the row visits every cell that may hold a
donor as near as that. So the sample decides how many cells are visited, never which donors are found.
One shuffle brings the donors of a cell and its visitors together; there the donors are divided
again, into leaves, and the nearest of a visitor are looked for in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.functions.nulls import nan_to_null
from wellspring.operators.keyed import attach_by_key
from wellspring.session import settle

ROWS_PER_LEAF = 128
LEAVES_PER_CELL = 4  # at least
CELLS = 1024  # for a column, until they hold ROWS_PER_CELL each
ROWS_PER_CELL = 65536
SAMPLE_ROWS = 2 ** 17  # donors of a column in the sample
SAMPLE_NUMBERS = 2 ** 22  # in the sample of all columns, where they are many
SAMPLE_AT_LEAST = 2048
SAMPLE_PER_CELL = 64  # at most, in a cell of the usual size
ASKING_ROWS = 16384  # in the sample that tells how many rows will visit a cell
VISITS_PER_PART = 16384
ROWS_AT_ONCE = 65536
QUERIES_AT_ONCE = 16384  # at most
BOUNDS_AT_ONCE = 2 ** 22  # of rows and boxes
HOMES = 3
COLUMNS_TO_FILTER = 4
HASHES = 2 ** 30
SLACK = 1 + 1e-9  # of a bound, for rounding
_FOUND = "_id bigint, _target int, _near array<struct<distance: double, value: double, copies: double>>"
Work = Callable[[np.ndarray, np.ndarray | None, np.ndarray], tuple[np.ndarray, list[np.ndarray]]]


class Boxes(NamedTuple):
    """For each group of donors and column: whether any donor has it, and its ends if all have it, else infinite ones."""

    some: np.ndarray
    low: np.ndarray
    high: np.ndarray


class Cuts(NamedTuple):
    """Nodes of a tree: column and value of the cut, the nodes of values up to it, beyond it and missing, the leaf or -1."""

    axis: np.ndarray
    cut: np.ndarray
    kids: np.ndarray
    leaf: np.ndarray


class Index(NamedTuple):
    """Donors (columns, value, copies) in the order of their leaves, and where each leaf starts."""

    boxes: Boxes
    starts: np.ndarray
    facts: np.ndarray


class Plan(NamedTuple):
    """How to deal out the donors and visitors of a column: cuts into cells, the sample by cell, first part and parts of each cell."""

    cuts: Cuts
    sample: Index
    first: np.ndarray
    parts: np.ndarray


def knn_impute(df: DataFrame, columns: Sequence[str], k: int = 5, rows_per_leaf: int = ROWS_PER_LEAF) -> DataFrame:
    """Fill the gaps of the numeric ``columns``, of which there may be any number.

    A gap without any comparable row gets the column mean; a column without any value stays empty. NaN is a gap.
    """
    columns = list(columns)
    clean = nan_to_null(df.withColumns({c: F.col(c).cast("double") for c in columns}))
    vectors = settle(
        clean.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("_copies"))
        .withColumn("_id", F.monotonically_increasing_id()))
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), *[
        f.alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in (
            ("k", F.count(c)), ("m", F.try_divide(F.sum(F.col(c) * F.col("_copies")), F.sum(F.when(F.col(c).isNotNull(), F.col("_copies"))))))
    ]).first()
    gaps = [i for i in range(len(columns)) if 0 < facts[f"k{i}"] < facts["n"]]
    if not gaps:
        return clean
    values = vectors.select("_id", "_copies", *[F.col(c).alias(f"_x{i}") for i, c in enumerate(columns)])
    filled = settle(_neighbour_values(values, {i: facts[f"k{i}"] for i in gaps}, facts["n"], len(columns), k, rows_per_leaf))
    patched = filled.groupBy("_id").agg(*[F.max(F.when(F.col("_target") == i, F.col("_value"))).alias(f"_fill_{i}") for i in gaps])
    table = settle(vectors.join(patched, "_id").select(*columns, "_copies", *[f"_fill_{i}" for i in gaps]))
    # with many columns the optimizer takes very long over a filter that names all of them
    gap = F.greatest(*[F.col(columns[i]).isNull() for i in gaps], F.lit(False)) if len(gaps) <= COLUMNS_TO_FILTER else None
    joined = attach_by_key(clean if gap is None else clean.where(gap), table, columns, weight="_copies")
    done = joined.withColumns({
        columns[i]: F.coalesce(F.col(columns[i]), F.col(f"_fill_{i}"), F.lit(facts[f"m{i}"])) for i in gaps
    }).drop("_copies", *[f"_fill_{i}" for i in gaps])
    return done if gap is None else done.unionByName(clean.where(~gap))


def _neighbour_values(values: DataFrame, gaps: dict[int, int], n: int, d: int, k: int, rows_per_leaf: int) -> DataFrame:
    """(_id, _target, _value) for every gap that has a comparable row. ``gaps`` counts the rows that have each column with gaps."""
    nearest = _nearest_donors(d, k)
    plans = _plans(values, gaps, n, d, k, rows_per_leaf, nearest)
    targets = np.concatenate([np.full(int(plan.parts.sum()), t) for t, plan in plans.items()])
    context = values.sparkSession.sparkContext
    shared = context.broadcast(plans)
    dealt = values.mapInArrow(
        _deal(shared, d, k, nearest), "_part int, _ask boolean, _id bigint, " + ", ".join(f"_x{i} double" for i in range(d)) + ", _number double")
    tasks = min(len(targets), max(8 * context.defaultParallelism, len(targets) // 8))
    ready = dealt.repartition(tasks, "_part").sortWithinPartitions("_part", "_ask")
    found = ready.mapInArrow(_meet(targets, d, k, rows_per_leaf, nearest), _FOUND)
    near = found.groupBy("_id", "_target").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_near"))), 1, k).alias("_near"))
    start = F.struct(F.lit(0.0).alias("copies"), F.lit(0.0).alias("total"))

    def add(done, one):
        taken = F.least(one["copies"], k - done["copies"])
        return F.struct((done["copies"] + taken).alias("copies"), (done["total"] + one["value"] * taken).alias("total"))

    return near.select("_id", "_target", F.aggregate("_near", start, add, lambda done: done["total"] / done["copies"]).alias("_value"))


def _plans(values: DataFrame, gaps: dict[int, int], n: int, d: int, k: int, rows_per_leaf: int, nearest: Work) -> dict[int, Plan]:
    """The cells of each column with gaps, from rows with the least hashes: a bounded number of donors of each column and of rows that ask."""
    numbers = [f"_x{i}" for i in range(d)]
    most = max(SAMPLE_AT_LEAST, min(SAMPLE_ROWS, SAMPLE_NUMBERS // (d * d)))
    cell_rows = {t: max(LEAVES_PER_CELL * rows_per_leaf, min(known / CELLS, ROWS_PER_CELL)) for t, known in gaps.items()}
    shares = {t: min(1.0, most / known, SAMPLE_PER_CELL / cell_rows[t]) for t, known in gaps.items()}
    asking = min(1.0, ASKING_ROWS / n)
    place = F.pmod(F.xxhash64(*numbers), F.lit(HASHES)) / float(HASHES)
    taken = F.col("_place") < asking
    for t, share in shares.items():
        taken = taken | (F.col(f"_x{t}").isNotNull() & (F.col("_place") < share))
    sample = values.select(*numbers, "_copies", place.alias("_place")).where(taken).toArrow()
    x, (copies, places) = _matrix(sample, numbers), _matrix(sample, ["_copies", "_place"]).T
    plans, first = {}, 0
    for t, share in shares.items():
        mine = np.flatnonzero(_known(x, t) & (places < share))
        donors = mine[_least_alike(x[mine], t, k)]
        cuts, boxes, order, starts = _divide(x[donors], t, max(2.0 * k, cell_rows[t] * share), closed=False)
        at = donors[order]
        index = Index(boxes, starts, np.column_stack([x[at], x[at, t], copies[at]]))
        visits = np.zeros(len(starts) - 1)
        asks = x[_asks(x, t) & (places < asking)]
        for part in _blocks(len(asks), index):
            visits += np.bincount(_cells(index, asks[part], k, nearest)[1], minlength=len(visits))
        parts = np.ceil(visits / asking / np.maximum(VISITS_PER_PART, np.diff(starts) / share)).astype(int).clip(1)
        plans[t] = Plan(cuts, index, first + np.cumsum(parts) - parts, parts)
        first += int(parts.sum())
    return plans


def _matrix(table: pa.Table | pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Columns side by side, nulls as NaN."""
    return np.column_stack([table.column(c).to_numpy(**({} if isinstance(table, pa.Table) else {"zero_copy_only": False})) for c in names]).astype(float)


def _known(x: np.ndarray, target: int) -> np.ndarray:
    """Rows that have the target and another column."""
    known = ~np.isnan(x)
    return known[:, target] & (known.sum(axis=1) > 1)


def _asks(x: np.ndarray, target: int) -> np.ndarray:
    """Rows without the target that have another column."""
    known = ~np.isnan(x)
    return ~known[:, target] & known.any(axis=1)


def _least_alike(x: np.ndarray, target: int, k: int) -> np.ndarray:
    """Where the rows are that have, of rows alike besides the target, the k smallest values."""
    others = np.delete(x, target, axis=1)
    order = np.lexsort([x[:, target], *others.T])
    a, b = others[order[1:]], others[order[:-1]]
    new = np.concatenate([[True], ((a != b) & ~(np.isnan(a) & np.isnan(b))).any(axis=1)])[:len(x)]
    begins = np.flatnonzero(new)
    return order[np.arange(len(x)) - begins[np.cumsum(new) - 1] < k] if len(x) else order


def _divide(x: np.ndarray, target: int, rows_per_leaf: float, closed: bool) -> tuple[Cuts, Boxes, np.ndarray, np.ndarray]:
    """Rows cut at medians into leaves: the cuts, boxes of the leaves, the rows in the order of leaves, where leaves start.

    If ``closed`` the boxes are those of the rows at hand, else they hold for any row that the cuts bring there.
    """
    d = x.shape[1]
    axes, cuts, kids, leaf, order, boxes = [], [], [], [], [], []
    waiting = [(np.arange(len(x)), np.full(d, -np.inf), np.full(d, np.inf), np.ones(d), np.zeros(d, bool), None)]
    while waiting:
        at, low, high, some, sure, origin = waiting.pop()
        node = len(axes)
        if origin is not None:
            kids[origin[0]][origin[1]] = node
        axis, cut = _best_cut(x[at], target) if len(at) > rows_per_leaf else (None, 0.0)
        axes.append(0 if axis is None else axis)
        cuts.append(cut)
        kids.append([node, node, node])
        leaf.append(len(order) if axis is None else -1)
        if axis is None:
            order.append(at)
            boxes.append((some, low, high))
            continue
        v = x[at, axis]
        with_it, ends, begins = sure.copy(), high.copy(), low.copy()
        with_it[axis], ends[axis], begins[axis] = True, cut, cut
        if not sure[axis]:
            without, unbound = some.copy(), (low, high)
            without[axis] = 0.0
            if not closed or np.isnan(v).any():
                waiting.append((at[np.isnan(v)], *unbound, without, sure, (node, 2)))
        if not closed or (v > cut).any():
            waiting.append((at[v > cut], begins, high, some, with_it, (node, 1)))
        if not closed or (v <= cut).any():
            waiting.append((at[v <= cut], low, ends, some, with_it, (node, 0)))
    rows, starts = np.concatenate(order), np.concatenate([[0], np.cumsum([len(a) for a in order])])
    if closed:
        sorted_ = x[rows]
        known = ~np.isnan(sorted_)
        some, all_ = np.logical_or.reduceat(known, starts[:-1]), np.logical_and.reduceat(known, starts[:-1])
        box = Boxes(some.astype(float), np.where(all_, np.fmin.reduceat(sorted_, starts[:-1]), -np.inf),
                    np.where(all_, np.fmax.reduceat(sorted_, starts[:-1]), np.inf))
    else:
        box = Boxes(*(np.array(part, float).reshape(-1, d) for part in zip(*boxes)))
    return Cuts(np.array(axes), np.array(cuts, float), np.array(kids), np.array(leaf)), box, rows, starts


def _best_cut(x: np.ndarray, target: int) -> tuple[int | None, float]:
    """The column that varies most, and a value at or next to its median that leaves rows on both sides or only sets the missing apart."""
    known = ~np.isnan(x)
    count, low, high = known.sum(axis=0), np.fmin.reduce(x), np.fmax.reduce(x)
    with np.errstate(all="ignore"):
        mean = np.where(known, x, 0.0).sum(axis=0) / np.maximum(count, 1)
        spread = np.nan_to_num(np.sqrt((np.where(known, x - mean, 0.0) ** 2).sum(axis=0)) * count, posinf=0.0)
    score = np.where(high > low, np.maximum(spread, 1e-300), np.where((count > 0) & (count < len(x)), 1e-301, -1.0))
    score[target] = -1.0
    axis = int(score.argmax())
    if score[axis] <= 0:
        return None, 0.0
    v = x[known[:, axis], axis]
    cut = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
    return axis, float(v[v < cut].max() if cut == high[axis] > low[axis] else cut)


def _leaves(cuts: Cuts, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    node, every = np.zeros(len(x), int), np.arange(len(x))
    while len(x):
        v = x[every, cuts.axis[node]]
        after = cuts.kids[node, np.where(np.isnan(v), 2, v > cuts.cut[node])]
        if (after == node).all():
            break
        node = after
    return cuts.leaf[node]


def _least_distances(asked: np.ndarray, boxes: Boxes) -> np.ndarray:
    """What the distance of each row to a donor in each box is at least.

    The donors share with the row at most the columns that any of them has; those that all have are as far as the box.
    """
    known, least = ~np.isnan(asked), np.zeros((len(asked), len(boxes.some)))
    for c in np.flatnonzero(known.any(axis=0)):
        x = asked[:, c, None]
        gap = np.fmax(np.fmax(boxes.low[:, c] - x, x - boxes.high[:, c]), 0.0)
        least += gap * gap
    most = known.astype(float) @ boxes.some.T
    return np.where(most > 0, np.sqrt(least * (asked.shape[1] / np.maximum(most, 1))), np.inf)


def _nearest_donors(d: int, k: int) -> Work:
    """Of the donors of a leaf those not beyond the k-th distance nor the bound of a row: (row, distance, value, copies)."""
    def work(facts, labels, asked):
        squares, shared = np.zeros((len(asked), len(facts))), np.zeros((len(asked), len(facts)))
        for c in np.flatnonzero(~np.isnan(asked[:, :d]).all(axis=0)):
            apart = asked[:, c, None] - facts[None, :, c]
            both = ~np.isnan(apart)
            squares += np.where(both, apart * apart, 0.0)
            shared += both
        distance = np.where(shared > 0, np.sqrt(squares * (d / np.maximum(shared, 1))), np.inf)
        bound = asked[:, d]
        if len(facts) > k:
            bound = np.minimum(bound, np.partition(distance, k - 1, axis=1)[:, k - 1])
        row, donor = np.nonzero((distance <= bound[:, None]) & np.isfinite(distance))
        return row, [distance[row, donor], facts[donor, d], facts[donor, d + 1]]

    return work


def _search(index: Index, asked: np.ndarray, k: int, nearest: Work) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest donors of each row within its bound, as (row, [distance, value, copies]), and the least distances to all boxes.

    The bound of a row stands in its last column. The nearest leaf bounds it further, then every leaf within the bound is compared.
    """
    asked, found = asked.copy(), [(np.zeros(0, int), np.zeros((0, 3)))]
    d = asked.shape[1] - 1
    least = _least_distances(asked[:, :d], index.boxes)
    ahead = np.where(np.diff(index.starts) > 0, least, np.inf)

    def visit(rows: np.ndarray, leaves: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(leaves, kind="stable")
        rows, leaves = rows[order], leaves[order]
        ends = np.concatenate([np.flatnonzero(np.diff(leaves, prepend=-1)), [len(leaves)]])
        met = []
        for a, b in zip(ends, ends[1:]):
            row, numbers = nearest(index.facts[index.starts[leaves[a]]:index.starts[leaves[a] + 1]], None, asked[rows[a:b]])
            met.append((rows[a:b][row], np.column_stack(numbers)))
        return met

    unbound = np.arange(len(asked))
    for _ in range(HOMES):
        home = ahead[unbound].argmin(axis=1)
        there = np.isfinite(ahead[unbound, home])
        unbound, home = unbound[there], home[there]
        if not len(unbound):
            break
        met = visit(unbound, home)
        found += met
        rows, distance = np.concatenate([m[0] for m in met]), np.concatenate([m[1][:, 0] for m in met])
        furthest = np.full(len(asked), -np.inf)
        np.maximum.at(furthest, rows, distance)
        enough = np.bincount(rows, minlength=len(asked)) >= k
        asked[enough, d] = np.minimum(asked[enough, d], furthest[enough])
        ahead[unbound, home] = np.inf
        unbound = unbound[np.isinf(asked[unbound, d])]
    found += visit(*np.nonzero((ahead <= asked[:, d:] * SLACK) & np.isfinite(ahead)))
    row, numbers = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.lexsort([numbers[:, 1], numbers[:, 0], row])
    row = row[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], numbers[order[kept]], least


def _blocks(n: int, index: Index) -> Iterator[slice]:
    """Rows to search at once: as many as their bounds to all leaves leave room for."""
    step = max(1, min(QUERIES_AT_ONCE, BOUNDS_AT_ONCE // len(index.boxes.some)))
    return (slice(s, s + step) for s in range(0, n, step))


def _cells(index: Index, asked: np.ndarray, k: int, nearest: Work) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, bound): the cells that may hold one of the k nearest donors of each row, which the sample's k-th bounds."""
    row, numbers, least = _search(index, np.column_stack([asked, np.full(len(asked), np.inf)]), k, nearest)
    furthest = np.full(len(asked), -np.inf)
    np.maximum.at(furthest, row, numbers[:, 0])
    bound = np.where(np.bincount(row, minlength=len(asked)) >= k, furthest * SLACK, np.inf)
    at, cell = np.nonzero((least <= bound[:, None]) & np.isfinite(least))
    return at, cell, bound[at]


def _deal(shared, d: int, k: int, nearest: Work):
    """Each row to the part of its cell for every column that it has, and to all cells it must visit for every column it lacks."""
    names = [f"_x{i}" for i in range(d)]

    def rows(part, ask, ids, x, number) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch(
            [pa.array(part, pa.int32()), pa.array(np.full(len(part), ask)), pa.array(ids, pa.int64()),
             *[pa.array(np.ascontiguousarray(x[:, i])) for i in range(d)], pa.array(number)],
            names=["_part", "_ask", "_id", *names, "_number"])

    def deal(table: pa.Table) -> Iterator[pa.RecordBatch]:
        x, ids, copies = _matrix(table, names), table.column("_id").to_numpy(), table.column("_copies").to_numpy()
        for t, plan in shared.value.items():
            mine = np.flatnonzero(_known(x, t))
            mine = mine[_least_alike(x[mine], t, k)]
            cell = _leaves(plan.cuts, x[mine])
            times = plan.parts[cell]
            at = np.repeat(np.arange(len(mine)), times)
            part = plan.first[cell[at]] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            for s in range(0, len(at), ROWS_AT_ONCE):
                e = slice(s, s + ROWS_AT_ONCE)
                yield from rows(part[e], False, np.zeros(len(at[e]), int), x[mine[at[e]]], copies[mine[at[e]]])
            asks = np.flatnonzero(_asks(x, t))
            for block in _blocks(len(asks), plan.sample):
                some = asks[block]
                at, cell, bound = _cells(plan.sample, x[some], k, nearest)
                at = some[at]
                yield from rows(plan.first[cell] + ids[at] % plan.parts[cell], True, ids[at], x[at], bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS_AT_ONCE:
                yield from deal(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from deal(pa.Table.from_batches(held))

    return run


def _meet(targets: np.ndarray, d: int, k: int, rows_per_leaf: int, nearest: Work):
    """The nearest donors in a part for each of its visitors; the donors come first."""
    names = [f"_x{i}" for i in range(d)]

    def grown(donors: list[np.ndarray], target: int) -> Index | None:
        if not donors:
            return None
        rows = np.concatenate(donors)
        rows = rows[_least_alike(rows[:, :d], target, k)]
        _, boxes, order, starts = _divide(rows[:, :d], target, rows_per_leaf, closed=True)
        return Index(boxes, starts, np.column_stack([rows[order, :d], rows[order, target], rows[order, d]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, donors, index, asking = -1, [], None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            part, ask = batch.column("_part").to_numpy(), batch.column("_ask").to_numpy(zero_copy_only=False)
            ids, x = batch.column("_id").to_numpy(), _matrix(batch, [*names, "_number"])
            changes = np.flatnonzero((part[1:] != part[:-1]) | (ask[1:] != ask[:-1])) + 1
            for a, b in zip([0, *changes], [*changes, len(part)]):
                if part[a] != here:
                    here, donors, index, asking = part[a], [], None, False
                if not ask[a]:
                    donors.append(x[a:b])
                    continue
                if not asking:
                    index, donors, asking = grown(donors, targets[here]), [], True
                if index is None:
                    continue
                for block in _blocks(b - a, index):
                    row, numbers, _ = _search(index, x[a:b][block], k, nearest)
                    begins = np.flatnonzero(np.diff(row, prepend=-1))
                    near = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in numbers.T], names=["distance", "value", "copies"])
                    yield pa.record_batch(
                        [pa.array(ids[a:b][block][row[begins]]), pa.array(np.full(len(begins), targets[here]), pa.int32()),
                         pa.ListArray.from_arrays(pa.array(np.append(begins, len(row)), pa.int32()), near)], names=["_id", "_target", "_near"])

    return run
