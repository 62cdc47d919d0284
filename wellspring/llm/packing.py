"""Packing documents into sequences of fixed length: best fit inside partitions, then a tree of merges."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.tokens import token_bytes
from wellspring.session import settle

SIZE = 1024
NEARLY_FULL = 0.98
FAN_IN = 8
GROUP_UNITS = 100_000
TRIES = 3
ROWS_AT_ONCE = 500
PIECE = "piece: int, start: bigint, length: bigint, ids_crc32: bigint"
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, vocabulary: str | None = None,
                 ranks: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids with the end id, cut only if longer than ``size``.

    A cut document has full pieces but for the first. Null text is empty: one piece with only the end id.
    """
    rows, kind = _texts(docs, id_col, text_col)
    return rows.mapInArrow(_cutter(size, vocabulary, ranks), f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return rows, rows.schema["_id"].dataType.simpleString()


def _cutter(size: int, vocabulary: str | None, ranks: str | None) -> Step:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            owner, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(token_bytes(batch.column(1).to_pylist(), vocabulary, ranks)):
                n, at, k = len(ids) // 4, 0, 0
                until = n % size or min(n, size)
                while at < n:
                    owner.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(until - at)
                    crc.append(zlib.crc32(ids[4 * at:4 * until]))
                    at, until, k = until, until + size, k + 1
            yield pa.record_batch([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                   pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["_id", "piece", "start", "length", "ids_crc32"])
    return cut


def _as_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece as a unit of its own."""
    for batch in batches:
        n = batch.num_rows
        items = pa.StructArray.from_arrays([*batch.columns, pa.array(np.zeros(n, "i8"))], [*batch.schema.names, "offset"])
        yield pa.record_batch([batch.column("length").cast(pa.int32()), pa.array(np.zeros(n, "i4")),
                               pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="i4")), items)], names=["fill", "tries", "items"])


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each unit and the fill of each bin.

    Open bins are kept by the room that is left; the bits of one integer say which rooms occur.
    """
    where, offset, fills = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8"), []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0
    values = lengths.tolist()
    for unit in np.argsort(-lengths, kind="stable").tolist():
        need = values[unit]
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen = size, len(fills)
            fills.append(0)
        where[unit], offset[unit] = chosen, fills[chosen]
        fills[chosen] += need
        room -= need
        if room:
            by_room[room].append(chosen)
            rooms |= 1 << room
    return where, offset, np.array(fills, "i8")


def _packed(units: pa.Table, size: int, first_id: int, last: bool) -> pa.RecordBatch:
    """Bins out of units. A unit is a list of pieces with offsets: one piece at first, later an underfull bin."""
    lists = units.column("items").combine_chunks()
    items, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype("i8")
    fill, tries = units.column("fill").to_numpy(), units.column("tries").to_numpy()
    where, at, fills = best_fit(fill, size)
    order = np.lexsort((at, where))
    counts = np.diff(bounds)[order]
    begin = np.concatenate([[0], np.cumsum(counts)])
    pick = np.repeat(bounds[:-1][order] - begin[:-1], counts) + np.arange(begin[-1])
    moved = items.take(pa.array(pick))
    fields = {f.name: moved.field(i) for i, f in enumerate(items.type)}
    fields["offset"] = pa.array(fields["offset"].to_numpy() + np.repeat(at[order], counts), pa.int64())
    per_bin = np.bincount(where, weights=np.diff(bounds), minlength=len(fills)).astype("i8")
    joined = np.bincount(where, minlength=len(fills)) > 1
    stay = np.zeros(len(fills), "i4")
    np.maximum.at(stay, where, tries + 1)
    stay[joined] = 0
    closed = (fills >= NEARLY_FULL * size) | ((stay >= TRIES) & (2 * fills > size)) | last
    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_bin)]), pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
    return pa.record_batch([pa.array(np.arange(len(fills)) + first_id), pa.array(fills.astype("i4")), pa.array(stay), pa.array(closed), out],
                           names=["_bin", "fill", "tries", "closed", "items"])


def pack_pieces(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows of ``pieces`` (from ``token_pieces``) with sequence_id and offset.

    Round 0 packs each partition by itself. Bins that are nearly full are final; the others are the units of the
    next round, where an eighth as many tasks pack what they get in the same way, until one task is left. A bin of
    more than half the size that found no partner in ``TRIES`` rounds is final too, so that what goes on shrinks from
    round to round whatever the lengths are. A task packs groups of at most ``GROUP_UNITS`` units. Every round is
    written as a table, so a lost executor repeats one task of one round.

    An empty table gives an empty result.
    """
    columns = ["_id", "piece", "start", "length", "ids_crc32"]
    return _pack(pieces.select(*columns), pieces.schema["_id"].dataType.simpleString(), size, _as_units)


def _pack(rows_in: DataFrame, kind: str, size: int, units_of: Step) -> DataFrame:
    """The rounds. ``units_of`` makes the first units within the tasks of round 0, so these need one Python process each."""
    item = f"struct<_id: {kind}, {PIECE}, offset: bigint>"
    schema = f"_bin bigint, fill int, tries int, closed boolean, items array<{item}>"

    def packer(number: int, last: bool):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows = [], 0
            first = (number << 56) | (TaskContext.get().partitionId() << 32)

            def flush() -> Iterator[pa.RecordBatch]:
                nonlocal held, rows, first
                if rows:
                    done = _packed(pa.Table.from_batches(held), size, first, last)
                    first, held, rows = first + done.num_rows, [], 0
                    yield done

            for batch in units_of(batches) if number == 0 else batches:
                held.append(batch)
                rows += batch.num_rows
                if rows >= GROUP_UNITS:
                    yield from flush()
            yield from flush()
        return pack

    units, groups, number, done = rows_in, rows_in.rdd.getNumPartitions(), 0, []
    while True:
        last = number > 0 and groups == 1
        round_ = settle(units.mapInArrow(packer(number, last), schema))
        done.append(round_.where("closed"))
        if last:
            break
        groups, number = max(1, groups // FAN_IN), number + 1
        units = round_.where("NOT closed").select("_bin", "fill", "tries", "items").repartition(groups, "_bin")
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionAll(more)
    return bins.select(F.col("_bin").alias("sequence_id"), F.explode("items").alias("_item")).select("_item.*", "sequence_id")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, vocabulary: str | None = None,
                   ranks: str | None = None) -> DataFrame:
    """One row per piece of each document: where its ids begin in the document, its length and checksum, its sequence and place there.

    Null text is empty, and an empty document is its end id alone. Repeated rows are packed as often as they
    occur. Further columns are ignored.
    """
    cut = _cutter(size, vocabulary, ranks)
    packed = _pack(*_texts(docs, id_col, text_col), size, lambda batches: _as_units(cut(batches)))
    return packed.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
