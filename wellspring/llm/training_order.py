"""Token ids in training order: a keyed permutation gives every sequence a slot, and shards hold the slots at a fixed stride."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.files import Ranges, write_new
from wellspring.llm.tokens import END_ID, token_bytes
from wellspring.llm.words import mix
from wellspring.session import scratch_path, settle

SIZE = 1024
MOST_ID = 65_535
SHARD_SEQUENCES = 4096
KEY = 20_251
ROUNDS = 6


def feistel(values: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """A permutation of 0 to n - 1 that depends on ``key``.

    A Feistel network permutes the numbers of an even count of bits; values that leave the range walk on along
    their cycle until they are back in it, which takes less than four steps on average.
    """
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in (keys[::-1] if inverse else keys):
            if inverse:
                left, right = right ^ (mix(left + k) & mask), left
            else:
                left, right = right, left ^ (mix(right + k) & mask)
        return (left << shift) | right

    out = once(values.astype("u8"))
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= n]
    return out.astype("i8")


def write_order(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, key: int = KEY,
                vocabulary: str | None = None, ranks: str | None = None) -> tuple[DataFrame, int]:
    """Write shards of ids (unsigned, 16 bits) in training order; returns their manifest and the number of sequences.

    The ids of all documents, each with its end id, form one stream in the order of the table's partitions. Sequence i is the
    stream's i-th run of ``size`` ids; the last is filled with end ids. Slot s of the training order is in shard
    s // SHARD_SEQUENCES at a fixed stride, so a reader resumes at any slot with one multiplication.

    The first pass counts ids per partition, the second cuts the stream from the running counts. It reads the same
    partitions, so ``docs`` must come from files (settle it otherwise); a partition whose count changed stops the
    job, and so does an id that 16 bits cannot hold. Only ids of one shard are held in a task.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(len(ids) // 4 for batch in batches for ids in token_bytes(batch.column(1).to_pylist(), vocabulary, ranks))
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total], pa.int64())], names=["part", "ids"])

    counted = settle(rows.mapInArrow(count, "part bigint, ids bigint")).collect()  # one row per partition
    counts = {r["part"]: r["ids"] for r in counted}
    begin, total = {}, 0
    for part in sorted(counts):
        begin[part] = total
        total += counts[part]
    sequences = -(-total // size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at = begin.get(part, 0)
        for batch in batches:
            owner, sequence, offset, runs = [], [], [], []
            for row, ids in enumerate(token_bytes(batch.column(1).to_pylist(), vocabulary, ranks)):
                wide = np.frombuffer(ids, "<u4")
                if wide.max(initial=0) > MOST_ID:
                    raise ValueError(f"the vocabulary has ids above {MOST_ID}, which the shards cannot hold")
                short = wide.astype("<u2").tobytes()
                n, done = len(short) // 2, 0
                while done < n:
                    take = min(n - done, size - (at + done) % size)
                    owner.append(row)
                    sequence.append((at + done) // size)
                    offset.append((at + done) % size)
                    runs.append(short[2 * done:2 * (done + take)])
                    done += take
                at += n
            slots = feistel(np.array(sequence, "i8"), sequences, key) if sequence else np.zeros(0, "i8")
            yield pa.record_batch([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(sequence, pa.int64()), pa.array(slots, pa.int64()),
                                   pa.array(offset, pa.int32()), pa.array(runs, pa.binary())], names=["_id", "sequence_id", "slot", "_at", "_ids"])
        if at != begin.get(part, 0) + counts.get(part, 0):
            raise RuntimeError("a partition changed between the passes; settle the table first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, {"slot": [], "sequence_id": [], "data": [], "ids": []}

        def flush() -> Iterator[pa.RecordBatch]:
            if not held["slot"]:
                return
            end = np.array([END_ID], "<u2").tobytes()
            data = [b"".join(x) for x in held["data"]]
            lengths = [len(x) // 2 for x in data]
            data = [x + end * (size - n) for x, n in zip(data, lengths)]
            name = write_new(folder, f"shard-{shard:08d}", b"".join(data))
            n = len(data)
            yield pa.record_batch([
                pa.array(held["slot"], pa.int64()), pa.array(held["sequence_id"], pa.int64()), pa.array([shard] * n, pa.int64()), pa.array([name] * n),
                pa.array([2 * size * i for i in range(n)], pa.int64()), pa.array(lengths, pa.int64()),
                pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array(held["ids"], pa.list_(kinds[0]))],
                names=["slot", "sequence_id", "shard", "file", "byte_offset", "length", "ids_crc32", "doc_ids"])
            for column in held.values():
                column.clear()

        kinds = []
        for batch in batches:
            kinds[:] = [batch.schema.field(0).type]
            for owner, sequence, slot, ids in zip(*[batch.column(c).to_pylist() for c in ("_id", "sequence_id", "slot", "_ids")]):
                if slot // SHARD_SEQUENCES != shard:
                    yield from flush()
                    shard = slot // SHARD_SEQUENCES
                if not held["slot"] or held["slot"][-1] != slot:
                    for column, value in zip(held.values(), (slot, sequence, [], [])):
                        column.append(value)
                held["data"][-1].append(ids)
                held["ids"][-1].append(owner)
        if kinds:
            yield from flush()

    runs = rows.mapInArrow(cut, f"_id {kind}, sequence_id bigint, slot bigint, _at int, _ids binary")
    shards = max(1, -(-sequences // SHARD_SEQUENCES))
    ordered = runs.repartition(shards, F.floor(F.col("slot") / SHARD_SEQUENCES)).sortWithinPartitions("slot", "_at")
    manifest = settle(ordered.mapInArrow(write, f"slot bigint, sequence_id bigint, shard bigint, file string, byte_offset bigint, length bigint, "
                                                f"ids_crc32 bigint, doc_ids array<{kind}>"))
    return manifest, sequences


def read_order(manifest: DataFrame, folder: str, size: int = SIZE) -> DataFrame:
    """The manifest's rows as read back from the shards, with the checksum of what was read as ``read_crc32``."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(folder)
        for batch in batches:
            found = [zlib.crc32(ranges.read(name, at, 2 * size)) for name, at in zip(batch.column("file").to_pylist(), batch.column("byte_offset").to_pylist())]
            yield batch.append_column("read_crc32", pa.array(found, pa.int64()))
        ranges.close()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in manifest.schema)
    return manifest.mapInArrow(read, f"{schema}, read_crc32 bigint")


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, key: int = KEY,
                   vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per sequence of the training order, as read back from its shard.

    Columns: slot, sequence_id (place in the stream), shard, byte_offset, length (ids before the filling), ids_crc32 (of
    the stored bytes) and doc_ids, the documents in the order of their ids, once per run. Null text is empty; an
    empty table gives an empty result; repeated rows are repeated; further columns are ignored.
    """
    folder = scratch_path(docs.sparkSession, "shards")
    manifest, _ = write_order(docs, folder, id_col, text_col, size, key, vocabulary, ranks)
    back = read_order(manifest, folder, size)
    same = F.when(F.col("read_crc32") == F.col("ids_crc32"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a shard differs from its manifest")))
    return back.select("slot", "sequence_id", "shard", "byte_offset", "length", same.cast("bigint").alias("ids_crc32"), "doc_ids")
