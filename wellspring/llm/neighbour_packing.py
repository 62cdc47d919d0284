"""Packing documents beside their lexical neighbours.

Documents with like token ids are brought near each other by ranges of min-hashes of their ids, and what lies near is
cut into shards of bounded size. Each shard is a BM25 inverted index of its own over token ids, with its own document
frequencies. A seed document asks the index for unused neighbours, which fill the window one after another; the
document that meets the end of the window is cut there and seeds the next one with its rest.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wellspring.llm.tokens import token_bytes
from wellspring.llm.words import mix
from wellspring.session import settle

SIZE = 2048
END_ID = 1
TASK_TOKENS = 1 << 23
SHARD_TOKENS = 1 << 20
SHARD_DOCS = 4096
QUERY_TERMS = 48
ANSWERS = 32
K1, B = 1.2, 0.75
ROWS_AT_ONCE = 2000
PLACE = ["k0", "k1", "k2", "tie"]
_HASHES = [mix(np.arange(1 << 16, dtype="u8") * np.uint64(8) + np.uint64(j + 1)).astype("i8") for j in range(3)]


def _encoded(vocabulary: str | None, ranks: str | None, end_id: int):
    """Ids of each document (two bytes each where they fit) and the min-hashes that say where it belongs."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            data = list(token_bytes(batch.column(1).to_pylist(), vocabulary, ranks, end_id))
            counts = np.array([len(x) // 4 for x in data], "i8")
            starts = np.concatenate([[0], np.cumsum(counts)])
            ids = np.frombuffer(b"".join(data), "<u4")
            low = ids.astype("u2")
            keys = [np.minimum.reduceat(table[low], starts[:-1]) for table in _HASHES]
            ties = [zlib.crc32(x) for x in data]
            if ids.max() < 1 << 16:
                short = low.astype("<u2").tobytes()
                data = [short[2 * a:2 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            yield pa.record_batch([batch.column(0), *map(pa.array, keys), pa.array(ties, pa.int64()), pa.array(counts), pa.array(data, pa.binary())],
                                  names=["_id", *PLACE, "n", "ids"])
    return encode


class Shard:
    """A BM25 inverted index over the token ids of some documents."""

    def __init__(self, docs: Sequence[np.ndarray]):
        sizes = np.array([len(d) for d in docs], "i8")
        keys = np.sort((np.repeat(np.arange(len(docs), dtype="u8"), sizes) << np.uint64(32)) | np.concatenate(docs).astype("u8"))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        tf = np.diff(first, append=len(keys))
        doc, term = (keys[first] >> np.uint64(32)).astype("i8"), (keys[first] & np.uint64(0xFFFFFFFF)).astype("i8")
        self.documents, self.terms = len(docs), term
        self.bounds = np.searchsorted(doc, np.arange(len(docs) + 1))
        self.frequency = np.bincount(term)
        idf = np.log1p((len(docs) - self.frequency + 0.5) / (self.frequency + 0.5))
        length = K1 * (1 - B + B * sizes / sizes.mean())
        order = np.argsort(term, kind="stable")
        self.posted = doc[order]
        self.worth = (idf[term] * tf * (K1 + 1) / (tf + length[doc]))[order]
        self.at = np.concatenate([[0], np.cumsum(self.frequency)])

    def neighbours(self, seed: int, unused: np.ndarray) -> list[int]:
        """The best unused documents for the seed's rarest shared ids; the caller asks again when these are used up."""
        terms = self.terms[self.bounds[seed]:self.bounds[seed + 1]]
        often = self.frequency[terms]
        terms, often = terms[often > 1], often[often > 1]
        if len(terms) > QUERY_TERMS:
            rare = np.argpartition(often, QUERY_TERMS)[:QUERY_TERMS]
            terms, often = terms[rare], often[rare]
        upto = np.cumsum(often)
        if not len(upto):
            return []
        rows = np.repeat(self.at[terms] - upto + often, often) + np.arange(upto[-1])
        scores = np.bincount(self.posted[rows], self.worth[rows], self.documents) * unused
        best = np.argpartition(-scores, ANSWERS)[:ANSWERS] if len(scores) > ANSWERS else np.arange(len(scores))
        best = best[scores[best] > 0]
        return best[np.lexsort((best, -scores[best]))].tolist()


class Windows:
    """The windows of one task; the last of a shard stays open for the next one."""

    def __init__(self, size: int, first_id: int):
        self.size, self.number, self.fill = size, first_id, 0

    def pack(self, names: Sequence, docs: Sequence[np.ndarray]) -> pa.RecordBatch:
        index, unused = Shard(docs), np.ones(len(docs), bool)
        out: list[tuple] = []
        ranked, asking, place = iter(()), None, 0
        for _ in range(len(docs)):
            doc = next((d for d in ranked if unused[d]), None)
            while doc is None and asking is not None and self.fill:
                ranked, asking = iter(index.neighbours(asking, unused)), None
                doc = next(ranked, None)
            if doc is None:
                while not unused[place]:
                    place += 1
                doc, ranked = place, iter(())
            unused[doc] = False
            begun = self.number
            self._lay(doc, docs[doc], out)
            if self.number != begun:  # the window is full; what is left of the document seeds the next one
                ranked = iter(())
            asking = doc
        owner, start, length, crc, number, offset = zip(*out)
        return pa.record_batch([
            pa.array([names[i] for i in owner], None if not hasattr(names, "type") else names.type), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
            pa.array(crc, pa.int64()), pa.array([len(docs[i]) for i in owner], pa.int64()), pa.array(number, pa.int64()), pa.array(offset, pa.int64())],
            names=["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    def _lay(self, doc: int, ids: np.ndarray, out: list[tuple]) -> None:
        at, data = 0, ids.astype("<u4").tobytes()
        while at < len(ids):
            taken = min(len(ids) - at, self.size - self.fill)
            out.append((doc, at, taken, zlib.crc32(data[4 * at:4 * (at + taken)]), self.number, self.fill))
            at += taken
            self.fill += taken
            if self.fill == self.size:
                self.number, self.fill = self.number + 1, 0


def _packer(size: int, kind: pa.DataType):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, names, docs, held = Windows(size, TaskContext.get().partitionId() << 32), [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal names, docs, held
            if docs:
                yield windows.pack(pa.array(names, kind), docs)
            names, docs, held = [], [], 0

        for batch in batches:
            for name, n, data in zip(*[batch.column(c).to_pylist() for c in ("_id", "n", "ids")]):
                if docs and (held + n > SHARD_TOKENS or len(docs) == SHARD_DOCS):
                    yield from flush()
                names.append(name)
                docs.append(np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4"))
                held += n
        yield from flush()
    return pack


def pack_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, vocabulary: str | None = None,
                    ranks: str | None = None, end_id: int = END_ID, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """One row per piece: where its ids begin in the document, its length and checksum, its sequence and place there.

    Every sequence but the last of each task is full, so the padding is at most one sequence for ``task_tokens`` ids.
    Texts are encoded once and their ids written, so a lost executor repeats reading, not encoding. A min-hash that
    very many documents share fills several ranges: further hashes and the checksum of the ids order them, and copies
    without any difference are told apart by a number of their row. Only documents of one shard are compared, a
    shard holds at most ``SHARD_TOKENS`` ids unless one document is longer.

    Null text is empty, and an empty document is its end id alone. A very long document fills window after window.
    Rows that share an id, null included, are documents of their own. An empty table gives an empty result. Further
    columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType
    whole = f"_id {kind.simpleString()}, k0 bigint, k1 bigint, k2 bigint, tie bigint, n bigint, ids binary"
    encoded = settle(rows.mapInArrow(_encoded(vocabulary, ranks, end_id), whole).withColumn("copy", F.monotonically_increasing_id()))
    total = encoded.agg(F.sum("n")).first()[0] or 0
    near = encoded.repartitionByRange(max(1, math.ceil(total / task_tokens)), *PLACE, "copy").sortWithinPartitions(*PLACE, "copy")
    packed = near.select("_id", "n", "ids").mapInArrow(
        _packer(size, to_arrow_type(kind)),
        f"_id {kind.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return packed.withColumnRenamed("_id", id_col)
