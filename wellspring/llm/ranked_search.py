"""Ranked lexical search over bit-sliced Bloom signatures.

Each document's terms enter a Bloom signature, once for every reached threshold of their frequency. The signatures of
up to ``BLOCK_DOCS`` documents of like length are stored bit by bit: a slice is the bitmap of the documents that have
this bit. The slices of a term, joined by AND, mark every document that has it and a few that have not, so a sum of
marked weights is an upper bound of a document's score. A first reading of the bounds finds promising documents, whose
exact scores give each item a score that its last place must reach. A second reading keeps every document whose bound
reaches it, and those are scored exactly from their whole texts. The result is that of scoring all documents.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wellspring.llm.words import mix
from wellspring.operators.keyed import attach_by_key
from wellspring.session import settle

# The characters between terms.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_SPACED = bytes(32 if b in SEPARATORS else b for b in range(256)).lower()
TIERS = (1, 2, 4)
BITS_PER_KEY = 12
PROBES = 4
BLOCK_DOCS = 256
BLOCK_CELLS = 1 << 24
HELD_KEYS = 1 << 20
SEEDS = 32
ITEM_BYTES = 4 * 1024 * 1024
ROWS_AT_ONCE = 200
RESULT = "item int, _id {kind}, score bigint"


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: runs of letters, digits and characters beyond ASCII, with A-Z lower-cased."""
    return text.lower().translate(_SPACED).split()


@dataclass(frozen=True)
class Corpus:
    """What scoring needs to know: documents with a term, all terms, and the documents of each searched term."""

    documents: int
    words: int
    frequencies: dict[bytes, int]

    def weight(self, term: bytes) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * self.frequencies.get(term, 0) + 1)))

    def length_factor(self, words: int) -> int:
        return 25 + 75 * words * self.documents // self.words


def saturation(tf: int, length_factor: int) -> int:
    return 1_000_000_000 * tf // (1000 * tf + 8 * length_factor)


# ------------------------------------------------------------------ signatures


def probes(keys: np.ndarray, width: int) -> np.ndarray:
    """(key, probe) -> bit. Keys are numbers of 64 bits; two that agree only mark more documents."""
    spread = mix(keys)
    step = (spread >> np.uint64(32)) | np.uint64(1)
    return ((spread[:, None] + step[:, None] * np.arange(PROBES, dtype="u8")) % np.uint64(width)).astype("i8")


def term_keys(codes: np.ndarray, tier: int) -> np.ndarray:
    return codes * np.uint64(8) + np.uint64(tier)


def _slices(keys: list[np.ndarray]) -> tuple[int, np.ndarray]:
    """Width of the signatures and their slices, one row for each bit."""
    width = max(64, BITS_PER_KEY * max(map(len, keys)))
    cells = np.zeros((width, len(keys)), "u1")
    for doc, own in enumerate(keys):
        cells[probes(own, width).ravel(), doc] = 1
    return width, np.packbits(cells, axis=1)


def _blocks(held: list[tuple[object, int, np.ndarray]]) -> Iterator[tuple[list, list[int], int, bytes]]:
    """(ids, words, width, slices) for blocks of documents with like numbers of terms."""
    held.sort(key=lambda doc: len(doc[2]))
    at = 0
    while at < len(held):
        end = at + 1
        while end < len(held) and end - at < BLOCK_DOCS and BITS_PER_KEY * len(held[end][2]) * (end - at + 1) <= BLOCK_CELLS:
            end += 1
        width, slices = _slices([keys for *_, keys in held[at:end]])
        yield [i for i, *_ in held[at:end]], [n for _, n, _ in held[at:end]], width, slices.tobytes()
        at = end


def _scan(searched: frozenset[bytes], kind: pa.DataType, index: bool):
    """One pass over whole texts: blocks of signatures, and at the end of each task one row of counts."""
    names = ["ids", "words", "width", "slices", "n_docs", "n_words", "terms", "docs"]
    types = [pa.list_(kind), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]

    def row(*cells) -> pa.RecordBatch:
        return pa.record_batch([pa.array([c], t) for c, t in zip(cells, types)], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n_docs, n_words, held, held_keys = Counter(), 0, 0, [], 0
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = terms_of(text or b"")
                if not words:
                    continue
                counts = Counter(words)
                n_docs += 1
                n_words += len(words)
                found.update(searched & counts.keys())
                if not index:
                    continue
                codes = np.fromiter(map(zlib.crc32, counts), "u8", len(counts))
                tf = np.fromiter(counts.values(), "i8", len(counts))
                keys = np.concatenate([term_keys(codes[tf >= least], tier) for tier, least in enumerate(TIERS)])
                held.append((name, len(words), keys))
                held_keys += len(keys)
                if held_keys >= HELD_KEYS:
                    for ids, sizes, width, slices in _blocks(held):
                        yield row(ids, sizes, width, slices, None, None, None, None)
                    held, held_keys = [], 0
        for ids, sizes, width, slices in _blocks(held):
            yield row(ids, sizes, width, slices, None, None, None, None)
        yield row(None, None, None, None, n_docs, n_words, list(found), list(found.values()))
    return scan


# ------------------------------------------------------------------ bounds and scores


class Searched:
    """Items of one block of the query set with the weights of their terms."""

    def __init__(self, items: Sequence[Counter], corpus: Corpus):
        self.corpus = corpus
        vocabulary = sorted({t for item in items for t in item if corpus.frequencies.get(t)})
        place = {t: i for i, t in enumerate(vocabulary)}
        self.codes = np.fromiter(map(zlib.crc32, vocabulary), "u8", len(vocabulary))
        weights = [corpus.weight(t) for t in vocabulary]
        # term -> what one occurrence in the item is worth
        self.exact = [[(t, weights[place[t]] * n) for t, n in item.items() if t in place] for item in items]
        self.rows = [np.array([place[t] for t, _ in item], "i8") for item in self.exact]
        self.worth = [np.array([w for _, w in item], "f8") for item in self.exact]

    def bounds(self, words: list[int], width: int, slices: bytes) -> np.ndarray:
        """(item, document) -> a number that the score does not exceed; all sums are whole numbers below 2^53."""
        docs, shortest = len(words), self.corpus.length_factor(min(words))
        matrix = np.frombuffer(slices, "u1").reshape(width, -1)
        most = [*[least - 1 for least in TIERS[1:]], max(words)]
        steps = np.diff([0, *[saturation(max(tf, 1), shortest) for tf in most]])
        marks = np.zeros((len(self.codes), docs), "f8")
        for tier, step in enumerate(steps):
            bits = probes(term_keys(self.codes, tier), width)
            both = matrix[bits[:, 0]]
            for k in range(1, PROBES):
                both = both & matrix[bits[:, k]]
            marks += np.unpackbits(both, axis=1, count=docs) * float(max(step, 0))
        return np.stack([worth @ marks[rows] for rows, worth in zip(self.rows, self.worth)]) if self.rows else np.zeros((0, docs))

    def scores(self, words: list[bytes], wanted: Sequence[int]) -> list[int]:
        counts, factor = Counter(words), self.corpus.length_factor(len(words))
        known: dict[bytes, int] = {}
        totals = []
        for item in wanted:
            total = 0
            for term, worth in self.exact[item]:
                tf = counts.get(term)
                if tf:
                    if term not in known:
                        known[term] = saturation(tf, factor)
                    total += worth * known[term]
            totals.append(total)
        return totals


def _promising(searched: Searched, kind: pa.DataType):
    """The documents with the highest bounds of each task, ``SEEDS`` for each item."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in searched.rows]
        place = 0
        for batch in batches:
            for ids, words, width, slices in zip(*[c.to_pylist() for c in batch.columns]):
                bounds = searched.bounds(words, width, slices)
                for item, held in enumerate(best):
                    least = held[0][0] if len(held) == SEEDS else 0.0
                    own = np.flatnonzero(bounds[item] > least)
                    if len(own) > SEEDS:
                        own = own[np.argpartition(-bounds[item][own], SEEDS - 1)[:SEEDS]]
                    for doc in own.tolist():
                        place += 1
                        entry = (float(bounds[item][doc]), place, ids[doc])
                        (heapq.heappush if len(held) < SEEDS else heapq.heappushpop)(held, entry)
        rows = [(item, doc, bound) for item, held in enumerate(best) for bound, _, doc in held]
        yield _pairs(rows, kind, pa.float64())
    return pick


def _reaching(searched: Searched, least: Sequence[int], kind: pa.DataType):
    """Every document whose bound reaches the score that the item's last place has at least."""
    needed = np.array(least, "f8")[:, None]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, width, slices in zip(*[c.to_pylist() for c in batch.columns]):
                bounds = searched.bounds(words, width, slices)
                yield _pairs([(i, ids[d], bounds[i, d]) for i, d in np.argwhere(bounds >= needed).tolist()], kind, pa.float64())
    return keep


def _pairs(rows: list[tuple], kind: pa.DataType, number: pa.DataType) -> pa.RecordBatch:
    item, doc, value = zip(*rows) if rows else ((), (), ())
    return pa.record_batch([pa.array(item, pa.int32()), pa.array(doc, kind), pa.array(value, number)], names=["item", "_id", "score"])


def _rescored(searched: Searched, kind: pa.DataType):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            rows = []
            for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                words = terms_of(text or b"")
                rows += [(item, doc, total) for item, total in zip(wanted, searched.scores(words, wanted)) if total > 0] if words else []
            yield _pairs(rows, kind, pa.int64())
    return score


# ------------------------------------------------------------------ jobs


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", top: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item, rank, id, score): the ``top`` documents of each item with a score above 0, equal scores by ascending id.

    The query set is searched in blocks of about ``item_bytes`` of text, each against all documents; only a block
    of items is ever on the driver, with the corpus counts of its terms. Documents reach exact scoring by their id,
    in place where the ids fit a broadcast and by a salted join otherwise.

    Null and empty texts have no terms: such a document is in no list and not counted, such an item has no rows.
    Whole texts are read, whatever their length. Rows that share an id, null included, are documents of their own and
    may take a rank each, in no fixed order if their scores are equal too. Repeated items have their rows each.
    An empty table gives an empty result. Further columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    asked = items.select(F.col(f"`{item_col}`").alias("_item"), F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("_asked"))
    size = asked.agg(F.sum(F.octet_length("_asked").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(size / item_bytes))
    index, parts = None, []
    for number in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("_item", "_asked"), F.lit(blocks)) == number)
        texts = block.collect()
        searched_terms = [Counter(terms_of(r["_asked"].encode())) for r in texts]
        scan, corpus = _counted(rows, searched_terms, index is None)
        index = index if index is not None else scan.where("width IS NOT NULL").select("ids", "words", "width", "slices")
        ranked = _ranked(rows, index, Searched(searched_terms, corpus), top)
        names = rows.sparkSession.createDataFrame([(i, r["_item"]) for i, r in enumerate(texts)], f"item int, _item {asked.schema['_item'].dataType.simpleString()}")
        parts.append(ranked.join(F.broadcast(names), "item").select(
            F.col("_item").alias(item_col), "rank", F.col("_id").alias(id_col), "score"))
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionAll(more)
    return whole


def _arrow_kind(rows: DataFrame) -> pa.DataType:
    return to_arrow_type(rows.schema["_id"].dataType)


def _counted(rows: DataFrame, items: Sequence[Counter], index: bool) -> tuple[DataFrame, Corpus]:
    kind = rows.schema["_id"].dataType.simpleString()
    searched = frozenset(t for item in items for t in item)
    scan = settle(rows.mapInArrow(
        _scan(searched, _arrow_kind(rows), index),
        f"ids array<{kind}>, words array<bigint>, width int, slices binary, n_docs bigint, n_words bigint, terms array<binary>, docs array<bigint>"))
    documents, words = scan.agg(F.sum("n_docs"), F.sum("n_words")).first()
    pairs = scan.select(F.explode(F.arrays_zip("terms", "docs")).alias("_t")).groupBy("_t.terms").agg(F.sum("_t.docs").alias("docs"))
    return scan, Corpus(documents or 0, words or 0, {bytes(r["terms"]): r["docs"] for r in pairs.collect()})


def _ranked(rows: DataFrame, index: DataFrame, searched: Searched, top: int) -> DataFrame:
    kind, arrow = rows.schema["_id"].dataType.simpleString(), _arrow_kind(rows)
    bound_schema = f"item int, _id {kind}, score double"
    hopeful = index.mapInArrow(_promising(searched, arrow), bound_schema)
    seeds = _first(hopeful, [F.desc("score")], SEEDS)
    scored = _first(_scored(rows, seeds, searched).dropDuplicates(), [F.desc("score")], top)
    last = scored.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= top)
    least = [1] * len(searched.rows)
    for r in last.collect():
        least[r["item"]] = r["least"]
    chosen = index.mapInArrow(_reaching(searched, least, arrow), bound_schema)
    return _first(_scored(rows, chosen, searched), [F.desc("score"), F.asc_nulls_last("_id")], top)


def _first(pairs: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return pairs.withColumn("rank", place).where(F.col("rank") <= n)


def _scored(rows: DataFrame, pairs: DataFrame, searched: Searched) -> DataFrame:
    """Exact scores of the documents with these ids for these items, from their whole texts."""
    kind = rows.schema["_id"].dataType.simpleString()
    wanted = settle(pairs.groupBy("_id").agg(F.collect_set("item").alias("_wanted")))
    texts = attach_by_key(rows, wanted, ["_id"], how="inner")
    return texts.select("_id", "_text", "_wanted").mapInArrow(_rescored(searched, _arrow_kind(rows)), RESULT.format(kind=kind))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT count(*) AS nd, sum(len(w))::BIGINT AS nw FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
      FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
g AS (SELECT item_id, t, count(*) AS c FROM q GROUP BY ALL),
r AS (SELECT item_id, doc_id, sum(c * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nw))))::BIGINT AS score
      FROM g JOIN f USING (t) JOIN p USING (t), s GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""
