"""Words of a text as Column expressions and, inside tasks, as numpy arrays over a whole batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAP = "[\\x20\\x09-\\x0D]+"
GAP_CHARS = " \t\n\x0b\f\r"
CHUNK_BYTES = 256 * 1024  # the arrays over a chunk take about 50 times as much


def lower_az(text: Column) -> Column:
    """Lower-case A to Z and nothing else; ``lower`` would also change other letters."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Words of a text: runs of other characters than space and \\t to \\r. Null gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def char_count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def whole_rows(docs: DataFrame, id_col: str, text_col: str, *also: str) -> DataFrame:
    """Id and text under fixed names, null text as empty, with no other columns but ``also``."""
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"),
                       *[F.col(f"`{c}`") for c in also])


# ------------------------------------------------------------------ inside tasks

_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, "u8"), np.full(max(n - 1, 0), base, "u8")]))


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        _tables.update(up=_powers(_BASE, n), down=_powers(_INVERSE, n))
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, end row, bytes, offsets); at most ``limit`` bytes unless a single text is longer."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], "i8")[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], "u1") if texts.buffers()[2] is not None else np.zeros(0, "u1")
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and the number of words of each row.

    A text longer than ``limit`` bytes is read in blocks that end behind a gap.
    """
    if len(data) <= limit:
        return _block_hashes(data, offsets)
    values, counts, at = [], np.zeros(len(offsets) - 1, "i8"), 0
    while at < len(data):
        end = min(at + limit, len(data))
        rest = data[end:]
        gaps = np.flatnonzero((rest == 32) | ((rest >= 9) & (rest <= 13))) if at + limit < len(data) else rest[:0]
        end = end + int(gaps[0]) + 1 if len(gaps) else len(data)
        value, count = _block_hashes(data[at:end], np.clip(offsets - at, 0, end - at))
        values.append(value)
        counts += count
        at = end
    return np.concatenate(values), counts


def _block_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A word's hash is the value of its bytes as a polynomial modulo 2^64, taken from running sums over the
    whole block, so no work is done word by word."""
    n = len(data)
    up, down = _power_tables(n + 1)
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    gap = (low == 32) | ((low >= 9) & (low <= 13))
    head = np.zeros(n + 1, bool)  # a text begins here
    head[offsets[offsets <= n]] = True
    word = ~gap
    before = np.concatenate([[False], word[:-1]]) if n else word
    starts = np.flatnonzero(word & (~before | head[:n]))
    after = np.concatenate([word[1:], [False]]) if n else word
    ends = np.flatnonzero(word & (~after | head[1:])) + 1
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum((low.astype("u8") + np.uint64(1)) * up[:n], dtype="u8")])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix(value), np.diff(np.searchsorted(starts, offsets))


def run_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words of one text, from running sums."""
    n = len(values)
    up, down = _power_tables(n + 1)
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(values * up[:n], dtype="u8")])
    return mix((sums[size:] - sums[:-size]) * down[:max(n - size + 1, 0)])


def shingle_hashes(values: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct shingle of ``size`` words, sorted by row and hash.

    A row with fewer words, but any, has its whole sequence as its only shingle.
    """
    total, rows = len(values), len(counts)
    first = np.concatenate([[0], np.cumsum(counts)]).astype("i8")
    row = np.repeat(np.arange(rows), counts)
    n = max(total - size + 1, 0)
    value = np.zeros(n, "u8")
    for k in range(size):
        value = mix(value * np.uint64(0xD6E8FEB86659FD93) + values[k:k + n])
    full = row[:n] == row[size - 1:] if n else np.zeros(0, bool)
    of, value = row[:n][full], value[full]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.empty(len(short), "u8")
        for j, r in enumerate(short):
            whole[j] = np.uint64(counts[r])
            for v in values[first[r]:first[r + 1]]:
                whole[j:j + 1] = mix(whole[j:j + 1] * np.uint64(0xD6E8FEB86659FD93) + v)
        of, value = np.concatenate([of, short]), np.concatenate([value, whole])
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    return of[new], value[new]
