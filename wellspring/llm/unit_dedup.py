"""Repeated lines and runs of words: normalised and hashed, the earliest occurrence of a digest stays and the others are cut out."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.words import mix, run_hashes, text_chunks, word_hashes
from wellspring.operators.keyed import attach_by_key
from wellspring.session import settle

MIN_WORDS = 8
RUN_WORDS = 50
MAP_BITS = 1 << 26
FACT_BYTES = 256 * 1024
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UNITS = "_unit int, _start bigint, _end bigint, _digest binary"


def text_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n", min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _unit, _start, _end, _digest) of each unit with at least ``min_words`` words; offsets count code points.

    Two units are alike if their words are, A-Z lower-cased; the spaces between and around them do not count.
    """
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, number, start, end, digest = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                at = 0
                for k, unit in enumerate((text or "").split(separator)):
                    words = unit.encode().lower().split()  # of bytes, so only A-Z and ASCII spaces count
                    if len(words) >= max(min_words, 1):
                        owner.append(row)
                        number.append(k)
                        start.append(at)
                        end.append(at + len(unit))
                        digest.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                    at += len(unit) + len(separator)
            yield pa.record_batch([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                                   pa.array(end, pa.int64()), pa.array(digest, pa.binary())], names=["_id", "_unit", "_start", "_end", "_digest"])

    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return rows.mapInArrow(split, f"_id {rows.schema['_id'].dataType.simpleString()}, {UNITS}")


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n", min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _unit, _start, _end, _first): every unit whose digest occurs earlier, with the id that keeps it. Rank: id, then place.

    Occurrences meet before the shuffle, so a line in a third of all documents costs one row per task. Only
    digests found more than once go on; a list of up to ``FACT_BYTES`` is broadcast after its size is measured.
    """
    units = settle(text_units(docs, id_col, text_col, separator, min_words))
    place = F.struct(F.col("_id").alias("id"), F.col("_unit").alias("unit"))
    digests = units.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")).where("_n > 1")
    digests = settle(digests.select("_digest", "_n", F.col("_first.id").alias("_first"), F.col("_first.unit").alias("_first_unit")))
    found = attach_by_key(units, digests, ["_digest"], weight="_n", how="inner", salt_by=["_id", "_unit"], broadcast_bytes=FACT_BYTES)
    later = ~(F.col("_id").eqNullSafe(F.col("_first")) & (F.col("_unit") == F.col("_first_unit")))
    return found.where(later).select("_id", "_unit", "_start", "_end", "_first")


def attach_to_texts(rows: DataFrame, facts: DataFrame, how: str = "left") -> DataFrame:
    """Join ``facts`` about ids, settled and one row for each, to ``rows`` (_id, _text). Only the texts that may have any are shuffled.

    A map of ``MAP_BITS`` bits, whatever the number of ids, marks the hashes of the ids in ``facts``. Texts without a mark stay
    where they are; those with one are joined by id, so a mark that two ids share costs a move and changes nothing.
    """
    cell = F.pmod(F.xxhash64("_id"), F.lit(MAP_BITS)) + 1
    bits = settle(facts.select(cell.alias("cell")).groupBy(F.bitmap_bucket_number("cell").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("_bits")))
    place = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("_bucket", F.bitmap_bucket_number(cell)).join(F.broadcast(bits), "_bucket", "left").withColumn(
        "_may", F.coalesce(F.getbit(byte.cast("long"), (place % 8).cast("int")) == 1, F.lit(False)))
    found = attach_by_key(marked.where("_may").select(*rows.columns), facts, ["_id"], how=how, salt_by=["_id"], broadcast_bytes=FACT_BYTES)
    if how == "inner":
        return found
    none = [F.lit(None).cast(field.dataType).alias(field.name) for field in facts.schema if field.name not in rows.columns]
    return found.unionByName(marked.where("NOT _may").select(*rows.columns, *none))


def _cut_words(text: str, spans: list[dict] | None, separator: str) -> np.ndarray | None:
    """Which words of a text are in the units that are cut."""
    if not spans:
        return None
    cut = {span["unit"] for span in spans}
    units = text.split(separator)
    return np.repeat([k in cut for k in range(len(units))], [len(unit.encode().split()) for unit in units])


def _open_runs(batch: pa.RecordBatch, run_words: int, separator: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, word hashes, which runs of ``run_words`` words have a word outside of the cut units) of each text that is long enough."""
    texts, spans = pc.fill_null(batch.column("_text"), ""), batch.column("_spans")
    for first, end, data, offsets in text_chunks(texts):
        values, counts = word_hashes(data, offsets)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        for row in np.flatnonzero(counts >= run_words) + first:
            value = values[bounds[row - first]:bounds[row - first + 1]]
            cut = _cut_words(texts[row].as_py(), spans[row].as_py(), separator) if spans[row].is_valid else None
            if cut is None:
                yield row, value, np.ones(len(value) - run_words + 1, bool)
            else:
                inside = np.concatenate([[0], np.cumsum(cut)])
                yield row, value, inside[run_words:] - inside[:-run_words] < run_words


def repeated_runs(rows: DataFrame, spans: DataFrame, run_words: int, separator: str = "\n") -> DataFrame:
    """(_id, _runs): the first word of every run of ``run_words`` words that occurs earlier, with the id of its first place. Rank: id, then place.

    ``rows`` has _id and _text, ``spans`` _id and _spans, the units that are cut; runs wholly within these do not count. A run's least hash of
    half its words depends on its words alone, so equal runs agree in it: these marks, about two in a quarter of ``run_words``
    words, are counted first, and only runs whose mark occurs again are hashed whole.
    """
    kind, half = rows.schema["_id"].dataType.simpleString(), run_words // 2

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, marks, low, high = [], [], [], []
            for row, value, is_open in _open_runs(batch, run_words, separator):
                runs = np.flatnonzero(is_open)
                if not len(runs):
                    continue
                part = run_hashes(value, half)
                place = np.lib.stride_tricks.sliding_window_view(part, run_words - half + 1).argmin(axis=1)[runs] + runs
                new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                owner.append(np.full(len(new), row))
                marks.append(part[place[new]])
                low.append(runs[new])
                high.append(runs[np.concatenate([new[1:], [len(runs)]]) - 1])
            owner, marks, low, high = (np.concatenate(x) if x else np.zeros(0, "u8") for x in (owner, marks, low, high))
            yield pa.record_batch([batch.column("_id").take(pa.array(owner.astype("i8"))), pa.array(marks.view("i8")), pa.array(low.astype("i4")), pa.array(high.astype("i4"))],
                                  names=["_id", "_mark", "_low", "_high"])

    def hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, one, two, at = [], [], [], []
            for row, value, is_open in _open_runs(batch, run_words, separator):
                wanted = np.zeros(len(is_open), bool)
                for span in batch.column("_ranges")[row].as_py():
                    wanted[span["_low"]:span["_high"] + 1] = True
                runs = np.flatnonzero(wanted & is_open)
                owner.append(np.full(len(runs), row))
                one.append(run_hashes(value, run_words)[runs])
                two.append(run_hashes(mix(value + np.uint64(run_words)), run_words)[runs])
                at.append(runs)
            owner, one, two, at = (np.concatenate(x) if x else np.zeros(0, "u8") for x in (owner, one, two, at))
            yield pa.record_batch([batch.column("_id").take(pa.array(owner.astype("i8"))), pa.array(one.view("i8")), pa.array(two.view("i8")), pa.array(at.astype("i4"))],
                                  names=["_id", "_one", "_two", "_at"])

    marks = settle(attach_to_texts(rows, spans).select("_id", "_text", "_spans").mapInArrow(mark, f"_id {kind}, _mark long, _low int, _high int"))
    again = settle(marks.groupBy("_mark").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    met = attach_by_key(marks, again, ["_mark"], weight="_n", how="inner", salt_by=["_id", "_low"], broadcast_bytes=FACT_BYTES)
    ranges = settle(met.groupBy("_id").agg(F.collect_set(F.struct("_low", "_high")).alias("_ranges")))
    hit = attach_to_texts(rows, settle(ranges.join(spans, "_id", "left")), "inner")
    runs = settle(hit.select("_id", "_text", "_spans", "_ranges").mapInArrow(hash_runs, f"_id {kind}, _one long, _two long, _at int"))
    place = F.struct(F.col("_id").alias("id"), F.col("_at").alias("at"))
    firsts = runs.groupBy("_one", "_two").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")).where("_n > 1")
    firsts = settle(firsts.select("_one", "_two", "_n", F.col("_first.id").alias("_first"), F.col("_first.at").alias("_first_at")))
    found = attach_by_key(runs, firsts, ["_one", "_two"], weight="_n", how="inner", salt_by=["_id", "_at"], broadcast_bytes=FACT_BYTES)
    later = ~(F.col("_id").eqNullSafe(F.col("_first")) & (F.col("_at") == F.col("_first_at")))
    return found.where(later).groupBy("_id").agg(F.sort_array(F.collect_set(F.struct(F.col("_at").alias("at"), F.col("_first").alias("first_id")))).alias("_runs"))


def _cut_runs(text: str, spans: list[dict], runs: list[dict], run_words: int, separator: str) -> tuple[list[dict], str]:
    """All spans that are cut, in order and apart from one another, and the text that is left."""
    cut = _cut_words(text, spans, separator)
    places = [m.span() for m in WORD.finditer(text)]
    pieces, upto = [], 0  # [first character, end, id that keeps it]
    for run in runs:
        begin, last = max(run["at"], upto), None
        for k in range(begin, min(run["at"] + run_words, len(places))):
            if cut is not None and cut[k]:
                last = None
                continue
            if last is None and pieces and k == begin == upto and k > 0 and pieces[-1][1] == places[k - 1][1]:
                last = pieces[-1]  # goes on with the run before
            if last is None:
                pieces.append(last := [*places[k], run["first_id"]])
            last[1] = places[k][1]
        upto = max(upto, run["at"] + run_words)
    whole = {span["unit"] for span in spans}
    removed, kept, at, j = list(spans), [], 0, 0
    for number, unit in enumerate(text.split(separator)):
        end = at + len(unit)
        if number not in whole:
            left, done, touched = "", at, False
            while j < len(pieces) and (pieces[j][0] < end or pieces[j][0] == at):
                begin, stop, first_id = pieces[j]
                if begin >= at:
                    removed.append({"unit": number, "start": begin, "end": stop, "first_id": first_id})
                left, touched = left + (text[done:begin].lstrip() if touched else text[done:max(begin, at)]), True
                done = min(max(stop, done), end)
                if stop > end:
                    break
                j += 1
            rest = text[done:end]
            left = left + rest.lstrip() if touched and rest.strip() else left.rstrip() if touched else rest
            if not touched or left.strip():
                kept.append(left)
        at = end + len(separator)
    return sorted(removed, key=lambda span: span["start"]), separator.join(kept)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n", min_words: int = MIN_WORDS,
                 run_words: int = 0) -> DataFrame:
    """One row per row of ``docs``: id, n_removed, removed (unit, start, end, first_id) and the text that is left.

    The spans are offsets in the original text, in order; a cut span takes one separator with it. Units below
    ``min_words`` words are never cut. Null text stays null. Rows that repeat an id and its text count as one
    document; of equal lines inside a document the first stays. Rows without id have no rank: they stay whole, and nothing is
    cut for what they hold. An empty table gives an empty result; further columns are ignored.

    With ``run_words`` (the separator must be white space) every run of so many words that occurs earlier is cut as well, wherever it
    begins and ends and whatever the lines; unit is then the one in which the span begins. What is cut as a unit is no occurrence.
    """
    if run_words and not separator.isspace():
        raise ValueError("runs of words need a separator of white space")
    ranked = docs.where(F.col(f"`{id_col}`").isNotNull())
    removed = repeated_units(ranked, id_col, text_col, separator, min_words).distinct()
    spans = settle(removed.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("_unit").alias("unit"), F.col("_start").alias("start"), F.col("_end").alias("end"), F.col("_first").alias("first_id")))).alias("_spans")))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    facts = spans
    if run_words:
        facts = settle(spans.join(repeated_runs(rows.where("_id IS NOT NULL"), spans, run_words, separator), "_id", "full"))
    rows = attach_to_texts(rows, facts)
    kind = spans.schema["_spans"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], batch.column("_spans").to_pylist()
            runs = batch.column("_runs").to_pylist() if run_words else [None] * len(removed)
            for row, (text, spans) in enumerate(zip(batch.column("_text").to_pylist(), removed)):
                if text is not None and runs[row]:
                    removed[row], text = _cut_runs(text, spans or [], runs[row], run_words, separator)
                elif text is not None and spans:
                    units = text.split(separator)
                    cut_units = {span["unit"] for span in spans}
                    text = separator.join(unit for k, unit in enumerate(units) if k not in cut_units)
                texts.append(text)
            yield pa.record_batch([batch.column("_id"), pa.array(removed, batch.column("_spans").type), pa.array(texts, pa.string())], names=["_id", "_spans", "_text"])

    cleaned = rows.select("_id", "_text", "_spans", *["_runs"] * bool(run_words)).mapInArrow(cut, f"_id {rows.schema['_id'].dataType.simpleString()}, _spans {kind}, _text string")
    return cleaned.select(F.col("_id").alias(id_col), F.when(F.col("_spans").isNull(), 0).otherwise(F.size("_spans")).alias("n_removed"),
                          F.coalesce("_spans", F.array().cast(kind)).alias("removed"), F.col("_text").alias(text_col))
