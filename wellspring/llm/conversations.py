"""Repair of the turns of conversations, with an audit of the cheapest edits.

A conversation of usual length is repaired in one piece, in tasks that stream conversations in order. A long one is
sorted with all others of its kind and cut into blocks by place. Each block gives a summary of sixteen costs and
ranks; summaries of neighbouring blocks fold into one, block by block, up to the whole conversation, whose best way is
then handed down to the blocks. So no task ever holds more than a block of rows or some hundred summaries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wellspring.llm import edit_log
from wellspring.operators.keyed import attach_by_key, null_safe_join
from wellspring.operators.ordered import global_index, numbered
from wellspring.session import settle

GAPS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
LONG_ROWS = 20_000
LONG_BYTES = 16 * 1024 * 1024
FAN_OUT = 256
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_COUNT_FIELDS = ", ".join(f"{c} bigint" for c in COUNTS)
_MESSAGES = "array<struct<role: string, text: string>>"
_ARROW_MESSAGES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns with planted faults, by the checksum of ``conversation:turn``; a null in a row is one space.

    Of twenty remainders, 0 drops the row (``present`` is false), 1 empties its text, 2 removes ``.``, ``!`` and ``?``,
    3 repeats it and 4 sets the role user.
    """
    spaced = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col))) % 20
    text = spaced(text_col)
    damaged = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, "".join(ENDS), "")).otherwise(text)
    return rows.select(
        F.col(f"`{conv_col}`").alias(conv_col), F.col(f"`{turn_col}`").cast("bigint").alias(turn_col),
        F.when(kind == 4, F.lit("user")).otherwise(spaced(role_col)).alias(role_col), damaged.alias(text_col),
        (kind != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                         long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, fan_out: int = FAN_OUT) -> tuple[DataFrame, DataFrame]:
    """(one row of counts per conversation, the repaired conversations in pieces).

    Rows are taken by turn (nulls first), then role and text. A row's first fault counts: blank (no visible
    character), duplicate (role and text seen earlier), truncated (the last visible character ends no sentence). Keeping
    a row costs 0, a new role 1, deleting 2 (blank and duplicate rows must be deleted), an inserted turn without text 5,
    an undeleted truncated row 5 more. The cheapest edits that give role initials ``(s?(ua)+)?`` are chosen, of equal
    ones the ASCII-least. Counts also has the missing turn numbers (``gaps``) and the illegal neighbours.

    Pieces has (conversation, piece, audit, messages); in order of the pieces, their audits and messages are the whole
    conversation. A conversation of up to ``long_rows`` rows and ``long_bytes`` bytes is one piece, of a longer one each
    row is a piece. Where ``rows`` has a column ``present``, rows without it only name their conversation.

    Null role or text is one space; a role without initial is never kept. Rows without conversation id are one
    conversation. An empty table gives empty results. Further columns are ignored.
    """
    spaced = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    known = F.col("present") if "present" in rows.columns else F.lit(True)
    plain = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
                        spaced(role_col).alias("role"), spaced(text_col).alias("text"), F.coalesce(known, F.lit(False)).alias("present"))
    here = plain.where("present")
    long_ones = settle(
        here.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
        .where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select("conv", "n", F.lit(True).alias("is_long")))
    named = plain.where("NOT present").select("conv").distinct().select(
        "conv", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("present"))
    if long_ones.isEmpty():
        counts, pieces = _short(here.unionByName(named))
    else:
        marked = attach_by_key(here, long_ones, ["conv"], weight="n").drop("n")
        named = null_safe_join(named, long_ones, ["conv"], "left_anti")
        short = _short(marked.where("is_long IS NULL").drop("is_long").unionByName(named))
        long = _long(marked.where("is_long").select("conv", "turn", "role", "text"), long_rows, fan_out)
        counts, pieces = short[0].unionByName(long[0]), short[1].unionByName(long[1])
    return counts.withColumnRenamed("conv", conv_col), pieces.withColumnRenamed("conv", conv_col)


def repair_report(rows: DataFrame, conv_col: str = "conv_id", **settings) -> DataFrame:
    """Counts, audit and the SHA-256 of the repaired ``role:text`` lines of each conversation."""
    counts, pieces = repair_conversations(rows, conv_col, **settings)
    return null_safe_join(counts, digests(pieces, conv_col), [conv_col])


# ------------------------------------------------------------------ conversations of usual length


def _fault_code(role: str, text: str, repeated: bool) -> int:
    visible = text.rstrip(GAPS)
    fault = edit_log.DELETE if not visible or repeated else edit_log.SOUND if visible.endswith(ENDS) else edit_log.TRUNCATED
    return edit_log.code_of(role, fault)


def _repaired(rows: list[tuple]) -> tuple:
    """Counts, audit and messages of the rows (turn, role, text) of one conversation."""
    codes, seen, blank, duplicate, truncated = bytearray(), set(), 0, 0, 0
    for _, role, text in rows:
        code = _fault_code(role, text, (role, text) in seen)
        seen.add((role, text))
        fault = code % edit_log.FAULTS
        empty = fault == edit_log.DELETE and not text.rstrip(GAPS)
        blank += empty
        duplicate += fault == edit_log.DELETE and not empty
        truncated += fault == edit_log.TRUNCATED
        codes.append(code)
    turns = {turn for turn, *_ in rows if turn is not None}
    cost, audit = edit_log.cheapest(bytes(codes))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, blank, duplicate, truncated, edit_log.illegal_pairs(codes), cost, audit, edit_log.applied(audit, [(r, t) for _, r, t in rows])


def _repair_in_order(kind: pa.DataType):
    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, done = None, None, []

        def table() -> pa.RecordBatch:
            conv, results = zip(*done)
            *counts, audits, messages = zip(*results)
            lists = [[{"role": r, "text": t} for r, t in m] for m in messages]
            return pa.record_batch([pa.array(conv, kind), *[pa.array(c, pa.int64()) for c in counts], pa.array(audits, pa.string()), pa.array(lists, _ARROW_MESSAGES)],
                                   names=["conv", *COUNTS, "audit", "messages"])

        for batch in batches:
            for conv, turn, role, text, present in zip(*[c.to_pylist() for c in batch.columns]):
                if held is None or conv != current:
                    if held is not None:
                        done.append((current, _repaired(held)))
                    current, held = conv, []
                if present:
                    held.append((turn, role, text))
            if len(done) >= 1000:
                yield table()
                done = []
        if held is not None:
            done.append((current, _repaired(held)))
        if done:
            yield table()
    return repair


def _arrow_kind(df: DataFrame) -> pa.DataType:
    return to_arrow_type(df.schema["conv"].dataType)


def _short(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    kind = rows.schema["conv"].dataType.simpleString()
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    done = settle(ordered.mapInArrow(_repair_in_order(_arrow_kind(rows)), f"conv {kind}, {_COUNT_FIELDS}, audit string, messages {_MESSAGES}"))
    return done.select("conv", *COUNTS), done.select("conv", F.lit(None).cast("bigint").alias("piece"), "audit", "messages")


# ------------------------------------------------------------------ long conversations

_WAY = "costs array<bigint>, ranks array<int>, head int, tail int, blank bigint, duplicate bigint, truncated bigint, illegal bigint"


def _initial(role: Column) -> Column:
    first, found = F.substring(role, 1, 1), F.lit(edit_log.OTHER)
    for number, letter in enumerate(edit_log.INITIALS):
        found = F.when(first == letter, number).otherwise(found)
    return found


def _coded(placed: DataFrame, long_rows: int) -> DataFrame:
    """(conv, block, place, code, blank, duplicate): what the search needs of each row, without its text."""
    visible = F.rtrim(F.col("text"), F.lit(GAPS))
    narrow = placed.select(
        "conv", "place", _initial(F.col("role")).alias("initial"), (visible == "").alias("blank"),
        (~F.right(visible, F.lit(1)).isin(*ENDS)).alias("open"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"))
    first = settle(narrow.groupBy("conv", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    seen = attach_by_key(narrow, first, ["conv", "digest"], weight="n", salt_by=["place"])
    duplicate = ~F.col("blank") & F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    fault = F.when(F.col("blank") | duplicate, edit_log.DELETE).when(F.col("open"), edit_log.TRUNCATED).otherwise(edit_log.SOUND)
    return seen.select("conv", F.floor(F.col("place") / long_rows).alias("block"), "place",
                       (F.col("initial") * edit_log.FAULTS + fault).cast("int").alias("code"), "blank", duplicate.alias("duplicate"))


def _ordered(table: pa.Table, by: str) -> pa.Table:
    return table.sort_by(by)


def _cells(conv, schema: pa.Schema, **values) -> pa.Table:
    return pa.table([pa.array([values.get(f.name, conv)], f.type) for f in schema], schema=schema)


def _way_schema(kind: pa.DataType) -> pa.Schema:
    counts = [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]
    return pa.schema([("conv", kind), ("seq", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("head", pa.int32()), ("tail", pa.int32()), *counts])


def _summarised(schema: pa.Schema):
    def summarise(key: tuple, rows: pa.Table) -> pa.Table:
        rows = _ordered(rows, "place")
        codes = rows["code"].to_pylist()
        costs, ranks = edit_log.summary(codes)
        blank, duplicate = (int(np.sum(rows[c].to_numpy())) for c in ("blank", "duplicate"))
        return _cells(key[0].as_py(), schema, seq=key[1].as_py(), costs=costs, ranks=ranks, head=codes[0] // edit_log.FAULTS, tail=codes[-1] // edit_log.FAULTS,
                      blank=blank, duplicate=duplicate, truncated=sum(c % edit_log.FAULTS == edit_log.TRUNCATED for c in codes), illegal=edit_log.illegal_pairs(codes))
    return summarise


def _folded(schema: pa.Schema):
    def fold(key: tuple, rows: pa.Table) -> pa.Table:
        parts = _ordered(rows, "seq").to_pylist()
        costs, ranks = edit_log.folded([(p["costs"], p["ranks"]) for p in parts])
        between = sum((a["tail"], b["head"]) not in edit_log.LEGAL for a, b in zip(parts, parts[1:]))
        sums = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
        sums["illegal"] += between
        return _cells(key[0].as_py(), schema, seq=key[1].as_py(), costs=costs, ranks=ranks, head=parts[0]["head"], tail=parts[-1]["tail"], **sums)
    return fold


def _handed_down(kind: pa.DataType):
    schema = pa.schema([("conv", kind), ("seq", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32())])

    def hand(key: tuple, parts: pa.Table, way: pa.Table) -> pa.Table:
        rows, whole = _ordered(parts, "seq").to_pylist(), way.to_pylist()[0]
        ways = edit_log.route([(p["costs"], p["ranks"]) for p in rows], whole["entry"], whole["leave"])
        return pa.table([pa.array([key[0].as_py()] * len(rows), kind), pa.array([p["seq"] for p in rows], pa.int64()), pa.array([e for e, _ in ways], pa.int32()),
                         pa.array([x for _, x in ways], pa.int32())], schema=schema)
    return hand


def _edited():
    schema = pa.schema([("place", pa.int64()), ("letters", pa.string()), ("state", pa.int32())])

    def edit(key: tuple, rows: pa.Table, way: pa.Table) -> pa.Table:
        rows, whole = _ordered(rows, "place"), way.to_pylist()[0]
        codes = rows["code"].to_pylist()
        steps = edit_log.state_after(edit_log.letters_between(codes, whole["entry"], whole["leave"]), codes, whole["entry"])
        return pa.table([rows["place"].combine_chunks().cast(pa.int64()), pa.array([a for a, _ in steps], pa.string()), pa.array([s for _, s in steps], pa.int32())], schema=schema)
    return edit


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages of single rows: (conv, piece, audit, state, role, text)."""
    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("audit", "state", "role", "text")])
        lists = [[{"role": r, "text": t} for r, t in edit_log.applied(audit, [(role, text)], state)] for audit, state, role, text in rows]
        yield pa.record_batch([*[batch.column(c) for c in ("conv", "piece", "audit")], pa.array(lists, _ARROW_MESSAGES)], names=["conv", "piece", "audit", "messages"])


def _best_exits(kind: pa.DataType):
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways = [edit_log.best_exit((c, r)) for c, r in zip(batch.column("costs").to_pylist(), batch.column("ranks").to_pylist())]
            yield pa.record_batch([batch.column("conv"), pa.array([c for c, _ in ways], pa.int64()), pa.array([s for _, s in ways], pa.int32())], names=["conv", "cost", "leave"])
    return choose


def _long(rows: DataFrame, long_rows: int, fan_out: int) -> tuple[DataFrame, DataFrame]:
    kind, arrow = rows.schema["conv"].dataType.simpleString(), _arrow_kind(rows)
    schema = _way_schema(arrow)
    numbered_rows = rows.withColumn("copy", F.monotonically_increasing_id())
    placed = settle(global_index(numbered_rows, ["conv", "turn", "role", "text", "copy"], "place").drop("copy"))
    coded = settle(_coded(placed, long_rows))
    blocks = settle(coded.groupBy("conv", "block").applyInArrow(_summarised(schema), f"conv {kind}, seq bigint, {_WAY}"))
    dense = settle(numbered(blocks.withColumnRenamed("seq", "block"), ["conv"], ["block"], "seq").withColumn("seq", F.col("seq") - 1))
    levels, longest = [dense.drop("block")], dense.agg(F.max("seq")).first()[0]
    while longest:
        parent = levels[-1].withColumn("parent", F.floor(F.col("seq") / fan_out))
        levels.append(settle(parent.groupBy("conv", "parent").applyInArrow(_folded(schema), f"conv {kind}, seq bigint, {_WAY}")))
        longest //= fan_out
    exits = settle(levels[-1].select("conv", "costs", "ranks").mapInArrow(_best_exits(arrow), f"conv {kind}, cost bigint, leave int"))
    ways = exits.select("conv", F.lit(0).cast("bigint").alias("seq"), F.lit(edit_log.START).alias("entry"), "leave")
    for level in levels[-2::-1]:
        children = level.select("conv", "seq", "costs", "ranks", F.floor(F.col("seq") / fan_out).alias("parent"))
        down = children.groupBy("conv", "parent").cogroup(ways.withColumnRenamed("seq", "parent").groupBy("conv", "parent"))
        ways = settle(down.applyInArrow(_handed_down(arrow), f"conv {kind}, seq bigint, entry int, leave int"))
    by_block = null_safe_join(dense.select("conv", "seq", "block"), ways, ["conv", "seq"], "inner").select("conv", "block", "entry", "leave")
    edits = settle(coded.groupBy("conv", "block").cogroup(by_block.groupBy("conv", "block")).applyInArrow(
        _edited(), "place bigint, letters string, state int"))
    laid = placed.join(edits, "place").select("conv", F.col("place").alias("piece"), F.col("letters").alias("audit"), "state", "role", "text")
    pieces = laid.mapInArrow(_messages, f"conv {kind}, piece bigint, audit string, messages {_MESSAGES}")
    return _long_counts(placed, levels[-1], exits), pieces.unionByName(_closings(exits))


def _closings(exits: DataFrame) -> DataFrame:
    """The turns inserted behind the last row, as a piece that comes last."""
    turn = lambda i: F.struct(F.lit(edit_log.ROLES[i]).alias("role"), F.lit("").alias("text"))
    added = F.when(F.col("leave") == 1, F.array(turn(1), turn(2))).otherwise(F.array(turn(2)))
    audit = F.when(F.col("leave") == 1, "II").otherwise("I")
    return exits.where(F.col("leave").isin(1, 2)).select("conv", F.lit(2**62).cast("bigint").alias("piece"), audit.alias("audit"), added.cast(_MESSAGES).alias("messages"))


def _long_counts(placed: DataFrame, top: DataFrame, exits: DataFrame) -> DataFrame:
    turns = placed.where("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    both = null_safe_join(top.select("conv", "blank", "duplicate", "truncated", "illegal"), exits.select("conv", "cost"), ["conv"], "inner")
    return null_safe_join(both, turns, ["conv"]).withColumn("gaps", F.coalesce("gaps", F.lit(0))).select("conv", *COUNTS)


# ------------------------------------------------------------------ digests


def digests(pieces: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conversation, audit, repaired_sha256).

    A SHA-256 is one pass over its text by nature: a conversation of many pieces is sorted and streamed through one
    task, a piece at a time, which holds nothing but the audit that the row returns.
    """
    line = lambda m: F.concat(m["role"], F.lit(":"), m["text"])
    whole = pieces.where("piece IS NULL").select(conv_col, "audit", F.sha2(F.array_join(F.transform("messages", line), "\n"), 256).alias("repaired_sha256"))
    parts = pieces.where("piece IS NOT NULL")
    kind = pieces.schema[conv_col].dataType
    ordered = parts.select(F.col(f"`{conv_col}`").alias("conv"), "piece", "audit", F.transform("messages", line).alias("lines")).repartition("conv").sortWithinPartitions("conv", "piece")
    streamed = ordered.drop("piece").mapInArrow(_streamed(to_arrow_type(kind)), f"{conv_col} {kind.simpleString()}, audit string, repaired_sha256 string")
    return whole.unionByName(streamed)


def _streamed(kind: pa.DataType):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, audit, begun = None, None, [], False

        def row() -> pa.RecordBatch:
            return pa.record_batch([pa.array([current], kind), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=["conv", "audit", "sha"])

        for batch in batches:
            for conv, letters, lines in zip(*[c.to_pylist() for c in batch.columns]):
                if digest is None or conv != current:
                    if digest is not None:
                        yield row()
                    current, digest, audit, begun = conv, hashlib.sha256(), [], False
                audit.append(letters)
                for text in lines:
                    digest.update(("\n" + text if begun else text).encode("utf-8"))
                    begun = True
        if digest is not None:
            yield row()
    return stream
