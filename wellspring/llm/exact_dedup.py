"""Exact duplicates: rows grouped by a 128-bit content hash, then compared byte by byte inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm.words import lower_az, whole_rows
from wellspring.operators.keyed import attach_by_key, null_safe_join
from wellspring.session import settle


def content_hash(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                 digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row for each row of ``docs``: its id, the id that stays, the size of its group and the text's SHA-256.

    Texts are equal if identical after lower-casing A-Z. ``keep`` is "max" or "min" of the ids. The first pass moves
    only hashes. Texts of hashes found more than once are then grouped by hash *and* text, which compares their bytes;
    copies meet before the shuffle, so a huge group costs one row per task. A hash with several texts is a
    collision: its rows are matched by text.

    Null text counts as empty; empty texts are equal to each other. A null id never stays if the group has another;
    rows that repeat the id that stays are all marked as kept (``drop_copies`` leaves one). An empty table gives
    an empty result; further columns are ignored.
    """
    best = F.max if keep == "max" else F.min
    rows = whole_rows(docs, id_col, text_col).select("_id", lower_az(F.col("_text")).alias("_text"))
    rows = rows.select("_id", "_text", digest(F.col("_text")).alias("_hash"))
    hashed = settle(rows.select("_id", "_hash", F.sha2("_text", 256).alias("_sha")))
    suspects = settle(hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    texts = attach_by_key(rows, suspects.select("_hash"), ["_hash"], how="left_semi", salt_by=["_id"])
    grouped = texts.groupBy("_hash", "_text").agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_keep"))
    groups = settle(grouped.select("_hash", "_n", "_keep"))
    collided = settle(groups.groupBy("_hash").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1").select("_hash"))
    if collided.isEmpty():
        found = attach_by_key(hashed, groups, ["_hash"], weight="_n", salt_by=["_id"])
    else:
        clean = null_safe_join(groups, collided, ["_hash"], "left_anti")
        several = settle(null_safe_join(texts, collided, ["_hash"], "left_semi"))
        by_text = several.groupBy("_hash", "_text").agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_keep"))
        found = null_safe_join(several, by_text, ["_hash", "_text"]).select(
            "_id", "_hash", F.sha2("_text", 256).alias("_sha"), "_n", "_keep")
        found = found.unionByName(attach_by_key(null_safe_join(hashed, collided, ["_hash"], "left_anti"), settle(clean), ["_hash"],
                                                weight="_n", salt_by=["_id"]).select(found.columns))
    alone = F.col("_n").isNull()
    keep_id = F.when(alone, F.col("_id")).otherwise(F.col("_keep"))
    return found.select(
        F.col("_id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("_n", F.lit(1)).alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``docs`` without the copies, columns unchanged. Rows that repeat an id and its text are copies too.

    Rows go by id. Only ids that stay with one text and go with another, or stay in several rows, are told apart by id
    and text. Null ids are ids like others. Any names of columns will do. An empty table stays empty.
    """
    groups = settle(exact_groups(docs, id_col, text_col, keep))
    dropped = settle(groups.where("NOT kept").select(id_col, "text_sha256"))
    counted = groups.groupBy(id_col).agg(F.count_if("kept").alias("_stay"), F.count_if(~F.col("kept")).alias("_go"))
    several = settle(counted.where("_stay > 1 OR (_stay > 0 AND _go > 0)").select(id_col))
    left = attach_by_key(docs, settle(dropped.select(id_col).distinct()), [id_col], how="left_anti", salt_by=[id_col])
    if several.isEmpty():
        return left
    digest = "_sha"
    while digest in docs.columns:
        digest += "_"
    again = attach_by_key(docs, several, [id_col], how="left_semi", salt_by=[id_col])
    again = again.withColumn(digest, F.sha2(lower_az(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), 256)).dropDuplicates([id_col, digest])
    again = null_safe_join(again, dropped.withColumnRenamed("text_sha256", digest).distinct(), [id_col, digest], "left_anti").drop(digest)
    return attach_by_key(left, several, [id_col], how="left_anti", salt_by=[id_col]).unionByName(again)
