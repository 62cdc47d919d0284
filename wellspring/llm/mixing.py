"""Mixing sources to target weights: random order within each source, prefix sums of sizes, a cut at the exact budget."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm.words import words
from wellspring.operators.keyed import attach_by_key
from wellspring.session import settle

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = "mix-1"
BUCKET_ROWS = 8192
KEY_BITS = 60


def random_key(id_col: Column, seed: str = SEED) -> Column:
    """A hash of seed and id, 32 hex digits: the place of a document in its source's random order."""
    return F.md5(F.concat_ws("|", F.lit(seed), id_col.cast("string")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, docs, target) of a table of documents with ``_source`` and ``_size``.

    Sources in code-point order, null last, take the weights in turn. Targets share the sum of all sizes by weight;
    none is above ``most`` times its source's size, and what is cut goes to the others by weight, until
    none is above. Each round is one aggregate over the table of sources.
    """
    sources = sizes.groupBy("_source").agg(F.sum("_size").alias("_source_size"), F.count(F.lit(1)).alias("_docs"))
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(int(w)) for w in weights])
    sources = settle(sources.withColumn("_weight", F.get(table, F.pmod(place, F.lit(len(weights)))).cast("double")))
    whole = sources.agg(F.sum("_source_size")).first()[0] or 0
    level, cap = 0.0, F.col("_source_size") * most
    while True:
        full = cap <= F.col("_weight") * level if level else F.col("_source_size") == 0
        fixed, free = sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("_weight")))).first()
        if not free:
            break
        new = (whole - (fixed or 0)) / free
        if new <= level:
            break
        level = new
    return sources.withColumn("_target", F.when(cap <= F.col("_weight") * level, cap.cast("double")).otherwise(F.col("_weight") * level))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: id, size in words, its source's size and target, and the words the mix takes.

    A source gives whole epochs while its target holds them. Of the last one it gives the first documents in the
    order of the hash keys, up to the exact budget (the target rounded down); the document at the cut gives only its
    first words. So a source's taken words are its target but for less than a word.

    The order is cut into ranges of the keys. These are uniform, so ranges of equal width hold about equal
    numbers of rows and a source with a third of all rows is spread over many tasks. Prefix sums run inside the ranges
    and over the sums of the ranges.

    Null text has size 0; null is a source of its own, last in order. Documents of size 0 are taken with 0 words. Equal keys
    (repeated ids) are ordered by size. An empty table gives an empty result; further columns are ignored.
    """
    sizes = settle(docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("_source"),
        F.size(words(F.col(f"`{text_col}`").cast("string"))).cast("long").alias("_size"), random_key(F.col(f"`{id_col}`"), seed).alias("_key")))
    sources = source_targets(sizes, weights, most)
    budget = F.floor(F.col("_target")).cast("long")
    epochs = F.when(F.col("_source_size") > 0, F.floor(budget / F.greatest(F.col("_source_size"), F.lit(1)))).otherwise(0).cast("long")
    sources = settle(sources.select("_source", "_source_size", "_docs", "_target", epochs.alias("_epochs"),
                                    (budget - epochs * F.col("_source_size")).alias("_rest")))
    rows = attach_by_key(sizes, sources, ["_source"], weight="_docs", salt_by=["_id"])
    # Ranges of the key's first 60 bits; their number follows the source's rows, its square root beyond 64 million.
    ranges = F.ceil(F.col("_docs") / F.greatest(F.lit(float(BUCKET_ROWS)), F.sqrt("_docs")))
    head = F.conv(F.substring("_key", 1, KEY_BITS // 4), 16, 10).cast("double") / float(1 << KEY_BITS)
    rows = rows.withColumn("_range", F.floor(head * ranges).cast("long"))
    totals = rows.groupBy("_source", "_range").agg(F.sum("_size").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    totals = settle(totals.select("_source", "_range", F.coalesce(before, F.lit(0)).alias("_before")))
    inside = Window.partitionBy("_source", "_range").orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_until", F.sum("_size").over(inside))
    placed = attach_by_key(placed, totals, ["_source", "_range"], salt_by=["_id"])
    start = F.col("_before") + F.col("_until") - F.col("_size")
    last = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - start))
    return placed.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                         F.col("_target").alias("target"), (F.col("_epochs") * F.col("_size") + last).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it, columns unchanged.

    Documents stay whole: the one at a source's cut is taken if at least half of its words are. Ids should be
    unique; rows that share an id are taken as often as the one of them that is taken most. Rows without id count as sharing one.
    Further columns are kept, whatever their names.
    """
    mixed = mix_sources(docs, id_col, text_col, source_col, weights, most, seed)
    copies = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.greatest(F.col("size"), F.lit(1))))).otherwise(0)
    many = "_copies"
    while many in docs.columns:
        many += "_"
    copies = settle(mixed.groupBy(id_col).agg(F.max(copies).cast("int").alias(many)).where(F.col(many) > 0))
    joined = attach_by_key(docs, copies, [id_col], how="inner", salt_by=[id_col])
    return joined.withColumn(many, F.explode(F.sequence(F.lit(1), F.col(many)))).drop(many)


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix-1|' || doc_id::VARCHAR) AS key FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, sum(3 * source_size) OVER o AS caps, sum(w) OVER () - sum(w) OVER o AS free, sum(source_size) OVER () AS whole,
         row_number() OVER (ORDER BY 3 * source_size / w, source) AS i
  FROM sources WINDOW o AS (ORDER BY 3 * source_size / w, source)),
levels AS (
  SELECT max(level) AS level FROM (
    SELECT max(whole) / sum(w) AS level FROM ordered
    UNION ALL SELECT (whole - caps) / free FROM ordered
    WHERE free > 0 AND 3 * source_size / w <= (whole - (caps - 3 * source_size)) / (free + w))),
targets AS (
  SELECT source, source_size, least(3.0 * source_size, w * level) AS target,
         CASE WHEN source_size > 0 THEN floor(floor(least(3.0 * source_size, w * level)) / source_size)::BIGINT ELSE 0 END AS epochs
  FROM sources, levels),
placed AS (
  SELECT doc_id, size, source_size, target, epochs, floor(target)::BIGINT - epochs * source_size AS rest,
         (sum(size) OVER (PARTITION BY s.source ORDER BY key, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - start)))::BIGINT AS taken FROM placed
"""
