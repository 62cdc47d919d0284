"""Size-aware join of near-equal texts by the Jaccard similarity of their word n-grams.

Small sets enumerate their subsets of the sizes that two linked sets must share; large sets are found through inverted
lists. The boundary between the two is chosen by cost. Both searches find every link, candidates are checked exactly.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm.components import components
from wellspring.llm.words import mix, shingle_hashes, text_chunks, word_hashes
from wellspring.operators.keyed import attach_by_key
from wellspring.session import settle

MOST_SUBSETS = 500  # of a small set
LIST_COST = 4  # of one entry in an inverted list, in subsets
SPARE_BLOCKS = 2
PARITY_BITS = 512
PIVOT_SHARE = 64  # comparisons with one pivot that go to the same group
SKETCH_BITS = 20
SKETCH_SLICES = 16
MERGE = 32
STAR_ROUNDS = 8
PAIRS_PER_ENTRY = 4
FIRST_LISTS = 8  # of a set, by which a pair is told to have met before
_LIGHT, _HEAVY, _SECOND = np.uint64(0x632BE59BD9B4E019), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


@dataclass(frozen=True)
class Rule:
    """Two sets link when den * |A and B| >= num * |A or B|."""

    shingle: int = 5
    num: int = 80
    den: int = 100

    def spare(self, n: int) -> int:
        """Elements that a set of size n may have besides those it shares with a linked set."""
        return n - -(-self.num * n // self.den)

    def subsets(self, n: int) -> int:
        return sum(math.comb(n, d) for d in range(self.spare(n) + 1))

    def reach(self, n: int) -> int:
        """The largest set that can link with one of size n."""
        return n * self.den // self.num

    def levels(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """First size of each level and its number of blocks. Linked sets are in one level or in neighbouring ones.

        Sets that link over level i differ in at most s (den - num) / num elements, s its largest size. With one block
        more than that some block is equal in both; ``SPARE_BLOCKS`` more allow for empty ones.
        """
        first, start = [], 1
        while start <= most + 1:
            first.append(start)
            start = max(start + 1, (start - 1) * self.den // self.num + 1)
        ends = np.array([*first[1:], start]) - 1
        return np.array(first), ends * (self.den - self.num) // self.num + 1 + SPARE_BLOCKS

    def boundary_limit(self) -> int:
        """The largest boundary at which all sets that must list subsets have at most ``MOST_SUBSETS``."""
        x = 1
        while self.subsets(self.reach(x + 1)) <= MOST_SUBSETS:
            x += 1
        return x


def document_sets(texts: pa.Array, rule: Rule) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row, hash) of the distinct shingles of runs of texts, sorted by row and hash."""
    for first, end, data, offsets in text_chunks(texts):
        values, counts = word_hashes(data, offsets)
        yield first, end, *shingle_hashes(values, counts, rule.shingle)


def subset_keys(hashes: np.ndarray, rule: Rule) -> np.ndarray:
    """A key for each subset that a linked set may share: up to ``spare`` elements left out."""
    values = mix(hashes ^ _LIGHT)
    n, total, keys = len(values), values.sum(dtype="u8"), []
    for left_out in range(rule.spare(n) + 1):
        combos = np.array(list(itertools.combinations(range(n), left_out)), "i8").reshape(math.comb(n, left_out), left_out)
        keys.append(mix(total - values[combos].sum(axis=1, dtype="u8") + np.array([n - left_out], "u8") * _LIGHT))
    return np.concatenate(keys)


def block_keys(rows: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the inverted lists that a set is entered in, one for each block of its shingles.

    Blocks are ranges of the hash, as many as the level asks for; a key stands for the whole content of a block. A set is
    entered for its own level and for the one below. Empty blocks are entered only by sets with more of them
    than spare blocks: two linked sets without such have an equal block that is not empty.
    """
    first, blocks = rule.levels(int(sizes.max(initial=1)))
    own = np.searchsorted(first, sizes, "right") - 1
    values, out_rows, out_keys = mix(hashes ^ _HEAVY), [], []
    for down in (0, 1):
        level = own - down
        used = (level >= 0) & (sizes > 0)
        many = np.where(used, blocks[np.maximum(level, 0)], 1)
        token = used[rows]
        row, value = rows[token], values[token]
        if not len(row):
            continue
        block = ((hashes[token] >> np.uint64(32)) * many[row].astype("u8")) >> np.uint64(32)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        place = mix(level[row[at]].astype("u8") * _HEAVY + block[at])
        out_rows.append(row[at])
        out_keys.append(mix(np.add.reduceat(value, at) + place))
        filled = np.bincount(row[at], minlength=len(sizes))
        for r in np.flatnonzero(used & (many - filled > SPARE_BLOCKS)):
            empty = np.setdiff1d(np.arange(many[r], dtype="u8"), block[row == r])
            out_rows.append(np.full(len(empty), r))
            out_keys.append(mix(mix(level[r:r + 1].astype("u8") * _HEAVY + empty)))
    if not out_rows:
        return np.zeros(0, "i8"), np.zeros(0, "u8")
    return np.concatenate(out_rows), np.concatenate(out_keys)


def rare_keys(rows: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, rule: Rule, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the inverted lists that a set is entered in, one for each of its rarest shingles.

    Shingles are ordered by class of frequency, then by hash. Two linked sets have one in common among the first spare + 1
    of each, whatever the order is.
    """
    order = np.lexsort((hashes, classes[(hashes & np.uint64(len(classes) - 1)).astype("i8")], rows))
    row, value = rows[order], hashes[order]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    prefix = sizes - -(-rule.num * sizes // rule.den) + 1
    taken = np.arange(len(row)) - begin[row] < prefix[row]
    return row[taken], mix(value[taken] ^ _HEAVY)


def frequency_classes(docs: DataFrame, id_col: str, text_col: str, rule: Rule) -> np.ndarray:
    """Class of frequency for each of 2^``SKETCH_BITS`` hash cells: 0 ordinary, then the bits of what is above the mean.

    All documents are counted. A task adds up its documents in an array of fixed size, and a tree of tasks adds up the arrays.
    """
    cells = 1 << SKETCH_BITS
    width = cells // SKETCH_SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, "i8")
        for batch in batches:
            for _, _, _, hashes in document_sets(batch.column(0), rule):
                total += np.bincount((hashes & np.uint64(cells - 1)).astype("i8"), minlength=cells)
        part = TaskContext.get().partitionId()
        yield pa.record_batch([pa.array(range(SKETCH_SLICES), pa.int32()), pa.array([part] * SKETCH_SLICES, pa.int64()), pa.array([
            zlib.compress(total[k * width:(k + 1) * width].tobytes(), 1) for k in range(SKETCH_SLICES)], pa.binary())], names=["slice", "part", "counts"])

    def add(key, table):
        total = sum(np.frombuffer(zlib.decompress(v), "i8") for v in table.column("counts").to_pylist())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()),
                         "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "slice int, part bigint, counts binary"
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    parts, many = settle(texts.mapInArrow(count, schema)), texts.rdd.getNumPartitions()
    while many > 1:
        parts = settle(parts.withColumn("part", F.floor(F.col("part") / MERGE)).groupBy("slice", "part").applyInArrow(add, schema))
        many = -(-many // MERGE)
    counts = np.zeros(cells, "i8")
    for row in parts.collect():  # a fixed number of slices
        counts[row["slice"] * width:(row["slice"] + 1) * width] += np.frombuffer(zlib.decompress(row["counts"]), "i8")
    mean = counts.mean()
    over = np.maximum(counts - mean, 1)
    return np.where(counts > mean + 4 * math.sqrt(mean) + 4, np.ceil(np.log2(over)) + 1, 0).astype("u1")


def parities(rows: np.ndarray, hashes: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set a bit for each of its ``cells`` (a power of two, 64 at least), set if that cell of the hash holds an odd number of
    elements; all bits as 64-bit words and where each set's words begin."""
    begin = np.concatenate([[0], np.cumsum(cells)])
    cell = begin[rows] + (hashes & (cells[rows] - 1).astype("u8")).astype("i8")
    return np.packbits((np.bincount(cell, minlength=begin[-1]) & 1).astype(bool)).view("i8"), begin // 64


def set_rows(docs: DataFrame, id_col: str, text_col: str, rule: Rule, classes: np.ndarray | None) -> DataFrame:
    """(_id, n, d1, d2, odd, wide, light, heavy): size, 128-bit digest and parities of each document's set, keys of both searches.

    Sets near the boundary, which is chosen later, carry the keys of both. Two sets differ in at least as many elements as in
    parities. ``odd`` has ``PARITY_BITS`` of them, ``wide`` at least one for each element, as few cells say little of large sets.
    """
    limit = rule.boundary_limit()
    spread = docs.sparkSession.sparkContext.broadcast(classes)  # one byte for each cell of the sketch, or None

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, rows, hashes in document_sets(batch.column(1), rule):
                many = end - first
                sizes = np.bincount(rows, minlength=many)
                begin = np.concatenate([[0], np.cumsum(sizes)])
                digests = np.zeros((2, many), "u8")
                full = np.flatnonzero(sizes)
                if len(full):
                    digests[0, full] = np.add.reduceat(mix(hashes), begin[full])
                    digests[1, full] = np.add.reduceat(mix(hashes ^ _SECOND), begin[full])
                light = [subset_keys(hashes[begin[r]:begin[r + 1]], rule) if 0 < sizes[r] <= rule.reach(limit) else hashes[:0] for r in range(many)]
                row, key = block_keys(rows, hashes, sizes, rule) if spread.value is None else rare_keys(rows, hashes, sizes, rule, spread.value)
                order = np.argsort(row, kind="stable")
                heavy = pa.array(key[order].view("i8"))
                odd, odd_ends = parities(rows, hashes, np.full(many, PARITY_BITS))
                wide, wide_ends = parities(rows, hashes, 1 << np.ceil(np.log2(np.maximum(sizes, PARITY_BITS))).astype("i8"))
                light_ends, heavy_ends = np.cumsum([0, *map(len, light)]), np.concatenate([[0], np.cumsum(np.bincount(row, minlength=many))])
                yield pa.record_batch([
                    batch.column(0).slice(first, many), pa.array(sizes.astype("i8")), pa.array(digests[0].view("i8")), pa.array(digests[1].view("i8")),
                    pa.ListArray.from_arrays(pa.array(odd_ends, pa.int32()), pa.array(odd)),
                    pa.ListArray.from_arrays(pa.array(wide_ends, pa.int32()), pa.array(wide)),
                    pa.ListArray.from_arrays(pa.array(light_ends, pa.int32()), pa.array(np.concatenate([hashes[:0], *light]).view("i8"))),
                    pa.ListArray.from_arrays(pa.array(heavy_ends, pa.int32()), heavy)], names=["_id", "n", "d1", "d2", "odd", "wide", "light", "heavy"])

    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    return rows.mapInArrow(keys, f"_id {rows.schema['_id'].dataType.simpleString()}, n bigint, d1 bigint, d2 bigint, odd array<bigint>, wide array<bigint>, light array<bigint>, heavy array<bigint>")


def choose_boundary(rows: DataFrame, rule: Rule) -> int:
    """Sets up to this size are searched by subsets: the size with the least sum of subsets and list entries."""
    limit = rule.boundary_limit()
    many = rule.reach(limit)
    seen = {r["n"]: (r["docs"], r["entries"]) for r in rows.where(F.col("n").between(1, many)).groupBy("n").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.size("heavy")).alias("entries")).collect()}  # at most `many` rows

    def cost(x: int) -> int:
        subsets = sum(docs * rule.subsets(n) for n, (docs, _) in seen.items() if n <= rule.reach(x))
        return subsets + LIST_COST * sum(entries for n, (_, entries) in seen.items() if n > x)

    return min(range(1, limit + 1), key=lambda x: (cost(x), x))


def link_sets(docs: DataFrame, id_col: str, text_col: str, rule: Rule, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets (d1, d2, rep, copies) and the component of each rep that has a link to another."""
    x = choose_boundary(rows, rule)
    none = F.array().cast("array<bigint>")
    keys = F.concat(F.when(F.col("n") <= rule.reach(x), F.col("light")).otherwise(none), F.when(F.col("n") > x, F.col("heavy")).otherwise(none))
    classes = settle(rows.where("n > 0").groupBy("d1", "d2").agg(
        F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("odd").alias("odd"), F.first("wide").alias("wide")))
    copied = settle(classes.where("copies > 1").select("d1", "d2", "copies", "rep"))
    # The keys stay where they are: only rows of copied sets have to learn whether they stand for their class.
    first = attach_by_key(rows.where("n > 0 AND _id IS NOT NULL").select("_id", "d1", "d2", keys.alias("keys")), copied, ["d1", "d2"], weight="copies", salt_by=["_id"])
    entries = first.where("rep IS NULL OR rep = _id").select(F.col("_id").alias("rep"), F.explode(F.array_distinct("keys")).alias("key"))
    if not settle(rows.groupBy("_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 AND _id IS NOT NULL")).isEmpty():
        entries = entries.distinct()
    # A list of two members is their pair. Only the longer ones are looked up by their members.
    lists = settle(entries.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("pivot"), F.max("rep").alias("other")).where("c > 1"))
    longer = settle(lists.where("c > 2").select("key", "c", "pivot"))
    shared = settle(attach_by_key(entries, longer, ["key"], weight="c", how="inner", salt_by=["rep"]).where("rep <> pivot").select("rep", "key", "pivot"))
    # Long near copies share thousands of lists with the same members; one of these says it all.
    alike = shared.groupBy("key", "pivot").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("rep")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("s2"))
    alike = settle(alike.groupBy("pivot", "c", "s1", "s2").agg(F.min("key").alias("key")).select("key", "c"))
    shared = settle(attach_by_key(shared, alike, ["key"], weight="c", how="left_semi", salt_by=["rep"]))
    facts = classes.where("rep IS NOT NULL").select("rep", "n", "odd")
    pairs = lists.where("c = 2").select(F.col("pivot").alias("a"), F.col("other").alias("b")).unionAll(
        shared.select(F.col("pivot").alias("a"), F.col("rep").alias("b"))).distinct()
    pairs = pairs.join(facts.withColumnsRenamed({"rep": "b", "n": "nb", "odd": "odd_b"}), "b").join(facts.withColumnRenamed("rep", "a"), "a")
    close = _close(settle(pairs.where(may_link(rule, "odd", "odd_b", "n", "nb")).select("a", "b")), classes, rule)
    checked = settle(_verify(close, docs, id_col, text_col, rule))
    tied = settle(components(_links(checked)))
    open_, before = shared.select("rep", "key"), math.inf
    for number in itertools.count(1):
        comp = F.coalesce("component", "rep").alias("comp")
        open_ = open_.select("rep", "key").join(tied, F.col("rep") == F.col("node"), "left").select("rep", "key", comp)
        ends = open_.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
        open_ = settle(open_.join(ends, "key", "left_semi"))
        parts = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"))
        entries_left, pairs_left = parts.agg(F.sum("c"), F.sum((F.col("c") * F.col("c") - F.col("cc")) / 2)).first()
        if not entries_left:
            break
        # Rounds of stars go on while they leave half of the pairs or less.
        every = number > STAR_ROUNDS or pairs_left <= PAIRS_PER_ENTRY * entries_left or pairs_left > before / 2
        before, marked = pairs_left, open_.join(facts, "rep")
        if every:
            # A pair meets in each list it shares. It is passed over where it is sure to have met in a list of a smaller key.
            marked = marked.join(open_.groupBy("rep").agg(F.slice(F.sort_array(F.collect_set("key")), 1, FIRST_LISTS).alias("first")), "rep")
            other = marked.select(F.col("key").alias("key_b"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("comp_b"), F.col("odd").alias("odd_b"), F.col("first").alias("first_b"))
            met = F.coalesce(F.array_min(F.array_intersect("first", "first_b")) < F.col("key"), F.lit(False))
            pairs = marked.join(other, (F.col("key") == F.col("key_b")) & (F.col("rep") < F.col("b")) & (F.col("comp") != F.col("comp_b"))
                                & may_link(rule, "odd", "odd_b", "n", "nb") & ~met).select(F.col("rep").alias("a"), "b")
        else:
            centre = marked.groupBy("key").agg(F.min_by(F.struct("rep", "n", "comp", "odd"), F.xxhash64("rep", F.lit(number))).alias("p"))
            centre = centre.select("key", F.col("p.rep").alias("b"), F.col("p.n").alias("nb"), F.col("p.comp").alias("comp_b"), F.col("p.odd").alias("odd_b"))
            pairs = marked.join(centre, (marked["key"] == centre["key"]) & (marked["comp"] != centre["comp_b"]) & may_link(rule, "odd", "odd_b", "n", "nb"))
            pairs = pairs.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b"))
        pairs = settle(pairs.distinct().join(checked, ["a", "b"], "left_anti"))
        found = settle(_verify(_close(pairs, classes, rule), docs, id_col, text_col, rule))
        new = _links(found)
        checked = checked.unionAll(found)
        if not new.isEmpty():
            tied = settle(components(new.unionAll(tied.select(F.col("node").alias("u"), F.col("component").alias("v")))))
        if every:
            break
    return classes.select("d1", "d2", "rep", "copies"), tied


def _links(verified: DataFrame) -> DataFrame:
    return verified.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))


def may_link(rule: Rule, odd_a: str, odd_b: str, n_a: str, n_b: str) -> Column:
    """False for pairs that cannot link by their sizes or by the parities of their sets."""
    apart = " + ".join(f"bit_count(get({odd_a}, {k}) ^ get({odd_b}, {k}))" for k in range(PARITY_BITS // 64))
    sizes = f"{rule.num} * greatest({n_a}, {n_b}) <= {rule.den} * least({n_a}, {n_b})"
    return F.expr(f"{sizes} AND {rule.den + rule.num} * ({apart}) <= {rule.den - rule.num} * ({n_a} + {n_b})")


def _close(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs, settled, that can link by all parities of their sets.

    Sets that may link have as many cells or one has twice as many; its halves then fold into one.
    """
    wide = classes.where("rep IS NOT NULL").select("rep", "n", "wide")
    joined = pairs.join(wide.withColumnsRenamed({"rep": "b", "n": "nb", "wide": "wide_b"}), "b").join(wide.withColumnRenamed("rep", "a"), "a")

    def folded(own: str, other: str) -> str:
        half = f"size({other})"
        return f"IF(size({own}) > {half}, zip_with(slice({own}, 1, {half}), slice({own}, {half} + 1, {half}), (p, q) -> p ^ q), {own})"

    apart = f"aggregate(zip_with({folded('wide', 'wide_b')}, {folded('wide_b', 'wide')}, (p, q) -> bit_count(p ^ q)), 0, (x, y) -> x + y)"
    return settle(joined.where(f"{rule.den + rule.num} * {apart} <= {rule.den - rule.num} * (n + nb)").select("a", "b"))


def _verify(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, rule: Rule) -> DataFrame:
    """(a, b, linked) of settled pairs, from the sets of their texts.

    Sets are made once and shuffled once: that of each b goes to a group of its pivot a, whose own set goes to all its groups
    and comes first there. A task holds the pivot's set and one batch.
    """
    pivots = settle(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).withColumn("parts", F.ceil(F.col("c") / PIVOT_SHARE).cast("int")))
    roles = attach_by_key(pairs, pivots, ["a"], weight="c", salt_by=["b"]).select(
        F.col("b").alias("rep"), "a", F.expr("pmod(xxhash64(b), parts)").cast("int").alias("part"), F.lit(False).alias("pivot"), F.lit(1).alias("one"))
    roles = settle(roles.unionAll(pivots.select(
        F.col("a").alias("rep"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("pivot"), F.lit(1).alias("one"))))
    kind = roles.schema["rep"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, rows, hashes in document_sets(batch.column(1), rule):
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=end - first))])
                h = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes.view("i8")))
                yield pa.record_batch([batch.column(0).slice(first, end - first), h], names=["rep", "h"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, of = np.zeros(0, "u8"), None
        for batch in batches:
            a, part, pivot = (batch.column(c).to_pylist() for c in ("a", "part", "pivot"))
            lists, kept, linked = batch.column("h"), [], []
            for row in range(batch.num_rows):
                own = lists[row].values.to_numpy().view("u8")
                if pivot[row]:
                    centre, of = own.copy(), (a[row], part[row])
                elif of != (a[row], part[row]):
                    raise RuntimeError("the set of a pivot is missing")
                else:
                    place = np.minimum(np.searchsorted(centre, own), max(len(centre) - 1, 0))
                    both = int(np.count_nonzero(centre[place] == own)) if len(centre) else 0
                    kept.append(row)
                    linked.append(rule.den * both >= rule.num * (len(centre) + len(own) - both))
            at = pa.array(kept, pa.int64())
            yield pa.record_batch([batch.column("a").take(at), batch.column("rep").take(at), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    rows = docs.select(F.col(f"`{id_col}`").alias("rep"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    rows = attach_by_key(rows, settle(roles.select("rep").distinct()), ["rep"], how="inner", salt_by=["rep"])
    members = attach_by_key(rows.mapInArrow(sets, f"rep {kind}, h array<bigint>"), roles, ["rep"], weight="one", how="inner", salt_by=["rep"])
    members = members.select("a", "part", "pivot", "rep", "h").repartition("a", "part").sortWithinPartitions("a", "part", F.desc("pivot"))
    return members.mapInArrow(compare, f"a {kind}, b {kind}, linked boolean").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule(), terms: str = "shingles") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles and component_id, the smallest id reachable by links.

    Words are runs of other characters than space and \\t to \\r, A-Z lower-cased. A set holds the distinct shingles of the whole
    text; with fewer words, the whole sequence is the only one; without words it is empty and links with nothing.

    Equal sets are one class from the start, so copies are never paired. Small classes list subsets, large ones enter inverted lists:
    ``terms="shingles"`` lists the rarest shingles, which suits long shingles that rarely agree by chance;
    ``terms="blocks"`` lists whole blocks of shingles, which stays selective where short ones do. In every list the members are first
    compared with one of them. Only members that are not yet connected are compared further, so a list of near copies costs about
    as many comparisons as it has members; a list with many members and no links between them needs all its pairs, as
    any exact join does. Sets are compared by 64-bit hashes of the shingles.

    Null text is empty. Ids identify documents: rows that repeat an id must repeat its text. Rows without id are grouped with equal
    sets only. An empty table gives an empty result; further columns are ignored.
    """
    classes = frequency_classes(docs, id_col, text_col, rule) if terms == "shingles" else None
    rows = settle(set_rows(docs, id_col, text_col, rule, classes))
    groups, tied = link_sets(docs, id_col, text_col, rule, rows)
    named = groups.join(tied, F.col("rep") == F.col("node"), "left").select("d1", "d2", "copies", F.coalesce("component", "rep").alias("component"), "rep")
    named = settle(named.where("copies > 1 OR component <> rep").select("d1", "d2", "copies", "component"))
    found = attach_by_key(rows.select("_id", "n", "d1", "d2"), named, ["d1", "d2"], weight="copies", salt_by=["_id"])
    return found.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "_id")).otherwise(F.col("_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule(), terms: str = "shingles") -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group of near copies; columns unchanged."""
    groups = near_groups(docs, id_col, text_col, rule, terms)
    dropped = settle(groups.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct())
    return attach_by_key(docs, dropped, [id_col], how="left_anti", salt_by=[id_col])
