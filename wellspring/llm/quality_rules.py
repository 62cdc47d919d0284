"""Quality rules as weak supervision: each rule votes good, bad or abstains, and a label model weighs the votes.

Built-in functions only. One pass over the texts gives counts and votes; the label model works on the table of
vote patterns, at most three to the number of rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm.words import GAP_CHARS, char_count, let, whole_rows, words
from wellspring.operators.keyed import attach_by_key
from wellspring.session import settle

SYMBOLS = "#*$%&|<>"
WINDOW = 8
ROUNDS = 25
MIN_POSTERIOR = 0.5
# Where the label model starts, with the weight of so many documents, and its highest accuracy.
START_PRIOR, START_GOOD, START_BAD, START_WEIGHT, MOST = 0.8, 0.99, 0.4, 20.0, 0.9995

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in the text, from hashes of the windows in order.

    The windows are sorted by hash, only where any repeats, so long texts stay within n log n.
    """
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = let(ordered, lambda s: F.filter(s, lambda x, k: (
        F.coalesce((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"]), F.lit(False))
        | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))))
    places = F.sort_array(F.transform(repeats, lambda x: x["i"]))
    covered = let(places, lambda p: F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))))
    total = F.aggregate(covered, F.lit(0), lambda a, b: a + b)
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total).otherwise(0).cast("long")


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of the contract and those that only the rules use, one row per row of ``docs``."""
    rows = whole_rows(docs, id_col, text_col).select("_id", "_text", words(F.col("_text")).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.length(F.translate(line, GAP_CHARS, "")) > 0)
    rows = rows.select("_id", "_text", "_words", lines.alias("_line"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"))
    rows = rows.select(
        "_id", F.size("_words").cast("long").alias("n_words"), F.length(F.translate("_text", GAP_CHARS, "")).cast("long").alias("word_chars"),
        char_count(F.col("_text"), SYMBOLS).alias("n_symbols"),
        (F.size("_line") - F.size(F.array_distinct("_line"))).cast("long").alias("n_dup_lines"),
        F.size("_line").cast("long").alias("_lines"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "\\p{Lu}+", ""))).cast("long").alias("_upper"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "\\p{L}+", ""))).cast("long").alias("_letters"),
        F.size(F.filter("_words", lambda w: F.length(w) == 1)).cast("long").alias("_loose"),
        F.size(F.array_distinct("_h")).cast("long").alias("_distinct"),
        F.size(F.filter("_words", lambda w: w.endswith(".") | w.endswith("!") | w.endswith("?"))).cast("long").alias("_ends"), "_h")
    held = [c for c in rows.columns if c != "_h"]
    # Hashes of 8 words out of hashes of 4, out of hashes of 2: three steps whatever the window's content.
    step, span = "_h", 1
    while span < WINDOW:
        longer = F.zip_with(F.slice(step, F.lit(1), F.greatest(F.size(step) - span, F.lit(0))),
                            F.slice(step, F.lit(span + 1), F.greatest(F.size(step) - span, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        rows = rows.select(*held, longer.alias(f"_h{span}"))
        step, span = f"_h{span}", span * 2
    return rows.select(*held, repeated_words(F.col(step)).alias("n_repeat_words"))


def rule_votes() -> dict[str, Column]:
    """Votes over the counts: 1 good, 0 bad, null abstains. Each kind of defect is looked for by two rules at least."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    lines, chars = F.greatest(F.col("_lines"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, 0).when(good, 1).cast("int")

    return {
        "word_length": vote((chars >= 3 * n) & (chars <= 10 * n), (2 * chars < 3 * n) | (chars > 16 * n)),
        "symbols": vote(50 * F.col("n_symbols") <= n, 10 * F.col("n_symbols") > n),
        "same_lines": vote(10 * F.col("n_dup_lines") <= lines, 10 * F.col("n_dup_lines") > 5 * lines),
        "repeats": vote(10 * F.col("n_repeat_words") <= n, 5 * F.col("n_repeat_words") > n),
        "letters": vote(10 * F.col("_letters") >= 9 * chars, 10 * F.col("_letters") < 8 * chars),
        "loose": vote(10 * F.col("_loose") <= n, 10 * F.col("_loose") > 3 * n),
        "capitals": vote(10 * F.col("_upper") <= chars, 10 * F.col("_upper") > 3 * chars),
        "variety": vote(F.col("_distinct") * F.col("_distinct") >= 4 * n, F.col("_distinct") * F.col("_distinct") < n),
        "sentences": vote((100 * F.col("_ends") >= 3 * n) & (100 * F.col("_ends") <= 40 * n), 10 * F.col("_ends") > 6 * n),
    }


def posterior(votes: list[str], prior: float, good: list[float], bad: list[float]) -> str:
    """SQL for the probability of a good document. ``good`` and ``bad``: how often each rule is right about such documents.

    The weights are one array literal, so that rounds of the label model share their generated code.
    """
    weights = [math.log(prior / (1 - prior))]
    for g, b in zip(good, bad):
        weights += [math.log((1 - g) / b), math.log(g / (1 - b))]
    table = f"array({', '.join(f'{w!r}D' for w in weights)})"
    odds = [f"get({table}, 0)", *[f"coalesce(get({table}, {v} + {1 + 2 * j}), 0D)" for j, v in enumerate(votes)]]
    return f"1 / (1 + exp(-({' + '.join(odds)})))"


def label_model(patterns: DataFrame, votes: list[str], rounds: int = ROUNDS) -> tuple[float, list[float], list[float]]:
    """Expectation-maximisation over vote patterns with their counts ``n``: share of good documents and accuracies.

    Rules are taken as independent given the class; an abstention says nothing. Each round is one aggregate, of
    which two sums per rule come back. A rule starts as one that seldom blames a good document but sees only some of
    the bad ones. The starting values count as ``START_WEIGHT`` documents, which keeps the classes from
    swapping and defines the result for a table without votes.
    """
    prior, good, bad = START_PRIOR, [START_GOOD] * len(votes), [START_BAD] * len(votes)
    w = START_WEIGHT

    def sums(weight: str) -> list[str]:
        return [f"sum({weight})", *[f"sum(if({v} = {k}, {weight}, 0D))" for v in votes for k in (0, 1)]]

    def numbers(frame: DataFrame, weight: str) -> list[float]:
        return [float(x or 0) for x in frame.selectExpr(*[f"{x} AS s{i}" for i, x in enumerate(sums(weight))]).first()]

    whole = numbers(patterns, "n")
    for _ in range(rounds):
        up = numbers(patterns.selectExpr("n", *votes, f"{posterior(votes, prior, good, bad)} AS p"), "n * p")
        down = [x - y for x, y in zip(whole, up)]
        before = [prior, *good, *bad]
        prior = min(max((up[0] + w * START_PRIOR) / (whole[0] + w), 0.001), 0.999)
        good = [min(MOST, (up[2 + 2 * j] + w * START_GOOD) / (up[1 + 2 * j] + up[2 + 2 * j] + w)) for j in range(len(votes))]
        bad = [min(MOST, (down[1 + 2 * j] + w * START_BAD) / (down[1 + 2 * j] + down[2 + 2 * j] + w)) for j in range(len(votes))]
        if max(abs(x - y) for x, y in zip(before, [prior, *good, *bad])) < 1e-5:
            break
    return prior, good, bad


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: counts, hard failures, probability of good quality and whether it is kept.

    A document fails at once below 20 words or if more than 30 % of its words lie in repeated windows of 8
    words. All others are kept if the probability that the label model, fitted on all of them, gives them is at
    least ``MIN_POSTERIOR``.

    Null text counts as empty and fails; so do very short texts. Repeated rows get equal results. An empty table gives
    an empty result; further columns are ignored. Windows are compared by 64-bit hashes.
    """
    rules = rule_votes()
    names = [f"_vote_{r}" for r in rules]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counted = text_counts(docs, id_col, text_col).select("_id", *COUNTS, failed.alias("base_failed"),
                                                         *[v.alias(n) for n, v in zip(names, rules.values())])
    counted = settle(counted)
    patterns = settle(counted.where("NOT base_failed").groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1).sortWithinPartitions(*names)).coalesce(1)
    prior, good, bad = label_model(patterns, names, rounds)
    p = F.expr(posterior(names, prior, good, bad))
    return counted.select(F.col("_id").alias(id_col), *COUNTS, "base_failed", (~F.col("base_failed") & (p >= MIN_POSTERIOR)).alias("kept"),
                          F.round(p, 6).alias("posterior"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the rules keep, columns unchanged. Ids should be unique; rows that share one share its fate."""
    judged = judge_quality(docs, id_col, text_col)
    rejected = settle(judged.groupBy(id_col).agg(F.bool_or("kept").alias("kept")).where("NOT kept").select(id_col))
    return attach_by_key(docs, rejected, [id_col], how="left_anti", salt_by=[id_col])
