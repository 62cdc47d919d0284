"""Registered queries without SQL against plain versions over whole tables."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

import corpus_pipeline
from wellspring.llm import jaccard, quality_rules, queries, training_order
from wellspring.llm.tokens import END_ID, encoder
from wellspring.session import settle

WORD = regex.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def ids_of(text):
    return [*np.frombuffer(encoder().encode(text or ""), "<u4").tolist(), END_ID]


def plain_votes(text):
    """None for texts that fail at once, else the nine votes."""
    w = WORD.findall(text)
    windows = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    repeated = len({k + d for k in range(len(w) - 7) if windows[tuple(w[k:k + 8])] > 1 for d in range(8)})
    if len(w) < 20 or 100 * repeated > 30 * len(w):
        return None
    n, chars = len(w), sum(map(len, w))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    same, symbols = len(lines) - len(set(lines)), len(regex.findall(r"[#*$%&|<>]", text))
    letters, upper = len(regex.findall(r"\p{L}", text)), len(regex.findall(r"\p{Lu}", text))
    loose, kinds, ends = sum(len(x) == 1 for x in w), len(set(w)), sum(x[-1] in ".!?" for x in w)
    tests = [
        (3 <= chars / n <= 10, chars < 1.5 * n or chars > 16 * n), (symbols <= n / 50, symbols > n / 10),
        (same <= len(lines) / 10, same > len(lines) / 2), (repeated <= n / 10, repeated > n / 5),
        (letters >= 0.9 * chars, letters < 0.8 * chars), (loose <= n / 10, loose > 0.3 * n),
        (upper <= chars / 10, upper > 0.3 * chars), (kinds * kinds >= 4 * n, kinds * kinds < n),
        (0.03 * n <= ends <= 0.4 * n, ends > 0.6 * n)]
    return [0 if bad else 1 if good else None for good, bad in tests]


def test_quality_verdict(spark, sf, documents):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    votes = {i: v for i, v in ((i, plain_votes(t)) for i, t in texts.items()) if v is not None}
    good = np.array([[v == 1 for v in row] for row in votes.values()], float)
    bad = np.array([[v == 0 for v in row] for row in votes.values()], float)
    m = quality_rules
    prior, right, wrong, w = m.START_PRIOR, np.full(9, m.START_GOOD), np.full(9, m.START_BAD), m.START_WEIGHT

    def chance():
        odds = math.log(prior / (1 - prior)) + good @ np.log(right / (1 - wrong)) + bad @ np.log((1 - right) / wrong)
        return 1 / (1 + np.exp(-odds))

    for _ in range(m.ROUNDS):
        p, before = chance(), [prior, *right, *wrong]
        prior = min(max((p.sum() + w * m.START_PRIOR) / (len(p) + w), 0.001), 0.999)
        right = np.minimum(m.MOST, (p @ good + w * m.START_GOOD) / (p @ good + p @ bad + w))
        wrong = np.minimum(m.MOST, ((1 - p) @ bad + w * m.START_BAD) / ((1 - p) @ good + (1 - p) @ bad + w))
        if np.abs(np.subtract(before, [prior, *right, *wrong])).max() < 1e-5:
            break
    want = dict(zip(votes, chance()))
    got = {r["doc_id"]: r for r in queries.op2_quality_rules(spark, sf).collect()}
    assert got.keys() == texts.keys() and {i for i in got if not got[i]["base_failed"]} == want.keys()
    assert all(abs(got[i]["posterior"] - p) < 2e-6 for i, p in want.items())
    assert all(got[i]["kept"] == (i in want and want[i] >= m.MIN_POSTERIOR) for i in got if abs(want.get(i, 0) - m.MIN_POSTERIOR) > 1e-6)


def test_training_order_bytes(spark, sf, documents):
    stream, owner = [], []
    for row in documents.collect():
        ids = ids_of(row["text"])
        stream += ids
        owner += [row["doc_id"]] * len(ids)
    n, size = -(-len(stream) // training_order.SIZE), training_order.SIZE
    want = {}
    for k, slot in enumerate(training_order.feistel(np.arange(n), n).tolist()):
        ids, docs = stream[k * size:(k + 1) * size], owner[k * size:(k + 1) * size]
        data = np.array(ids + [END_ID] * (size - len(ids)), "<u2").tobytes()
        runs = [d for j, d in enumerate(docs) if stream[k * size + j - 1] == END_ID or j == 0]
        want[slot] = (k, slot // training_order.SHARD_SEQUENCES, len(ids), zlib.crc32(data), runs)
    got = queries.op10_training_order(spark, sf).collect()
    assert {r["slot"]: (r["sequence_id"], r["shard"], r["length"], r["ids_crc32"], r["doc_ids"]) for r in got} == want and len(got) == n


def shingles(text):
    words = [regex.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_pipeline(spark, sf, documents):
    """Each stage against a plain version over what the stage before it kept."""
    rules, exact, near, mixed, _ = (stage for _, stage in corpus_pipeline.STAGES)
    judged = {r["doc_id"]: r["kept"] for r in queries.op2_quality_rules(spark, sf).collect()}
    table = settle(rules(spark, documents, sf))
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    assert texts.keys() == {i for i, kept in judged.items() if kept}

    table = settle(exact(spark, table, sf))
    groups = defaultdict(list)
    for i, text in texts.items():
        groups[regex.sub("[A-Z]", lambda m: m[0].lower(), text)].append(i)
    left = {r["doc_id"]: r["text"] for r in table.collect()}
    assert len(left) == len(groups) and all(len(left.keys() & set(ids)) == 1 for ids in groups.values())

    table = settle(near(spark, table, sf))
    sets = {i: shingles(t) for i, t in left.items()}
    holders, head = defaultdict(list), {i: i for i in left}
    for i, found in sets.items():
        for s in found:
            holders[s].append(i)

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, found in sets.items():
        shared = Counter(j for s in found for j in holders[s] if j < i)
        for j, both in shared.items():
            if 100 * both >= 80 * (len(found) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                head[b] = a
    kept = {r["doc_id"] for r in table.collect()}
    assert kept == {i for i in left if root(i) == i}

    table = settle(mixed(spark, table, sf))
    copies = Counter(r["doc_id"] for r in table.collect())
    assert copies.keys() <= kept and max(copies.values()) <= 3 and table.columns == documents.columns

    held, places = Counter(), defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        held[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert held == {i: n * len(ids_of(left[i])) for i, n in copies.items()}
    for parts in places.values():
        parts.sort()
        assert [at for at, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist() and sum(n for _, n in parts) <= 1024


def test_shingles_follow_the_rule():
    assert jaccard.Rule(5, 80, 100) == jaccard.Rule() and shingles("A b") == {("a", "b")} and shingles(" ") == set()
