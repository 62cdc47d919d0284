"""Ranked search, neighbour packing and conversation repair against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.llm import conversations, edit_log, neighbour_packing, ranked_search
from wellspring.llm.tokens import encoder

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ------------------------------------------------------------------ ranked search


def plain_ranking(docs, items, top=10):
    terms = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    terms = [(i, c, sum(c.values())) for i, c in terms if c]
    n_docs, n_words = len(terms), sum(n for *_, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    rows = []
    for item, text in items:
        asked, scored = Counter(TERM.findall(lower(text))), []
        for i, c, n in terms:
            m = 100 - 75 + 75 * n * n_docs // n_words
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, k in asked.items() if c[t])
            if score:
                scored.append((-score, i is None, i or 0, i))
        rows += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return rows


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(draw.choices(vocabulary, weights=[1 / (k + 1) for k in range(300)], k=draw.randint(1, 60)))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, " .,;- "), (503, "W1 w1 W1, É é ÀB x_y w1-w2"), (504, docs[3][1]), (505, docs[3][1].upper()),
             (506, "w7 " * 30_000), (507, "long" * 5_000), (3, docs[3][1]), (3, docs[3][1]), (None, docs[9][1]), (508, "日本語 テスト w250")]
    items = [(i, " ".join(draw.choices(vocabulary, k=12))) for i in range(20)] + [
        (90, docs[3][1]), (91, None), (92, "nowhere-to-be-found zzz"), (93, "É w1 w1 W1"), (94, ""), (90, docs[3][1]), (95, "日本語 w250"), (96, "long" * 5_000)]
    return docs, items


def test_ranking_equals_scoring_everything(spark, corpus):
    docs, items = corpus
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, _id string, score int").repartition(5)
    asked = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, rank int")
    want = sorted(plain_ranking(docs, items), key=repr)
    for size in (ranked_search.ITEM_BYTES, 12_000):  # in one block and in many
        found = ranked_search.rank_documents(table, asked, item_bytes=size)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, found.collect()), key=repr) == want


def test_ranking_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.rank_documents(none, items).count() == 0
    assert ranked_search.rank_documents(some, items.where("false")).count() == 0
    assert [tuple(r) for r in ranked_search.rank_documents(some, items).collect()] == [(1, 1, 1, plain_ranking([(1, "a b")], [(1, "a")])[0][3])]


def test_bounds_never_fall_below_scores(corpus):
    docs, items = corpus
    words = [(i, ranked_search.terms_of((t or "").encode())) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    df = Counter(t.encode() if isinstance(t, str) else t for _, w in words for t in set(w))
    known = ranked_search.Corpus(len(words), sum(len(w) for _, w in words), dict(df))
    searched = ranked_search.Searched([Counter(ranked_search.terms_of((t or "").encode())) for _, t in items], known)
    held = []
    for i, w in words:
        counts = Counter(w)
        codes, tf = np.array([zlib.crc32(t) for t in counts], "u8"), np.array(list(counts.values()))
        held.append((i, len(w), np.concatenate([ranked_search.term_keys(codes[tf >= least], tier) for tier, least in enumerate(ranked_search.TIERS)])))
    by_id = defaultdict(list)
    for i, w in words:
        by_id[i].append(w)
    above = 0
    for ids, sizes, width, slices in ranked_search._blocks(held):
        bounds = searched.bounds(sizes, width, slices)
        for d, i in enumerate(ids):
            exact = searched.scores(by_id[i][0], range(len(items)))
            assert (bounds[:, d] >= exact).all()
            above += (bounds[:, d] > 0).sum()
    assert above < 0.9 * len(words) * len(items)


# ------------------------------------------------------------------ neighbour packing


def packing_rows():
    draw = random.Random(3)
    topics = [[f"t{k}x{i}" for i in range(40)] for k in range(6)]
    rows = [(i, " ".join(draw.choices(topics[i % 6], k=draw.randint(20, 120)))) for i in range(300)]
    return rows + [(900, None), (901, ""), (902, "word " * 30_000), (903, "<|endoftext|> here"), (5, rows[5][1]), (5, rows[5][1]), (None, "no id"), (None, rows[6][1])]


@pytest.mark.parametrize("task_tokens", [1 << 23, 5_000])
def test_neighbours_pack_every_id_once(spark, monkeypatch, task_tokens):
    rows = packing_rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, sequence_id int, n string").repartition(4)
    found = neighbour_packing.pack_neighbours(docs, task_tokens=task_tokens).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, neighbour_packing.pack_neighbours(docs, task_tokens=task_tokens).collect()))
    pieces = defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
    for name in {i for i, _ in rows}:
        texts = [encoder().encode(t or "") + np.array([1], "<u4").tobytes() for i, t in rows if i == name]
        want = Counter(len(t) // 4 for t in texts)
        starts = Counter(r.doc_tokens for r in pieces[name] if r.start == 0)
        assert starts == want
        assert sum(r.length for r in pieces[name]) == sum(len(t) // 4 for t in texts)
        for r in pieces[name]:
            assert any(len(t) == 4 * r.doc_tokens and zlib.crc32(t[4 * r.start:4 * (r.start + r.length)]) == r.ids_crc32 for t in texts)
    windows = defaultdict(list)
    for r in found:
        windows[r.sequence_id].append((r.offset, r.length))
    for laid in windows.values():
        at = 0
        for offset, length in sorted(laid):
            assert offset == at
            at += length
        assert at <= 2048
    short = sum(sum(n for _, n in laid) < 2048 for laid in windows.values())
    assert short <= max(1, math.ceil(sum(r.length for r in found) / task_tokens))


def test_neighbours_share_windows(spark):
    draw = random.Random(8)
    words = [w for w in (encoder().ranks.decode([i])[1:] for i in range(5_000, 20_000)) if w.isascii() and w.isalpha()]  # ids of their own
    topics = [words[60 * k:60 * (k + 1)] for k in range(12)]
    rows = [(i, " ".join(draw.choices(topics[i % 12], k=80))) for i in range(360)]
    found = neighbour_packing.pack_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    windows = defaultdict(set)
    for r in found:
        windows[r.sequence_id].add(r.doc_id)
    pairs = [a % 12 == b % 12 for held in windows.values() for a, b in itertools.combinations(held, 2)]
    assert sum(pairs) > 0.6 * len(pairs)  # by chance one in twelve


def test_neighbour_packing_without_rows(spark):
    assert neighbour_packing.pack_neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ------------------------------------------------------------------ conversation repair


def plain_edits(codes):
    """The least (cost, letters) by keeping whole letter texts."""
    def insert(best):
        best = dict(best)
        for _ in range(2):
            for state, (cost, letters) in list(best.items()):
                to = edit_log.NEXT[state, edit_log.NEEDED[state]]
                best[to] = min(best.get(to, (10**9, "")), (cost + 5, letters + "I"))
        return best

    best = {0: (0, "")}
    for code in codes:
        initial, fault = divmod(code, 3)
        after = {}
        for state, (cost, letters) in insert(best).items():
            options = [(state, cost + 2, "D")]
            if fault != 1:
                extra = 5 if fault == 2 else 0
                options.append((edit_log.NEXT[state, edit_log.NEEDED[state]], cost + 1 + extra, "R"))
                if (state, initial) in edit_log.NEXT:
                    options.append((edit_log.NEXT[state, initial], cost + extra, "K"))
            for to, total, letter in options:
                after[to] = min(after.get(to, (10**9, "")), (total, letters + letter))
        best = after
    best = insert(best)
    return min(best[s] for s in (0, 3) if s in best)


def all_edits(codes):
    """Every letter text with at most two insertions in a row."""
    found = []
    for gaps in itertools.product(range(3), repeat=len(codes) + 1):
        for choice in itertools.product("DKR", repeat=len(codes)):
            letters = "".join("I" * g + c for g, c in zip(gaps, [*choice, ""]))
            state, cost, left = 0, 0, iter(codes)
            for letter in letters:
                code = None if letter == "I" else next(left)
                if letter == "D":
                    cost += 2
                    continue
                if code is not None and code % 3 == 1:
                    break
                step = edit_log.NEXT.get((state, code // 3 if letter == "K" else edit_log.NEEDED[state]))
                if step is None:
                    break
                state = step
                cost += {"I": 5, "K": 0, "R": 1}[letter] + (5 if code is not None and code % 3 == 2 else 0)
            else:
                if state in (0, 3):
                    found.append((cost, letters))
    return min(found)


def test_edits_equal_trying_all():
    draw = random.Random(1)
    for n in range(4):
        for codes in itertools.product(range(12), repeat=n) if n < 3 else [draw.choices(range(12), k=3) for _ in range(150)]:
            assert edit_log.cheapest(bytes(codes)) == plain_edits(codes) == all_edits(codes)


@pytest.mark.parametrize("modulus", [edit_log.MODULUS, 3])  # with 3, most hashes collide
def test_edits_of_long_conversations(monkeypatch, modulus):
    monkeypatch.setattr(edit_log, "MODULUS", modulus)
    edit_log.cheapest.cache_clear()
    draw = random.Random(2)
    for _ in range(60):
        codes = draw.choices(range(12), weights=[1, 1, 1, 4, 1, 1, 4, 1, 1, 1, 1, 1], k=draw.randint(0, 120))
        want = plain_edits(codes)
        assert edit_log.cheapest(bytes(codes)) == want
        size = draw.randint(1, 9)
        blocks = [codes[i:i + size] for i in range(0, len(codes), size)]
        if blocks:
            parts = [edit_log.summary(b) for b in blocks]
            whole = edit_log.folded(parts)
            cost, leave = edit_log.best_exit(whole)
            ways = edit_log.route(parts, 0, leave)
            letters = "".join(edit_log.letters_between(b, a, x) for b, (a, x) in zip(blocks, ways)) + edit_log.CLOSING[leave]
            assert (cost, letters) == want
    edit_log.cheapest.cache_clear()


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range(0 if kind == 0 else 2 if kind == 3 else 1):
            yield conv, turn, "user" if kind == 4 else role, text


def plain_repair(rows):
    groups = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in plain_damage(rows):
        groups[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv, held in groups.items():
        codes, seen, counts, lines = [], set(), Counter(), []
        held.sort()
        for _, _, role, text in held:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            codes.append(("sua".find(role[0]) if role and role[0] in "sua" else 3) * 3 + {"blank": 1, "duplicate": 1, "truncated": 2, "": 0}[fault])
        roles = [r[:1] for _, _, r, _ in held]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        cost, audit = plain_edits(codes)
        state, left = 0, iter(held)
        for letter in audit:
            row = None if letter == "I" else next(left)
            if letter == "D":
                continue
            role = row[2] if letter == "K" else ["user", "user", "assistant", "user"][state]
            lines.append(f"{role}:{'' if letter == 'I' else row[3]}")
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
        turns = {t for known, t, *_ in held if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks():
    draw = random.Random(4)
    texts = ["Hello there.", "Is it?", "cut off", "", " \n", "Yes!", "Hello there.", "ends with gap. \n", None, "é日本.", "a\nb."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "umpire"]
    rows = []
    for conv in range(120):
        for turn in range(draw.randint(1, 12)):
            role = ["user", "assistant"][turn % 2] if draw.random() < 0.7 else draw.choice(roles)
            rows.append((conv, turn * 2 if draw.random() < 0.1 else turn, role, f"Number {turn} of {conv}." if draw.random() < 0.5 else draw.choice(texts)))
    rows += [(None, None, "user", "no place."), (None, 3, "assistant", "x."), (700, None, None, None), (None, None, "user", "no place.")]
    rows += [(800, t, ["user", "assistant"][t % 2], f"text {t} " + "long " * 2_000 + ".") for t in range(40)]
    rows += [(801, t, "user", f"part {t % 17}.") for t in range(300)]
    rows += [(802, 5, "user", "same.")] * 50
    return rows


@pytest.mark.parametrize("settings", [{}, {"long_rows": 7, "fan_out": 2}, {"long_bytes": 200, "long_rows": 3, "fan_out": 3}])
def test_repair_equals_the_plain_version(spark, talks, settings):
    rows = spark.createDataFrame([(*r, 1, "x") for r in talks], "conv_id long, turn long, role string, text string, place int, codes string").repartition(5)
    found = conversations.repair_report(conversations.damage(rows), **settings)
    assert found.columns == ["conv_id", *conversations.COUNTS, "audit", "repaired_sha256"]
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    assert got == plain_repair(talks)
    assert found.count() == len(got)


def test_pieces_are_the_repaired_conversations(spark, talks):
    rows = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    for settings in ({}, {"long_rows": 5}):
        _, pieces = conversations.repair_conversations(rows, **settings)
        messages = defaultdict(list)
        for r in sorted(pieces.collect(), key=lambda r: r.piece or 0):
            messages[r.conv_id] += r.messages
        for held in messages.values():
            assert re.fullmatch("(s?(ua)+)?", "".join(m.role[:1] for m in held))


def test_repair_without_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair_report(conversations.damage(none)).count() == 0
    gone = spark.createDataFrame([(c, t, "user", "x.") for c, t in [(1, 1), (2, 2)]], "conv_id long, turn long, role string, text string").withColumn("present", F.lit(False))
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, conversations.repair_report(gone).collect())) == [(1, 0, 0, 0, 0, 0, 0, "", empty), (2, 0, 0, 0, 0, 0, 0, "", empty)]
