"""Each operator against a plain version on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.llm import components, exact_dedup, jaccard, licenses, mixing, packing, quality_model, quality_rules, training_order, unit_dedup, warc
from wellspring.llm.tokens import encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, _id string, keep_id string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(n, seed=0, vocabulary=400):
    draw = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in draw.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def rows():
    base = prose(120, 1)
    edited = base.split(" ")
    edited[60] = "other"
    return [
        (1, base, "b", None, None), (2, base.upper(), "b", None, None), (3, " ".join(edited), "a", None, None), (4, None, None, None, None), (5, "", "a", None, None),
        (6, " \n\t ", "a", None, None), (7, "one two", "c", None, None), (8, "ONE  two", "c", None, None), (9, prose(20_000, 2, 5_000), "d", None, None),
        (10, "x" * 5_000, "d", None, None), (11, ("same line of words that is long enough to count here\n" * 40), "a", None, None), (12, prose(15, 3), "b", None, None),
        (13, prose(15, 3) + " w1", "b", None, None), (None, "no id at all", "a", None, None), (14, "İstanbul ÀÉ", "a", None, None), (15, "i̇stanbul àé", "a", None, None),
        (16, prose(80, 9) + "\nsame line of words that is long enough to count here\nend", "a", None, None),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, name="doc_id"):
    return {r[name]: r for r in df.collect()}


@pytest.mark.parametrize("size,num", [(3, 90), (5, 80)])
@pytest.mark.parametrize("terms", ["blocks", "shingles"])
def test_jaccard_equals_all_pairs(docs, rows, size, num, terms):
    sets = {}
    for i, text, *_ in rows:
        w = WORD.findall(lower(text))
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    parent[a] = parent[b] = min(parent[a], parent[b])
    got = by_id(jaccard.near_groups(docs, rule=jaccard.Rule(size, num, 100), terms=terms))
    assert {i: got[i]["n_shingles"] for i in sets} == {i: len(s) for i, s in sets.items()}
    assert {i: got[i]["component_id"] for i in ids} == parent
    assert got[None]["component_id"] is None


def test_jaccard_keeps_one_and_empty_table(docs, empty):
    assert jaccard.near_groups(empty, terms="blocks").count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert {1, 4, 5, 7, 9} <= {r["doc_id"] for r in kept.collect()} and 2 not in {r["doc_id"] for r in kept.collect()}


def test_searches_meet_every_linked_pair():
    rule, draw = jaccard.Rule(3, 90, 100), np.random.default_rng(5)
    for n in [9, 10, 12, 19, 25, 40, 90, 300]:
        for _ in range(20):
            a = np.unique(draw.integers(0, 2**63, n, dtype="u8"))
            spare = rule.spare(len(a))
            for b in (a[int(draw.integers(0, spare + 1)):], np.unique(np.concatenate([a, draw.integers(0, 2**63, rule.reach(len(a)) - len(a), dtype="u8")]))):
                keys = [set(jaccard.block_keys(np.zeros(len(x), "i8"), x, np.array([len(x)]), rule)[1].tolist()) for x in (a, b)]
                assert keys[0] & keys[1]
                if max(len(a), len(b)) <= 29:
                    assert set(jaccard.subset_keys(a, rule).tolist()) & set(jaccard.subset_keys(b, rule).tolist())


def test_parities_of_large_sets(spark):
    """Sets on both sides of a power of two: near ones pass the parities and link, others with half of their words alike do not pass."""
    rule, random = jaccard.Rule(5, 80, 100), np.random.default_rng(5)
    base = [f"w{k}" for k in random.integers(0, 5000, 1000)]
    longer = base + [f"x{k}" for k in range(60)]
    half = base[:500] + [f"y{k}" for k in range(560)]
    rows = [(1, " ".join(base)), (2, " ".join(longer)), (3, " ".join(half)), (4, " ".join(reversed(base)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard.near_groups(docs, rule=rule).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}
    sets = jaccard.set_rows(docs, "doc_id", "text", rule, None)
    assert [len(r["wide"]) * 64 for r in sets.orderBy("_id").collect()] == [1024, 2048, 2048, 1024]
    classes = jaccard.settle(sets.selectExpr("_id AS rep", "n", "wide"))
    pairs = jaccard.settle(classes.selectExpr("rep AS a").join(classes.selectExpr("rep AS b")).where("a < b"))
    kept = {(r["a"], r["b"]) for r in jaccard._close(pairs, classes, rule).collect()}
    assert kept == {(1, 2)}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_quality_counts(docs, rows, empty):
    got = by_id(quality_rules.judge_quality(docs))
    for i, text, *_ in rows:
        w, text = WORD.findall(text or ""), text or ""
        windows = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        covered = {k + d for k in range(len(w) - 7) if windows[tuple(w[k:k + 8])] > 1 for d in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][c] for c in quality_rules.COUNTS) == want, i
        assert got[i]["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (got[i]["kept"] and got[i]["base_failed"])
    assert quality_rules.judge_quality(empty).count() == 0
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_quality_rules_against_labels(spark, sf):
    judged = quality_rules.judge_quality(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    seen = {(r["base_failed"], r["kept"], r["quality"]): r["n"] for r in judged.groupBy("base_failed", "kept", "quality").agg(F.count("*").alias("n")).collect()}
    assert seen.get((False, False, 1), 0) == 0
    assert seen.get((False, True, 0), 0) <= 2


def test_label_model_finds_accuracies(spark):
    draw = np.random.default_rng(3)
    good = draw.random(4000) < 0.8
    votes = [(int(g) if draw.random() < 0.9 else 1 - int(g)) for g in np.repeat(good, 5)]
    table = spark.createDataFrame([tuple(votes[5 * k:5 * k + 5]) for k in range(4000)], ", ".join(f"v{j} int" for j in range(5)))
    patterns = table.groupBy(*table.columns).agg(F.count("*").alias("n")).coalesce(1)
    prior, right, wrong = quality_rules.label_model(patterns, table.columns)
    assert abs(prior - 0.8) < 0.03 and all(abs(x - 0.9) < 0.04 for x in [*right, *wrong])


def test_classifier_on_held_out_rows(spark, docs, empty):
    docs_, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_model.classify_quality(docs_, labels).join(labels, "doc_id").where("held_out")
    right = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.95 and 0 <= right[1] <= right[2] <= 1
    one = quality_model.classify_quality(docs_, labels).where("doc_id < 50").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in one)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_model.classify_quality(docs, none).collect()} == {0.5}
    assert quality_model.classify_quality(empty, labels).count() == 0


def test_warc_round_trip(spark, empty):
    big = "é" * 600
    pages = [(1, "http://www.a.org/x", big), (2, "http://a.org", big), (3, None, big), (4, "http://a.org", "small"), (5, "//b/\r\nc\td", "small"), (6, "junk", None), (7, "", "")]
    pages += [(100 + k, f"http://h{k % 7}.net/{k}", f"<p>{k}</p>" * 50) for k in range(700)]
    got = by_id(warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id")
    assert len(got) == len(pages)
    for i, _, html in pages:
        data = (html or "").encode()
        want = (len(data), hashlib.sha1(data).hexdigest(), "revisit" if i in (1, 2) else "response", 3 if i in (1, 2) else None)
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == want
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert warc.url_key("HTTP://u@WWW.A.org:80/X?y") == "org,a,www)/X?y"


def test_license_scan(spark, empty):
    texts = ["plain words", None, "a\nReleased under the MIT License.\nb", "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 1.1.",
             "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "a licence of some other kind altogether"]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == {(2, "MIT"), (3, "Apache-2.0"), (4, None), (5, "GPL-3.0"), (6, "CC-BY-NC-4.0"), (7, None)}
    row = next(r for r in got if r["doc_id"] == 2)
    assert texts[2][row["start"]:row["end"]] == "Released under the MIT License."
    assert licenses.scan_licenses(empty).count() == 0


def test_wrapped_licenses(spark):
    notices = [("MIT", "Released under the MIT\nLicense."), ("CC-BY-4.0", "Licensed under CC BY\n4.0."), ("All-Rights-Reserved", "All rights\nreserved."),
               *[(name, t.replace(" ", sep)) for name in ("MIT", "BSD-3-Clause", "GPL-3.0", "ISC", "CC-BY-SA-4.0") for t in licenses.TEMPLATES[name] for sep in ("\n", "\n# ")]]
    texts = [f"{prose(300, 5)}\n{notice} {prose(300, 6)}\n" for _, notice in notices] + ["All rights reserved.\n" + "x\n" * 9 + "Released under the MIT\nLicense."]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for i, (name, notice) in enumerate(notices):
        found = {(r["license"], texts[i][r["start"]:r["end"]]) for r in got if r["doc_id"] == i}
        assert found == {(name, notice)}, (name, notice)
    assert sorted((r["license"], texts[-1][r["start"]:r["end"]]) for r in got if r["doc_id"] == len(notices)) == [
        ("All-Rights-Reserved", "All rights reserved."), ("MIT", "Released under the MIT\nLicense.")]


@pytest.mark.parametrize("size", [20_000, 1_000_000])
@pytest.mark.parametrize("name,place", [("MIT", 0), ("MIT", 2), ("All-Rights-Reserved", 0), ("Apache-2.0", 1)])
def test_license_in_a_long_line(size, name, place):
    text = prose(size // 5, 4, 3_000)
    notice = licenses.TEMPLATES[name][place]
    for at in (0, len(text) // 2, len(text)):
        found = licenses.identify(f"{text[:at]} {notice} {text[at:]}")
        assert [r[0] for r in found] == [name] and found[0][1] > 0 and found[0][2] == 1


@pytest.mark.parametrize("digest", [exact_dedup.content_hash, lambda text: F.substring(F.md5(text), 1, 1)])
def test_exact_groups(docs, rows, empty, digest):
    got = by_id(exact_dedup.exact_groups(docs, digest=digest))
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(lower(text), []).append(i)
    for text, ids in groups.items():
        for i in ids:
            best = max((x for x in ids if x is not None), default=None)
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (best, len(ids), i == best), i
            assert got[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert exact_dedup.exact_groups(empty).count() == 0


def test_drop_copies_keeps_every_text(spark):
    """An id with two texts, one of them a copy of another row's; repeated rows; null ids; helper-like names."""
    rows = [(5, "A", 1), (7, "a", 1), (5, "B", 2), (5, "B", 2), (8, "C", 3), (8, "c", 3), (None, "D", 4), (None, None, 5), (9, "", 5), (None, "E", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _hash int").withColumn("_sha", F.lit("x"))
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns
    assert sorted(((r.text or "").lower(), r.doc_id or 0) for r in left.collect()) == [("", 9), ("a", 7), ("b", 5), ("c", 8), ("d", 0), ("e", 0)]


def test_drop_copies_with_repeated_rows(docs):
    left = exact_dedup.drop_copies(docs.unionAll(docs))
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert len(ids) == len(set(ids)) and 2 in ids and 1 not in ids


def test_mixing_targets_and_cuts(docs, rows, empty):
    got = mixing.mix_sources(docs).collect()
    total = sum(r["size"] for r in got)
    assert total == sum(len(WORD.findall(t or "")) for _, t, *_ in rows)
    per_source = {}
    source = {i: s for i, _, s, *_ in rows}
    for r in got:
        per_source.setdefault(source[r["doc_id"]], []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert abs(sum(x[0]["target"] for x in per_source.values()) - total) < 1e-6
    for own in per_source.values():
        assert own[0]["target"] <= 3 * own[0]["source_size"] and 0 <= own[0]["target"] - sum(r["taken"] for r in own) < 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.apply_mix(docs).columns == docs.columns


def test_repeated_lines(docs, rows, empty):
    got = by_id(unit_dedup.drop_repeats(docs))
    seen = set()
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        kept = []
        for line in (text or "").split("\n"):
            words = tuple(WORD.findall(lower(line)))
            if len(words) < unit_dedup.MIN_WORDS or words not in seen:
                kept.append(line)
            seen.add(words)
        assert got[i]["text"] == (None if text is None else "\n".join(kept)), i
        assert all(text[s["start"]:s["end"]] == text.split("\n")[s["unit"]] for s in got[i]["removed"])
    assert unit_dedup.drop_repeats(empty).count() == 0


def test_repeated_runs_of_words(spark, docs, empty):
    quote, listed, base = prose(60, 20), "\n".join(prose(5, 30 + k) for k in range(12)), prose(200, 21)
    edited = base.replace(base.split(" ")[100], "other", 1)
    texts = [f"{prose(30, 22)} {quote} {prose(20, 23)}", f"{prose(90, 24)} {quote} {prose(70, 25)}", f"head one\n{listed}\none end", f"head two\n{listed}\ntwo end", base, edited,
             f"{prose(40, 26)} {prose(49, 20)} {prose(9, 27)}", f"{prose(60, 28)} {prose(60, 29)} {prose(60, 28)} tail", None, ""]
    texts += [f"{prose(20, 40)}\n{listed}\n{prose(20, 41)} x", f"{prose(20, 40)}\n{listed}\n{prose(20, 41)} y"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = by_id(unit_dedup.drop_repeats(table, run_words=50))

    def runs(i, size, text):
        words = WORD.findall(text or "")
        return {(i, k): " ".join(words[k:k + size]) for k in range(len(words) - size + 1)}

    left = Counter(run for i in got for run in runs(i, 50, got[i]["text"]).values())
    assert max(left.values()) == 1
    assert got[1]["text"] == f"{prose(90, 24)} {prose(70, 25)}" and got[3]["text"] == "head two\ntwo end" and got[7]["text"] == f"{prose(60, 28)} {prose(60, 29)} tail"
    assert all(got[i]["text"] == texts[i] for i in (0, 2, 4, 6, 8, 9)) and "other" in got[5]["text"]
    for i, row in got.items():
        spans = [(s["start"], s["end"]) for s in row["removed"]]
        assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and row["n_removed"] == len(spans)
        rest = "".join((texts[i] or "")[a:b] + " " for a, b in zip([0, *[e for _, e in spans]], [*[b for b, _ in spans], len(texts[i] or "")]))
        assert rest.split() == (row["text"] or "").split(), i
    assert unit_dedup.drop_repeats(empty, run_words=50).count() == 0
    assert unit_dedup.drop_repeats(docs, run_words=50).count() == docs.count()


def test_packing(docs, rows, empty):
    got = packing.pack_documents(docs.where("doc_id IS NOT NULL")).collect()
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    encode = encoder().full
    for i, text, *_ in rows:
        if i is None:
            continue
        ids = np.array(encode.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(ids) // 1024)))
        assert all(r["length"] == 1024 for r in pieces[1:]) and sum(r["length"] for r in pieces) == len(ids)
        assert all(zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in pieces)
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack_documents(empty).count() == 0


def test_packing_merges_partitions(spark):
    pieces = spark.createDataFrame([(k, 0, 0, 100 + k % 7, 0) for k in range(400)], "_id long, piece int, start long, length long, ids_crc32 long").repartition(40)
    packed = packing.pack_pieces(pieces)
    assert packed.count() == 400 and packed.select("sequence_id").distinct().count() <= 46


@pytest.mark.parametrize("text", ["", " ", "a  b", "a \n b\n\n c ", "x<|endoftext|>y", "tab\tand\x1cmore \x85 z", "don't  stop", "日本語 テキスト", "é a  b", "9 8  7"])
def test_ids_equal_the_full_pipeline(text):
    own = encoder()
    assert np.frombuffer(own.encode(text), "<u4").tolist() == own.full.encode(text, add_special_tokens=False).ids


def test_blocks_of_long_texts_give_the_same_ids_and_words(monkeypatch):
    from wellspring.llm import tokens, words

    text = "Über  den\n \nWolken, \x1c don't stop at 1984 and " * 40 + "x" * 300 + " end"
    whole = encoder().encode(text)
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 50)
    assert len(list(tokens._blocks(text))) > 20 and encoder().encode(text) == whole
    data = np.frombuffer(text.encode(), "u1")
    for offsets in ([0, len(data)], [0, 7, 7, 100, len(data)]):
        for limit in (1, 16, 100):
            for got, want in zip(words.word_hashes(data, np.array(offsets), limit), words.word_hashes(data, np.array(offsets), len(data))):
                assert got.tolist() == want.tolist()


def test_training_order(docs, empty, rows):
    from wellspring.session import settle

    fixed = settle(docs)
    got = training_order.training_order(fixed).collect()
    total = sum(len(encoder().encode(t or "")) // 4 + 1 for _, t, *_ in rows)
    n = -(-total // 1024)
    assert sorted(r["slot"] for r in got) == sorted(r["sequence_id"] for r in got) == list(range(n))
    assert sum(r["length"] for r in got) == total and all(r["byte_offset"] == 2048 * r["slot"] for r in got)
    assert [r["slot"] for r in sorted(got, key=lambda r: r["sequence_id"])] == training_order.feistel(np.arange(n), n).tolist()
    assert training_order.training_order(empty).count() == 0


def test_training_order_refuses_wide_ids(docs, monkeypatch):
    from wellspring.session import settle

    monkeypatch.setattr(training_order, "MOST_ID", 1000)
    with pytest.raises(Exception, match="which the shards cannot hold"):
        training_order.training_order(settle(docs)).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 4097])
def test_feistel_is_a_permutation(n):
    slots = training_order.feistel(np.arange(n), n, key=9)
    assert sorted(slots) == list(range(n)) and (training_order.feistel(slots, n, key=9, inverse=True) == np.arange(n)).all()


def test_pipeline_stages_keep_columns(spark, sf):
    import corpus_pipeline

    packed = corpus_pipeline.run(spark, sf)
    ids = {r["doc_id"] for r in packed.select("doc_id").distinct().collect()}
    judged = by_id(quality_rules.judge_quality(spark.read.parquet(f"{sf}/documents.parquet")))
    assert ids and all(judged[i]["kept"] for i in ids)


@pytest.mark.parametrize("run_words", [0, 50])
def test_repeats_in_rows_without_id(spark, run_words):
    """They are no document together: none is cut, and none makes another lose a line."""
    line, own = " ".join(f"w{i}" for i in range(60)), "a line of its own with a few more words"
    rows = [(None, line + "\n" + own), (None, "zz\n" + line), (1, own), (2, line), (3, line)]
    got = unit_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), run_words=run_words)
    left = sorted((r["doc_id"] or 0, r["text"]) for r in got.collect())
    assert left == sorted([(0, line + "\n" + own), (0, "zz\n" + line), (1, own), (2, line), (3, "")])


def test_mix_keeps_columns_of_any_name(spark):
    rows = [(i, "one two three", "ab"[i % 2], i, i * 10, None if i % 2 else 3) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copy long, _copies long, _salt long")
    got = mixing.apply_mix(docs)
    assert got.columns == docs.columns and got.count() > 0
    assert all(r["_copy"] == r["doc_id"] and r["_copies"] == r["doc_id"] * 10 for r in got.collect())
