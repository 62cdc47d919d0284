"""How many rows the text operators move, besides what they find."""

import numpy as np

from wellspring.llm import unit_dedup


def test_only_texts_with_repeats_are_joined(spark, monkeypatch):
    """Of 100 texts without a common run, five hold one copied line and two one copied run across lines."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 10**9, 80)) for _ in range(100)]
    for k in range(5):
        texts[10 * k] += "\nthe same line of nine words is here again"
    run = " ".join(f"r{k}" for k in range(60)).split()
    texts[33], texts[66] = texts[33] + " " + " ".join(run), "\n".join([" ".join(run[:31]), " ".join(run[31:]), texts[66]])
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    moved, inner = [], unit_dedup.attach_by_key

    def counted(rows, facts, *args, **more):
        if "_text" in rows.columns:
            moved.append(rows.count())
        return inner(rows, facts, *args, **more)

    monkeypatch.setattr(unit_dedup, "attach_by_key", counted)
    got = {r["doc_id"]: r for r in unit_dedup.drop_repeats(docs, run_words=50).collect()}
    assert len(got) == 101
    assert {k for k, r in got.items() if r["n_removed"]} == {10, 20, 30, 40, 66}
    assert got[66]["text"] == texts[66].split("\n", 2)[2] and got[20]["text"] == texts[20].split("\n")[0]
    assert all(got[k]["text"] == texts[k] for k in range(100) if k not in (10, 20, 30, 40, 66)) and got[None]["text"] == texts[0]
    assert moved and max(moved) <= 10


def test_facts_reach_their_texts(spark):
    """As a plain left join gives them, ids of text and null included."""
    rows = spark.createDataFrame([(f"id{k}" if k else None, f"text {k % 7}") for k in range(300)] + [("id5", "text 5")], "_id string, _text string")
    facts = spark.createDataFrame([(f"id{k}", k) for k in (5, 77, 299, 1000)], "_id string, _fact long")
    want = sorted(rows.join(facts, "_id", "left").select("_id", "_text", "_fact").collect(), key=str)
    assert sorted(unit_dedup.attach_to_texts(rows, facts).select("_id", "_text", "_fact").collect(), key=str) == want
    inner = unit_dedup.attach_to_texts(rows, facts, "inner").select("_id", "_text", "_fact").collect()
    assert sorted(inner, key=str) == [r for r in want if r["_fact"] is not None]
