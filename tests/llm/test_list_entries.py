"""How many entries of lists the n-gram join compares, besides what it finds."""

import numpy as np

from wellspring.llm import jaccard


def test_long_near_copies_meet_once(spark, monkeypatch):
    """Texts that share three quarters of their shingles and do not link: lists with the same members stand for one."""
    rng = np.random.default_rng(4)
    shared = [f"s{k}" for k in range(600)]
    texts = [" ".join(shared + [f"w{k}" for k in rng.integers(0, 10**9, 100)]) for _ in range(8)]
    texts += [texts[0] + " tail", " ".join(texts[1].split()[5:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    entries, inner = [], jaccard.settle

    def counted(df):
        done = inner(df)
        if set(done.columns) == {"key", "rep", "comp"}:
            entries.append(done.count())
        return done

    monkeypatch.setattr(jaccard, "settle", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_groups(docs).collect()}
    sets = [{tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    links = {(a, b) for a in range(10) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert links == {(8, 0), (9, 1)}
    assert got == {k: {8: 0, 9: 1}.get(k, k) for k in range(10)}
    assert entries and max(entries) <= 100
