"""The Jaccard join against all pairs, and its parts."""

import random
import re

import numpy as np
import pytest

from tidewater.llm import minhash
from tidewater.llm.components import components
from tidewater.llm.shingles import shingle_sets


def words(text):
    return re.findall(r"[^\W]+", (text or "").lower())


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def corpus(seed=5, groups=12, most=14):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghé") for _ in range(r.randint(2, 7))) for _ in range(400)]
    texts = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 160))]
        for _ in range(r.randint(1, most)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 35))):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            texts.append(" ".join(t))
    texts += texts[:6] + [texts[0].upper() + "!", "", None, " .", "one two", "One, two", "one two three", "x " * 30000]
    r.shuffle(texts)
    return texts


def brute(texts):
    sets = [shingles(t) for t in texts]
    n = len(texts)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
                if a and texts[i] != texts[j]:
                    links[i].add(texts[j])
                    links[j].add(texts[i])
    return {i: (find(i), len(links[i])) for i in range(n)}


@pytest.mark.parametrize("block", [256, 3])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_SETS", block)
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, root string, copy int").repartition(4)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in minhash.similar_documents(df).collect()}
    assert got == brute(texts)
    kept = minhash.first_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _ in got.values()})


def chain(n, seed=2):
    """Texts of which each is near the next ones only, in one large component of few candidate pairs."""
    r = random.Random(seed)
    words_ = ["w%d" % r.randrange(10**6) for _ in range(60 + 3 * n)]
    return [" ".join(words_[3 * i : 3 * i + 60]) for i in range(n)]


@pytest.mark.parametrize("block", [4, 1000])
def test_chains_and_groups_by_bucket(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_SETS", block)
    texts = chain(320) + corpus(11, 3, 12)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    chosen = []
    kept = minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda frame, name: (made := kept(frame, name), name == "by-bucket" and chosen.append(made.count()))[0])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in minhash.similar_documents(df).collect()}
    assert got == brute(texts)
    assert sum(chosen) >= 1 if block < 1000 else not chosen


def test_shuffled_fetch_gives_the_same(spark, monkeypatch):
    texts = corpus(8, 5, 6)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = sorted(minhash.similar_documents(df).collect())
    monkeypatch.setattr(minhash, "BROADCAST_SETS", 0)
    assert sorted(minhash.similar_documents(df).collect()) == one


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = "a b c d e f g h i j"
    df = spark.createDataFrame([(4, text), (4, text), (None, text), (9, "other words that stand for them selves alone"), (9, text)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["class_id"]) for r in minhash.similar_documents(df).collect()) == [(-1, 4), (4, 4), (4, 4), (9, 4), (9, 9)]
    assert sorted(minhash.first_of_each(df).collect()) == [(4, text), (9, "other words that stand for them selves alone")]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.first_of_each(none).count() == 0 and minhash.similar_documents(none).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(1, 500)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_shingles_and_recall():
    texts = [t or "" for t in corpus()]
    assert [len(s) for s in shingle_sets(texts)] == [len(shingles(t)) for t in texts]
    b = minhash.bands_for()
    assert 1 - (1 - 0.8**minhash.ROWS) ** b >= 0.99999
    r, hits = np.random.default_rng(3), 0
    for _ in range(200):
        x = r.integers(0, 1 << 63, 450, dtype=np.uint64)
        one, two = np.unique(x[:405]), np.unique(x[45:])  # 360 of 450
        hits += bool((minhash.signature(one, b, 5) == minhash.signature(two, b, 5)).any())
    assert hits >= 199
