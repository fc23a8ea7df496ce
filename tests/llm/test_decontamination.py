"""Block-max WAND against exhaustive scoring, and leaks against brute force."""

import random
import re

import numpy as np
import pytest

from tidewater.llm import decontamination as d


def sentence(r, words, n):
    return " ".join(r.choice(words) for _ in range(n)).capitalize() + "."


def corpus(seed=4):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeo") for _ in range(r.randint(1, 5))) for _ in range(300)]
    items = [(i, " ".join(sentence(r, words, r.randint(1, 14)) for _ in range(r.randint(1, 4)))) for i in range(150)]
    docs = []
    for i in range(200):
        t = [sentence(r, words, r.randint(1, 20)) for _ in range(r.randint(0, 40))]
        if i % 4 == 0:
            t.insert(r.randint(0, len(t)), r.choice(items)[1].upper() if i % 8 else r.choice(items)[1])
        if i % 10 == 1:  # the question alone
            t.insert(0, d.parts_of(r.choice(items)[1])[0])
        docs.append((i, "\n".join(t)))
    return items, docs


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.7])
def test_block_max_wand_against_all_scores(threshold):
    items, docs = corpus()
    index = d.build_index(items)
    for _, text in docs[:60]:
        hashes = set(d._hashes(text).tolist())
        query = [t for t, h in enumerate(index.terms.tolist()) if h in hashes]
        scores = np.zeros(len(index.items))
        for t in query:
            scores[index.postings[t][0]] += index.postings[t][1]
        want = [(k, s) for k, s in enumerate(scores) if s >= threshold - 1e-9]
        got = d.block_max_wand(index, query, threshold)
        assert [k for k, _ in got] == [k for k, _ in want]
        assert np.allclose([s for _, s in got], [s for _, s in want])


def words(t):
    return re.findall(r"\w+", t.lower())


def share(part, text):
    n = min(5, len(words(part)))
    grams = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    own = grams(words(part))
    return len(own & grams(words(text))) / len(own)


def brute(items, docs):
    """Items of which some passage holds enough and the text nearly all shingles of question and answer."""
    index = d.build_index(items)
    half, out = index.passage // 2, set()
    for i, text in docs:
        w = d._hashes(text).tolist()
        for s in range(0, max(1, len(w)), half):
            here = set(w[s : s + 2 * half])
            score = np.zeros(len(index.items))
            for t, h in enumerate(index.terms.tolist()):
                if h in here:
                    score[index.postings[t][0]] += index.postings[t][1]
            for k in np.flatnonzero(score >= d.RETRIEVE - 1e-9):
                if all(share(p, text) >= d.OVERLAP for p in d.parts_of(dict(items)[index.items[k]])):
                    out.add((i, index.items[k]))
    return out


@pytest.mark.parametrize("shards", [1, 4])
def test_leaks_against_brute_force(spark, monkeypatch, shards):
    items, docs = corpus()
    if shards > 1:
        monkeypatch.setattr(d, "INDEX_ITEMS", 60)
    frame = spark.createDataFrame([(*x, "item") for x in docs], "doc_id long, text string, item_id string").repartition(5)
    tests = spark.createDataFrame([*items, (900, None), (901, ""), (902, "...")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.leaks(frame, tests).collect()}
    assert got == brute(items, docs)
    exact = {(i, k) for i, t in docs for k, x in items if " ".join(words(x)) in " ".join(words(t)) and len(words(x)) > 8}
    assert exact <= got and len(exact) > 30
    clean = d.without_leaks(frame, tests)
    assert clean.columns == frame.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_edges(spark):
    item = "What is the colour of a clear sky at noon in June? It is blue."
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "So: " + item + " Yes."), (3, "So: " + item + " Yes."), (None, item), (4, "w " * 90000 + item)], "doc_id long, text string")
    tests = spark.createDataFrame([(7, item), (8, item)], "item_id long, text string")
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in d.leaks(docs, tests).collect()) == [(-1, 7), (-1, 8), (3, 7), (3, 7), (3, 8), (3, 8), (4, 7), (4, 8)]
    assert d.leaks(docs, tests.where("false")).count() == 0
    assert d.without_leaks(docs, tests.where("false")).count() == 6
    assert d.leaks(docs.where("false"), tests).count() == 0


def test_parts_of_a_benchmark_give_what_the_whole_gives(spark, monkeypatch):
    items, docs = corpus()
    docs += [(1000 + i, "zzz " + t.split(" ", 1)[1]) for i, t in items if " " in t]  # parts of items, scored by statistics
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame([*items, (900, None), (901, ""), (902, "...")], "item_id long, text string")
    found = lambda: {(r["doc_id"], r["item_id"]): r["score"] for r in d.leaks(frame, tests).collect()}
    whole = found()
    monkeypatch.setattr(d, "INDEX_ITEMS", 60)
    parts = found()
    assert set(parts) == set(whole) == brute(items, docs) and min(whole.values()) < 0.9
    assert all(abs(parts[k] - whole[k]) < 1e-9 for k in whole)
