"""Kneser-Ney evidence against a plain recursion, the two routes, and held-out accuracy."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewater.llm import toxicity


def corpus(n=900, seed=2):
    r = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é", "ü"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(8, 120))]
        toxic = int(r.random() < 0.25)
        if toxic:
            for _ in range(r.randint(2, 5)):
                w.insert(r.randrange(len(w)), "bozo" + r.choice(syllables) + r.choice(syllables))
        docs.append((i, " ".join(w), "en", 5.0))
        labels.append((i, 1, toxic))
    return docs, labels


SCHEMA, LABELS = "doc_id long, text string, lang string, score double", "doc_id long, quality int, toxic int"


def held(i):
    return zlib.crc32(str(i).encode()) % 4


def plain_table(texts):
    """The ratios by direct recursion over dictionaries."""
    count = [Counter(), Counter()]
    for t, label in texts:
        b = b"\0" * 5 + " ".join(t.lower().split()).encode()
        count[label].update(b[i : i + 6] for i in range(len(b) - 5))
    levels = {6: count}
    for k in range(5, 0, -1):
        levels[k] = [Counter(g[1:] for g in levels[k + 1][c]) for c in (0, 1)]
        if k <= 2:
            both = Counter(g[1:] for g in set(levels[k + 1][0]) | set(levels[k + 1][1]))
            levels[k] = [both, both]
    context = {(k, c): defaultdict(list) for k in levels for c in (0, 1)}
    for (k, c), x in context.items():
        for g, n in levels[k][c].items():
            x[g[:-1]].append(n)

    def p(c, g):
        if not g:
            return 1 / 256
        ns = context[len(g), c][g[:-1]]
        return (max(levels[len(g)][c][g] - 0.75, 0) + 0.75 * len(ns) * p(c, g[1:])) / sum(ns) if ns else p(c, g[1:])

    return {(k << 48) | int.from_bytes(g, "big"): math.log(p(1, g) / p(0, g)) for k in range(3, 7) for g in {*levels[k][0], *levels[k][1]}}, p


def test_ratios_against_plain_recursion(spark):
    docs, labels = corpus(60)
    texts = [(t, x[2]) for (_, t, *_), x in zip(docs, labels)]
    grams, contexts = toxicity.gram_tables(spark.createDataFrame(texts, "text string, label int").repartition(3))
    got = {r["key"]: r["value"] for r in grams.collect()}
    want, p = plain_table(texts)
    assert got.keys() == want.keys()
    assert max(abs(got[g] - want[g]) for g in want) < 1e-5
    # a text with unseen grams
    new = "never seen: zzz bozoed théin"
    b = b"\0" * 5 + new.encode()
    direct = sum(math.log(p(1, b[i : i + 6]) / p(0, b[i : i + 6])) for i in range(len(b) - 5))
    ((mean, *_),) = toxicity.evidence([new], toxicity._lookup(grams), toxicity._lookup(contexts))
    assert abs(mean * (len(b) - 5) - direct) < 1e-3


def test_lookup():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 48, 5000))
    values = r.random(len(keys)).astype(np.float32)
    table = toxicity.Lookup(keys, values)
    got, hit = table.get(np.concatenate([keys, keys + 1]).astype(np.uint64))
    assert hit[: len(keys)].all() and (got[: len(keys)] == values).all()
    assert (hit[len(keys) :] == np.isin(keys + 1, keys)).all()


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = corpus()
    docs += [(8, docs[9][1], "x", 1.0), (8, docs[11][1], "x", 1.0), (8, None, "x", 1.0)]  # rows that share an id, not a text
    docs += [(5000, None, "x", 1.0), (5001, "", "x", 1.0), (None, "bozothth bozonded and", "x", 1.0), docs[3], (5002, "he " * 40000, "x", 1.0)]
    labels += [(5003, 1, 1), (None, 1, 1), (4, 1, None), (7, 0, labels[7][2])]
    frames = spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(labels, LABELS)
    return docs, labels, frames, toxicity.score(*frames).collect()


def test_held_out_accuracy(scored):
    docs, labels, _, rows = scored
    toxic = {i: x for i, _, x in labels if x is not None}
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"]) == 2) for r in rows)
    out = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    right = sum(r["predicted"] == toxic[r["doc_id"]] for r in out)
    assert right >= 0.95 * len(out) and len(out) > 100
    by = {r["doc_id"]: r for r in rows}
    assert by[5000]["score"] == by[5001]["score"] and by[5000]["predicted"] == 0
    assert len({r["score"] for r in rows if r["doc_id"] == 3}) == 1


def test_a_model_in_parts_gives_the_same(scored):
    *_, frames, rows = scored
    parted = toxicity.score(*frames, broadcast_grams=12_000).collect()
    key = lambda r: (r["doc_id"] or -1, round(r["evidence_mean"], 6), round(r["score"], 6))
    for a, b in zip(sorted(rows, key=key), sorted(parted, key=key), strict=True):
        assert a["doc_id"] == b["doc_id"] and abs(a["score"] - b["score"]) < 1e-6


def test_parts_of_a_model_hold_what_they_say(spark):
    docs, labels = corpus(80)
    grams, contexts = toxicity.gram_tables(spark.createDataFrame([(t, x[2]) for (_, t, *_), x in zip(docs, labels)], "text string, label int"))
    made, kept, ranges = toxicity._parted(grams.cache(), contexts.cache(), 800)
    sizes = {r["part"]: r["count"] for r in made.groupBy("part").count().collect()}
    assert len(ranges) > 4 and set(sizes) == set(range(len(ranges))) and sum(sizes.values()) == grams.count()
    before = {k: {(x["key"] >> 8) & 0xFFFF for x in made.where(f"part = {k}").collect()} for k in sizes}
    assert all(n <= 800 or len(before[k]) == 1 for k, n in sizes.items())
    assert all(low <= x < high for k, (low, high) in enumerate(ranges) for x in before[k]) and kept.count() == contexts.count()


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], LABELS)
    assert [r["predicted"] for r in toxicity.score(docs, none).collect()] == [0, 0]
    assert toxicity.score(docs.where("false"), none).count() == 0
