"""Poisson mixing against its distribution, and histogram sharding against exact counts."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewater.llm import mixing, sharding


def test_poisson_table(spark):
    for rate in (0.0, 0.3, 1.0, 17.5, 900.0):
        (got,) = spark.range(1).select(mixing.poisson_table(F.lit(rate)).alias("c")).first()
        total, term = 0.0, None
        for k, c in enumerate(got):
            total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) if rate else 1.0
            assert abs(c - total) < 1e-9
        assert abs(got[-1] - 1) < 1e-9


def docs(spark, n=6000):
    r = random.Random(1)
    rows = [(i, f"text {i}", r.choice(["hot"] * 6 + ["a", "b", "c", None]), "mine") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy string").repartition(7)


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 16**13


@pytest.mark.parametrize("broadcast", [2000, 0])
def test_mix_against_direct_inversion(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    weights = {"hot": 1.0, "a": 2.0, "b": 1.0}
    df = docs(spark)
    got = mixing.mix(df, weights)
    assert got.columns == ["doc_id", "text", "source", "copy", "shuffle_key"]
    rows = got.collect()
    sizes = {x["source"]: x["count"] for x in df.groupBy("source").count().collect()}
    want = set()
    for x in df.collect():
        rate = weights.get(x["source"], 0.0) / 4 * 6000 / sizes[x["source"]]
        u, k, total = draw("mix", x["doc_id"]), 0, math.exp(-rate)
        term = total
        while total <= u and rate:
            k += 1
            term *= rate / k
            total += term
        want |= {(x["doc_id"], c, draw("mix order", x["doc_id"], c)) for c in range(k)}
    assert {(r["doc_id"], r["copy"], r["shuffle_key"]) for r in rows} == want and len(rows) == len(want)
    counts = {s: sum(r["source"] == s for r in rows) for s in sizes}
    assert abs(counts["a"] - 3000) < 250 and abs(counts["hot"] - 1500) < 200 and counts["c"] == 0


def test_rates_of_any_height(spark):
    """A source of one row, at the same weight as a large one."""
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") == 77, "rare").otherwise("hot").alias("source"))
    got = mixing.mix(df, {"rare": 1.0, "hot": 1.0})
    counts = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    rate = n / 2
    parts = math.ceil(rate / mixing.MOST_RATE)

    def inverted(u, rate):
        k, total = 0, math.exp(-rate)
        term = total
        while total <= u:
            k += 1
            term *= rate / k
            total += term
        return k

    want = sum(inverted(draw("mix", 77, j), rate / parts) for j in range(parts))
    assert counts["rare"] == want and abs(want - rate) < 6 * math.sqrt(rate) and abs(counts["hot"] - rate) < 2500
    copies = got.where("source = 'rare'").agg(F.min("copy"), F.max("copy"), F.count_distinct("copy")).first()
    assert tuple(copies) == (0, want - 1, want)


def test_mix_edges(spark):
    df = spark.createDataFrame([(None, None, None), (None, "x", None), (1, "", "s"), (1, "", "s")], "doc_id long, text string, source string")
    assert len({r["copy"] for r in mixing.mix(df).where("doc_id = 1").collect()}) * 2 == mixing.mix(df).where("doc_id = 1").count()
    assert mixing.mix(df.where("false")).count() == 0
    assert mixing.mix(df, {}).count() == 0


@pytest.mark.parametrize("chunk", [64 << 20, 3000])
def test_shard_laws(spark, chunk):
    r = random.Random(2)
    texts = ["é" * r.randint(0, 300) + str(r.randint(0, 900)) for _ in range(3000)] + ["one hot text " * 9] * 1500 + [None, "", "y" * 9000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, shard string").repartition(5)
    done = sharding.shard(df, 8, chunk_bytes=chunk)
    assert done.columns == ["doc_id", "text", "size", "law", "shard", "slot"]
    rows = done.collect()
    assert len(rows) == len(texts) and {r["doc_id"] for r in rows} == set(range(len(texts)))
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 and r["law"] == "bytes" for r in rows)
    total = sum(r["size"] for r in rows)
    for s in range(8):
        mine = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 8) <= 9001 + 0.002 * total / 8
    groups = {}
    for r in rows:
        groups.setdefault(r["text"], []).append((r["shard"], r["slot"]))
    assert sum(len({s for s, _ in g}) > 1 for g in groups.values()) <= 7
    # equal texts stand together
    whole = [sorted(g) for g in groups.values() if len({s for s, _ in g}) == 1]
    assert sum(g[-1][1] - g[0][1] + 1 == len(g) for g in whole) >= 0.99 * len(whole)


def test_splitters_are_exact(spark):
    r = random.Random(3)
    rows = [(r.choice([r.getrandbits(56), 5 << 16, (5 << 16) | r.getrandbits(16)]), r.randint(1, 50)) for _ in range(4000)]
    keys = spark.createDataFrame(rows, "key long, size long")
    split = sharding.find_splitters(keys, 5, 0.0001)
    assert split.total == sum(s for _, s in rows) and split.keys == sorted(split.keys)
    for key, below in zip(split.keys, split.below):
        assert below == sum(s for k, s in rows if k < key)
    assert all(abs(b - split.total * i / 5) < 0.34 * split.total for i, b in enumerate(split.below, 1))


def test_shard_edges(spark):
    schema = "doc_id long, text string"
    assert sharding.shard(spark.createDataFrame([], schema)).count() == 0
    got = sharding.shard(spark.createDataFrame([(None, None), (None, None), (1, "a")], schema), 2).collect()
    assert sorted(x["size"] for x in got) == [1, 1, 2] and len({(x["shard"], x["slot"]) for x in got}) == 3
