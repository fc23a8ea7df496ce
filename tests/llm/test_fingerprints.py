"""Prefix hashes, common extensions, likeness, and edited pairs against plain strings."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import fingerprints as f


def texts(seed=1, n=60):
    r = random.Random(seed)
    out = ["".join(r.choice("abé🌟 ") for _ in range(r.choice([0, 1, 2, 3, 5, 31, 32, 33, 64, 65, 100, 700]))) for _ in range(n)]
    return out + [out[5], None, "", "x" * 200000]


def test_span_equality_and_common_extension():
    r = random.Random(2)
    for _ in range(60):
        a = "".join(r.choice("ab") for _ in range(r.randint(0, 60)))
        b = a[: r.randint(0, len(a))] + "".join(r.choice("ab") for _ in range(r.randint(0, 30)))
        x, y = f.Prefixes(a), f.Prefixes(b)
        for _ in range(20):
            i, j = r.randint(0, len(a)), r.randint(0, len(b))
            k = r.randint(0, min(len(a) - i, len(b) - j))
            assert x.equal(i, i + k, y, j) == (a[i : i + k] == b[j : j + k])
            want = next((n for n in range(min(len(a) - i, len(b) - j)) if a[i + n] != b[j + n]), min(len(a) - i, len(b) - j))
            assert x.common_extension(i, y, j) == want


def test_joined_is_the_concatenation():
    for a in texts():
        for b in texts(3, 6):
            a, b = (a or "")[:900], (b or "")[:900]
            x, y = f.Prefixes(a), f.Prefixes(b)
            p, q = len(a) * 2 // 3, len(b) // 2
            assert f.fingerprint(f.Joined(x, p, y, q)) == f.fingerprint(f.Prefixes(a[:p] + b[:q]))


def test_likeness():
    r = random.Random(4)
    for n in (1, 40, 999, 5000):
        a = "".join(r.choice("abcdef") for _ in range(n))
        same = f.fingerprint(f.Prefixes(a))
        assert f.likeness(same, same) == 1
        for cut in (n // 3, n // 10):
            b = a[: n - cut] + "#" * cut
            got = f.likeness(same, f.fingerprint(f.Prefixes(b)))
            assert (n - cut) / n - 2 / f.SAMPLES - 1e-9 <= got <= 1 - cut / n or cut == 0
        middle = a[: n // 2] + "#" * (n // 10) + a[n // 2 :]
        assert f.likeness(same, f.fingerprint(f.Prefixes(middle))) >= (n - 4 * f._stride(len(middle))) / len(middle)
    assert f.likeness(f.fingerprint(f.Prefixes("")), f.fingerprint(f.Prefixes("abc"))) == 0


def expected(rows):
    ordered = sorted(rows, key=lambda x: -x[0])
    out = {}
    for k, (i, t) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(t)
        edited = t[: n - n // 3] + following[: n // 3]
        a, b, c = (f.fingerprint(f.Prefixes(x)) for x in (t, edited, following))
        out[i] = (n, hashlib.sha256(edited.encode()).hexdigest(), a, b, f.likeness(a, b), f.likeness(a, c))
    return out


def test_edited_pairs(spark):
    r = random.Random(9)
    rows = [(i * 7 - 50, t) for i, t in enumerate(texts())]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id long, text string, bin int, halo string").repartition(6)
    got = {x["doc_id"]: tuple(x)[1:] for x in f.edited_pairs(df).collect()}
    assert got == expected(rows)
    prints = {x["doc_id"]: x["fingerprint"] for x in f.fingerprints(df).collect()}
    assert prints == {i: v[2] for i, v in got.items()}


def test_few_rows_ties_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert f.edited_pairs(spark.createDataFrame([], schema)).count() == 0
    (one,) = f.edited_pairs(spark.createDataFrame([(3, "abcdef")], schema)).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1
    many = f.edited_pairs(spark.createDataFrame([(3, "abc"), (3, "abc"), (3, "xyz"), (None, "q"), (None, None), (1, "abc")], schema)).collect()
    assert len(many) == 6 and sum(x["doc_id"] is None for x in many) == 2
    assert len({x["fingerprint"] for x in many if x["n_chars"] == 3}) == 2
    assert np.all([0 <= x["near_next"] <= 1 for x in many])


def test_an_id_that_most_rows_share(spark):
    r = random.Random(3)
    rows = [(None if k % 4 else k, "".join(r.choice("abcdé") for _ in range(r.randint(0, 30)))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed = [(-(1 << 63) if i is None else i, h, i, t) for i, t, h in df.select("doc_id", "text", f.row_hash(F.col("doc_id"), F.col("text"))).collect()]
    ordered = sorted(keyed, key=lambda x: x[:2], reverse=True)
    want = []
    for k, (*_, i, t) in enumerate(ordered):
        following, n = ordered[(k + 1) % len(ordered)][3], len(t)
        want.append((i or -1, hashlib.sha256((t[: n - n // 3] + following[: n // 3]).encode()).hexdigest()))
    got = [(x["doc_id"] or -1, x["edited_sha256"]) for x in f.edited_pairs(df).collect()]
    assert sorted(got) == sorted(want)
    cuts = f.Counter({-(1 << 63): 20, 8: 1, 200: 1})
    bins = spark.createDataFrame([x[:2] for x in keyed], "id long, row long").withColumn("bin", f._bin(F.col("id"), F.col("row"), cuts))
    sizes = {x["bin"]: x["count"] for x in bins.groupBy("bin").count().collect()}
    assert len(sizes) >= 20 and max(sizes.values()) < 100
    of = sorted((x["id"], x["row"], x["bin"]) for x in bins.collect())
    assert [x[2] for x in of] == sorted(x[2] for x in of)
