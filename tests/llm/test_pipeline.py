"""The pipeline stage by stage against plain versions, and the queries' contracts on the smallest tables."""

import hashlib
import os
import random
import subprocess
import sys
import zlib
from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm.test_minhash import brute as brute_classes
from tests.llm.test_minhash import corpus as near_copies
from tests.llm.test_mixing_sharding import draw
from tidewater.llm import decontamination, registry, toxicity

DATA = "/root/testdata/sf0.001"
REPO = Path(corpus_pipeline.__file__).parent
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    where = tmp_path_factory.mktemp("tables")
    items = [(i, " ".join(f"q{i}w{j}" for j in range(14)) + f" end{i}. The answer is a{i} b{i} c{i} d{i} e{i}.") for i in range(8)]
    texts = near_copies(7, 14, 6)
    for k in range(6):
        texts.append("before it. " + r.choice(items)[1] + f" after {k} " + " ".join(r.choice("abcdef") * 3 for _ in range(30)))
    plain = "the of and to in is it for on with as by at from that".split()
    labels = []
    for k in range(400):
        w = [r.choice(plain) + r.choice(["", "er", "ed", "ing"]) for _ in range(r.randint(15, 60))]
        toxic = k % 4 == 0
        for _ in range(3 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(["bozoface", "bozohead"]))
        labels.append((1000 + k, 1, int(toxic)))
        texts.append((1000 + k, " ".join(w)))
    docs = [(*t, "en", r.choice(["hot", "hot", "hot", "b"]), 0) if isinstance(t, tuple) else (i, t, "en", r.choice(["hot", "hot", "a"]), 0) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), docs, labels, items


def test_each_stage_against_a_plain_version(spark, folder):
    where, docs, labels, items = folder
    left = {d[0]: d for d in docs}
    frame = spark.read.parquet(f"{where}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, where)
        frame = spark.createDataFrame(frame.collect(), frame.schema)
        rows = frame.collect()
        if k < 4:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        ids = sorted(r["doc_id"] for r in rows)
        if name == "toxicity":
            toxic = {i for i, _, t in labels if t}
            assert len(toxic - set(ids)) >= 0.95 * len(toxic) and len(set(left) - toxic - set(ids)) <= 4
            left = {i: left[i] for i in ids}
        elif name == "near_duplicates":
            keys = sorted(left)
            classes = brute_classes([left[i][1] for i in keys])
            assert ids == sorted({keys[c] for c, _ in classes.values()})
            left = {i: left[i] for i in ids}
        elif name == "decontamination":
            leaks = {i for i, d in left.items() if d[1] and any(t in d[1] for _, t in items)}
            assert len(leaks) >= 4 and ids == sorted(set(left) - leaks)
            left = {i: left[i] for i in ids}
        elif name == "mixing":
            import math

            sizes = {}
            for d in left.values():
                sizes[d[3]] = sizes.get(d[3], 0) + 1
            want = []
            for i, d in left.items():
                rate = math.sqrt(sizes[d[3]]) / sum(map(math.sqrt, sizes.values())) * len(left) / sizes[d[3]]
                u, n, total = draw("mix", i), 0, math.exp(-rate)
                term = total
                while total <= u:
                    n += 1
                    term *= rate / n
                    total += term
                want += [i] * n
            assert ids == sorted(want)
            mixed = ids
        else:
            assert ids == mixed
            sizes = {s: sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)}
            assert sum(sizes.values()) == sum(len((r["text"] or "").encode()) + 1 for r in rows)
            for s in sizes:
                assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_run_is_the_stages(spark, folder):
    where, *_ = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, where)
    key = lambda df: sorted((r["doc_id"] or -1, r["shard"], r["slot"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, where)) == key(docs)


def test_odd_rows_go_through(spark, folder, tmp_path):
    where, _, _, items = folder
    rows = [(None, None, None, None, None), (1, None, "x", None, 3), (1, None, "x", None, 3), (2, "", None, "s", 0), (5, "w " * 40000, "x", "s", 1), (6, "alone but long enough to stand", "x", "s", 1)]
    df = spark.createDataFrame([(*r, "extra", 0.1, 7) for r in rows], SCHEMA + ", score string, size double, copy int")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for given in (df, df.where("false")):
            out = stage(spark, given, where)
            assert out.count() >= 0
            if k < 4:
                assert out.columns == df.columns, name
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.without_leaks(df, none).count() == len(rows)
    assert toxicity.kept(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == len(rows)


needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
COLUMNS = {
    3: ["doc_id", "held_out", "score", "predicted"], 4: ["doc_id", "start", "n_tokens", "ids_crc32"], 6: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    9: ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
}


@needs_data
@pytest.mark.parametrize("number", range(1, 11))
def test_contracts(spark, number):
    (name,) = (n for n in registry.queries() if n.startswith(f"op{number}_"))
    out = registry.queries()[name](spark, DATA)
    rows = out.collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert "doc_id" in out.columns and {r["doc_id"] for r in rows} <= set(docs)
    if number in COLUMNS:
        assert out.columns[: len(COLUMNS[number])] == COLUMNS[number] and len(rows) == len(docs)
    if number == 3:
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    elif number == 4:
        from tokenizers import Tokenizer

        from tidewater.llm.tokens import default_tokenizer

        library, start = Tokenizer.from_file(default_tokenizer()), 0
        by = {r["doc_id"]: r for r in rows}
        for i in sorted(docs):
            ids = [*library.encode(docs[i], add_special_tokens=False).ids, 1]
            crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
            assert tuple(by[i]) == (i, start, len(ids), crc)
            start += len(ids)
    elif number == 6:
        assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(docs[r["doc_id"]].encode()) + 1, zlib.crc32(docs[r["doc_id"]].encode()), "bytes", None) for r in rows)
    elif number == 9:
        order = sorted(docs, reverse=True)
        following = dict(zip(order, order[1:] + order[:1]))
        for r in rows:
            t, n = docs[r["doc_id"]], len(docs[r["doc_id"]])
            edited = t[: n - n // 3] + docs[following[r["doc_id"]]][: n // 3]
            assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= r["near_next"] <= 1 and r["near_edited"] >= 0.5
    elif number == 10:
        keys = sorted(docs)
        want = {keys[i]: (keys[c], n) for i, (c, n) in brute_classes([docs[i] for i in keys]).items()}
        assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == want


@needs_data
def test_mixing_equals_its_sql(spark, tmp_path):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    registry.queries()["op8_poisson_mixing"](spark, DATA).write.parquet(str(tmp_path / "out"))
    names = "doc_id, text, lang, source, n_chars, copy, shuffle_key"
    c.execute(f"CREATE TABLE a AS SELECT {names} FROM '{tmp_path}/out/*.parquet'")
    c.execute(f"CREATE TABLE b AS SELECT {names} FROM ({registry.oracle_sql()['op8_poisson_mixing']})")
    for q in ("FROM a EXCEPT ALL FROM b", "FROM b EXCEPT ALL FROM a"):
        assert c.execute(f"SELECT count(*) FROM ({q})").fetchall() == [(0,)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_scratch_goes_with_its_session(tmp_path):
    """After the run only the last stage's scratch is there, and nothing once the session has stopped."""
    shared = tmp_path / "shared"
    code = f"""
import os, sys
from pyspark.sql import SparkSession
import corpus_pipeline
from tidewater.llm.common import scratch_path, shared_dir
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{shared}").getOrCreate()
made = corpus_pipeline.run(spark, "{DATA}")
assert made.count() > 0
left = sorted(x.rsplit("-", 1)[0] for x in os.listdir("{shared}"))
assert "pipeline-mixing" in left and not any(x in left for x in ("pipeline-toxicity", "toxicity-grams", "signatures", "pipeline-near_duplicates")), left
spark.stop()
assert [x for x in os.listdir("{shared}") if os.listdir(f"{shared}/" + x)] == []  # Spark itself keeps an empty folder
class Elsewhere:
    class conf:
        get = staticmethod(lambda name, default: None)
    class sparkContext:
        master = "spark://somewhere:7077"
try:
    shared_dir(Elsewhere)
except RuntimeError as error:
    print("refused:", error)
"""
    said = subprocess.run([sys.executable, "-c", code], cwd=REPO, env=os.environ | {"PYTHONPATH": str(REPO)}, capture_output=True, text=True, timeout=600)
    assert said.returncode == 0 and "refused: set spark.checkpoint.dir" in said.stdout, said.stderr[-2000:]
