"""Line and substring dedup against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.llm import lines, spans, substrings

SCHEMA = "doc_id long, text string, lang string, row int, covered string, n_chars long"


def rows(texts, ids=None):
    return [(i if ids is None else ids[i], t, "en", 7, "x", None if t is None else len(t)) for i, t in enumerate(texts)]


def brute(docs, units_of, runs_of):
    """docs: (id, text) sorted with null ids first; the texts without non-first repeated runs."""
    seen, out = set(), {}
    for key, text in docs:
        units, gone = units_of(text or ""), set()
        for s, e, run in runs_of(text or ""):
            if run in seen:
                gone.update(range(s, e + 1))
            seen.add(run)
        out[key] = None if text is None else "".join(u for i, u in enumerate(units) if i not in gone)
    return out


def line_runs(text):
    filled = [(i, x.strip()) for i, x in enumerate(text.split("\n")) if x.strip()]
    return [(filled[j][0], filled[j + 2][0], tuple(x for _, x in filled[j : j + 3])) for j in range(len(filled) - 2)]


def sentence_runs(text):
    units = [(i, x.lower().split()) for i, x in enumerate(substrings.sentences(text)) if x.split()]
    enough = lambda j, k: k - j >= 3 and sum(len(w) for _, w in units[j:k]) >= 10
    n, found = len(units), set()
    for j in range(n):
        found |= {(j, k) for k in [next((k for k in range(j, n + 1) if enough(j, k)), None)] if k}
        found |= {(i, j + 1) for i in [next((i for i in range(j, -1, -1) if enough(i, j + 1)), None)] if i is not None}
    return [(units[j][0], units[k - 1][0], tuple(tuple(w) for _, w in units[j:k])) for j, k in sorted(found)]


def corpus(seed):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(1, 9))) + r.choice(".!?") for _ in range(25)]
    pool += ["a!", "b!", "c!"]
    texts = ["".join(r.choice(pool) + r.choice([" ", "\n", "\n\n", " \n"]) for _ in range(r.randint(0, 14))) for _ in range(40)]
    block = "\n".join(pool[:6])
    short = " ".join(r.choice("ABCDEFG") + "!!" for _ in range(30))
    return texts + [short + " x", "y.\n" + short, block, block + "\n" + pool[9], "x\n" + block, "", None, "\n\n\n", " ", "word " * 3000, "a\n" * 900]


def test_sentences_keep_the_text():
    for t in corpus(3):
        if t:
            assert "".join(substrings.sentences(t)) == t
            assert len(substrings.sentences(t)) == len(substrings.sentences(t.lower()))
    assert max(len(x.split()) for x in substrings.sentences("w " * 100)) == substrings.MAX_WORDS


def check(spark, dedup, units_of, runs_of):
    texts = corpus(1)
    ids = [3 * ((i * 7919) % len(texts)) for i in range(len(texts))]
    df = spark.createDataFrame(rows(texts, ids), SCHEMA).repartition(5)
    got = {r["doc_id"]: r for r in dedup(df).collect()}
    want = brute(sorted(zip(ids, texts)), units_of, runs_of)
    assert {k: r["text"] for k, r in got.items()} == want
    assert sum(r["n_removed"] > 0 for r in got.values()) >= 3
    assert all(r["row"] == 7 and r["covered"] == "x" and r["n_chars"] == len(r["text"] or "") for r in got.values())


def test_lines_against_brute_force(spark):
    check(spark, lines.dedup_lines, lambda t: t.splitlines(keepends=True) if t else [], line_runs)


@pytest.mark.parametrize("held", [1, 40, substrings.HELD])
def test_substrings_against_brute_force(spark, held):
    check(spark, lambda df: substrings.dedup_substrings(df, min_words=10, held_spans=held), substrings.sentences, sentence_runs)


def test_scripts_without_blanks(spark):
    r = random.Random(4)
    letters = lambda n: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(n))
    passage = "".join(letters(r.randint(3, 30)) + r.choice("。！？") for _ in range(40))
    unstopped = letters(200)
    texts = [(1, "甲。" + passage + letters(9)), (2, letters(5) + "。" + passage), (3, letters(300)), (4, letters(2) + unstopped), (5, letters(7) + unstopped + "です")]
    got = {x["doc_id"]: x for x in substrings.dedup_substrings(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [got[k]["n_removed"] > 0 for k in (1, 2, 3, 4, 5)] == [False, True, False, False, True]
    assert len(got[2]["text"]) <= 6 and len(got[5]["text"]) < 60
    assert all("".join(substrings.sentences(t)) == t for _, t in texts)
    assert len(substrings.sentences(passage)) >= 40 and substrings.sentences("यह एक है। वह दो है।") == ["यह एक है। ", "वह दो है।"]


def test_many_ranges_of_one_document(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(59_999)), lambda i: F.struct((i * 4 - i % 2 * 2).alias("s"), (i * 4 - i % 2 * 2 + 1).alias("e"))).alias("c"))
    want = []
    for s in sorted(i * 4 - i % 2 * 2 for i in range(60_000)):
        want = [*want[:-1], [want[-1][0], s + 1]] if want and s <= want[-1][1] + 1 else want + [[s, s + 1]] if len(want) < 50 else want
        if len(want) == 50:
            break
    got = df.select(spans.merged(F.col("c")).alias("m"), spans.merged(F.lit(None).cast("array<struct<s:int,e:int>>")).alias("none")).first()
    assert [[x["s"], x["e"]] for x in got["m"][:49]] == want[:49] and len(got["m"]) == 30_000 and got["none"] == []


def test_repeated_rows_null_ids_and_empty_tables(spark):
    block = "one two three four five six seven.\neight nine ten eleven twelve thirteen.\na b c d e f g h i j k l.\n"
    for dedup in (lines.dedup_lines, substrings.dedup_substrings):
        got = dedup(spark.createDataFrame([(1, block), (1, block), (2, block), (None, "other\n" + block)], "doc_id long, text string")).collect()
        assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in got) == [(-1, 0), (1, 3), (1, 3), (2, 3)]
        assert dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_passages_after_leads_of_any_length(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    lead = lambda n: "".join(word() + " " for _ in range(n))
    passages = [[word() for _ in range(80)] for _ in range(20)] + [["ever", "and", "again"] * 30]
    texts = [(100 * p + n, lead(n) + " ".join(x) + " " + lead(7)) for p, x in enumerate(passages) for n in (1, 2, 5, 11, 16, 23)]
    tabbed = [(9000 + n, (lead(n) + " ".join(passages[0])).replace(" ", "\t").upper()) for n in (3, 4)]
    got = substrings.dedup_substrings(spark.createDataFrame(texts + tabbed, "doc_id long, text string")).collect()
    for row in got:
        if row["doc_id"] % 100 != 1 or row["doc_id"] >= 9000:
            assert len(row["text"].split()) <= len(dict(texts + tabbed)[row["doc_id"]].split()) - 50, row["doc_id"]
        elif row["doc_id"] < 2000:  # the last passage repeats itself
            assert row["n_removed"] == 0
    for text in (lead(200), "Ab " * 100, " x\ty" * 90 + "."):
        units = substrings.sentences(text)
        assert "".join(units) == text and max(len(x.split()) for x in units) <= substrings.MAX_WORDS
