"""Elias-Fano against plain arrays, the encoder against the library, files there and back."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewater.llm import tokens as k


@pytest.mark.parametrize("seed", range(8))
def test_elias_fano(seed):
    r = np.random.default_rng(seed)
    for n, step in ((0, 1), (1, 1), (2, 10**12), (500, 3), (3000, 1000), (200, 10**15), (1000, 1)):
        values = np.cumsum(r.integers(0, step, n, endpoint=True)).astype(np.uint64)
        if seed % 2 and n:
            values[n // 2 :] += np.uint64(10**9)
        ef, at = k.EliasFano.from_bytes(memoryview(b"pad" + k.EliasFano.of(values).to_bytes()), 3)
        index = r.permutation(n)
        assert (ef.select(index) == values[index]).all()
        if n == 3000:
            assert 8 * (len(ef.low) + 8 * len(ef.high) + len(ef.samples) * 4) < n * (np.log2(max(1, int(values[-1]) / n)) + 4)


def texts():
    r = random.Random(3)
    odd = ["It's  we'll HE'D !!'s ''ve x²³ ½ 12,000% \t\n\r--__", "<|endoftext|> a <|startoftext|>b <| x", "naïve CAFÉ ÀÖØ ß ÿ ª º µ ×÷", "한글 🌟 ∑≠ ΑΣ Σ İi  ­\u0085  é", "", "a" * 3000, "\x1c\x00x", "…’"]
    odd += [" ".join(r.choice("some quite ordinary words of a long text, é 12".split()) for _ in range(60_000)), "한글 text " * 20_000, "x1" * 100_000]
    pool = "abcdeéßñ'’.,!?-_ 0123½\n\tÀΣ한 <|>"
    return odd + ["".join(r.choice(pool) for _ in range(r.randint(0, 200))) for _ in range(300)] + [None]


def ids_of(library, t):
    return library.encode(t or "", add_special_tokens=False).ids


def test_encoder_is_the_library(monkeypatch):
    monkeypatch.setattr(k, "MEMORY_WORDS", 50)
    path = k.default_tokenizer()
    library, encoder = Tokenizer.from_file(path), k.Encoder(path)
    given = [t or "" for t in texts()]
    assert encoder.by_word and encoder.width == 2
    for i in range(0, len(given), 40):
        for t, got in zip(given[i : i + 40], encoder.encode(given[i : i + 40])):
            assert np.frombuffer(got, "<u2").tolist() == ids_of(library, t), t


@pytest.mark.parametrize("file_ids", [k.FILE_IDS, 500])
def test_files_there_and_back(spark, file_ids):
    library = Tokenizer.from_file(k.default_tokenizer())
    rows = [(i * 11 - 40, t, 9) for i, t in enumerate(texts())]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(6)
    uri, files = k.write_tokens(df, file_ids=file_ids)
    got = sorted(tuple(r) for r in k.read_tokens(files, uri).collect())
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda x: x[0]):
        ids = np.array([*ids_of(library, t), 1], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert files.count() > (20 if file_ids == 500 else 0)


def test_null_ids_ties_and_no_rows(spark):
    schema = "doc_id long, text string"
    big = (1 << 62) + 1
    rows = [(None, "b"), (None, None), (big, "a"), (big, "a"), (-big, "c d"), (5, "")]
    uri, files = k.write_tokens(spark.createDataFrame(rows, schema))
    got = sorted(k.read_tokens(files, uri).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, -big, 5, big, big]
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 2, 2, 2, 3] and got[-1]["start"] == sum(r["n_tokens"] for r in got[:-1])
    uri, files = k.write_tokens(spark.createDataFrame([], schema))
    assert k.read_tokens(files, uri).count() == 0
