"""Token ids in binary shards, with Elias-Fano document boundaries over one id array."""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import materialize, scratch_path
from tidewater.llm.spans import row_hash

MAGIC = b"TIDETOK1"
#: Every so many-th document's place in the upper bits is kept.
SELECT = 64
#: A file is closed when it holds so many ids; a longer document has one of its own.
FILE_IDS = 8 << 20
#: Words whose ids a worker remembers at most before it starts anew.
MEMORY_WORDS = 1_000_000
_HEADER = struct.Struct("<8sQQQBB6x")


class EliasFano:
    """A sequence of non-decreasing numbers from 0: low bits side by side, high bits in unary, and samples to select by."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.packbits(((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        words = (int(at[-1]) if n else 0) // 64 + 1
        high = np.zeros(words * 64, dtype=np.uint8)
        high[at] = 1
        high = np.packbits(high, bitorder="little").view("<u8")
        return cls(n, bits, np.append(low, np.zeros(16, dtype=np.uint8)), high, at[::SELECT].astype("<u4" if words < 1 << 26 else "<u8"))

    def select(self, index: np.ndarray) -> np.ndarray:
        """The numbers at the given places, without unpacking the others."""
        index = np.asarray(index, dtype=np.int64)
        sample = self.samples[index // SELECT].astype(np.int64)
        word, left = sample >> 6, index % SELECT
        bits = self.high[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) << (sample & 63).astype(np.uint64))
        open_ = np.arange(len(index))
        while True:
            has = np.bitwise_count(bits[open_]).astype(np.int64)
            open_ = open_[left[open_] >= has]
            if not len(open_):
                break
            left[open_] -= np.bitwise_count(bits[open_]).astype(np.int64)
            word[open_] += 1
            bits[open_] = self.high[word[open_]]
        while (left > 0).any():  # drop lower ones
            more = left > 0
            bits[more] &= bits[more] - np.uint64(1)
            left[more] -= 1
        place = np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        high = ((word << 6) + place - index).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._lows(index)

    def _lows(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), dtype=np.uint64)
        at = index * self.low_bits
        out = np.zeros(len(index), dtype=np.uint64)
        for k in range(self.low_bits // 8 + 2):
            part = self.low[(at >> 3) + k].astype(np.uint64)
            shift = 8 * k - (at & 7)
            out |= np.where(shift >= 0, part << np.maximum(shift, 0).astype(np.uint64), part >> np.maximum(-shift, 0).astype(np.uint64))
        return out & np.uint64((1 << self.low_bits) - 1)

    def to_bytes(self) -> bytes:
        wide = self.samples.dtype.itemsize
        parts = [struct.pack("<QBB6xQQQ", self.count, self.low_bits, wide, len(self.low), len(self.high), len(self.samples)), self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        count, low_bits, wide, low, high, samples = struct.unpack_from("<QBB6xQQQ", data, at)
        at += struct.calcsize("<QBB6xQQQ")
        a = np.frombuffer(data, np.uint8, low, at)
        b = np.frombuffer(data, "<u8", high, at + low)
        c = np.frombuffer(data, f"<u{wide}", samples, at + low + 8 * high)
        return cls(count, low_bits, a, b, c), at + low + 8 * high + wide * samples


def encode_file(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """Header, boundaries, document ids, then the id array of `width` bytes an id; documents without an id come first."""
    nulls = sum(x is None for x in doc_ids)
    filled = doc_ids[nulls:]
    lowest = filled[0] if filled else 0
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]))
    names = EliasFano.of(np.array([x - lowest for x in filled], dtype=np.uint64))
    head = _HEADER.pack(MAGIC, len(doc_ids), sum(lengths), nulls, width, 0) + struct.pack("<q", lowest)
    return head + bounds.to_bytes() + names.to_bytes() + ids


class TokenFile:
    """A file's documents by place: doc_id(i), span(i), ids(i)."""

    def __init__(self, content: bytes) -> None:
        data = memoryview(content)
        magic, self.documents, self.tokens, self.nulls, self.width, _ = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        (self.lowest,) = struct.unpack_from("<q", data, _HEADER.size)
        self.bounds, at = EliasFano.from_bytes(data, _HEADER.size + 8)
        self.names, at = EliasFano.from_bytes(data, at)
        self.array = np.frombuffer(data, f"<u{self.width}", self.tokens, at)

    def spans(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index = np.asarray(index, dtype=np.int64)
        return self.bounds.select(index).astype(np.int64), self.bounds.select(index + 1).astype(np.int64)

    def doc_ids(self, index: np.ndarray) -> list[int | None]:
        index = np.asarray(index, dtype=np.int64)
        named = self.names.select(index[index >= self.nulls] - self.nulls).tolist()
        return [None] * int((index < self.nulls).sum()) + [x + self.lowest for x in named]


#: The normalizer and the splitting pattern for which words have ids of their own, wherever they stand.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Texts of these characters only are split here; for them that is the same. Others go to the library as a whole.
_PLAIN = re.compile("[\t\n\r -~¡-¬®-ÿ]*")
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")



def _byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_LETTERS = _byte_letters()


def _spelled(word: str) -> str:
    return "".join([_LETTERS[b] for b in word.encode("utf-8")])


class Encoder:
    """Texts to arrays of ids as bytes. Where the tokenizer splits into words first, a word is encoded once and remembered."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each core has a task of its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.by_word = spec["normalizer"] == _NORMALIZER and split.get("pattern") == {"Regex": _PATTERN} and split.get("invert") is True and spec["post_processor"] is None
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]) or "(?!)")
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}

    def _packed(self, ids: list[int]) -> bytes:
        made = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.by_word and _PLAIN.fullmatch(t) is not None and not self.special.search(t) for t in texts]
        words = [_WORD.findall(t.lower()) if p else [] for t, p in zip(texts, plain, strict=True)]
        if len(self.known) > MEMORY_WORDS:
            self.known.clear()
        new = list(set().union(*words).difference(self.known))
        tokenize, spelled = self.model.tokenize, _spelled
        self.known.update((w, self._packed([t.id for t in tokenize(w if w.isascii() else spelled(w))])) for w in new)
        rest = iter(self.tokenizer.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        get = self.known.__getitem__
        return [b"".join(map(get, w)) if p else self._packed(next(rest).ids) for w, p in zip(words, plain, strict=True)]


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer() -> str:
    """Where the tokenizer file of the query is, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri)) if re.match(r"\w+:", uri) else (pyarrow.fs.LocalFileSystem(), uri)


def _groups(texts: pd.Series, size: int = 1 << 20) -> Iterator[slice]:
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _write(uri: str, tokenizer: str | None, end_id: int, file_ids: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer or default_tokenizer())
        end = encoder._packed([end_id])
        fs, base = _filesystem(uri)
        part, sequence = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        lengths: list[int] = []
        chunks: list[bytes] = []
        held = 0

        def close() -> pd.DataFrame:
            nonlocal sequence, held
            name = f"{part:08d}-{sequence:06d}.tok"
            content = encode_file(names, lengths, b"".join(chunks), encoder.width)
            # under another name first: a task that ran before and was lost leaves whole files or none
            draft = f"{base}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(draft) as file:
                file.write(content)
            fs.move(draft, f"{base}/{name}")
            row = pd.DataFrame({"file": [name], "documents": [len(names)], "tokens": [sum(lengths)]})
            names.clear(), lengths.clear(), chunks.clear()
            sequence, held = sequence + 1, 0
            return row

        for b in batches:
            for piece in _groups(b["text"]):
                ids = b["doc_id"].iloc[piece]
                for doc_id, tokens in zip(ids, encoder.encode(b["text"].iloc[piece].tolist()), strict=True):
                    n = len(tokens) // encoder.width + 1
                    if names and held + n > file_ids:
                        yield close()
                    names.append(None if pd.isna(doc_id) else int(doc_id))
                    lengths.append(n)
                    chunks += (tokens, end)
                    held += n
        if names:
            yield close()

    return of


def write_tokens(docs: DataFrame, uri: str | None = None, tokenizer: str | None = None, end_id: int = 1, file_ids: int = FILE_IDS) -> tuple[str, DataFrame]:
    """Write the token files of all documents in ascending doc_id order; the folder and its list (file, documents, tokens, start).

    A null text is as an empty one: only the end id. Null ids come first, rows of equal id by their hash; file names
    ascend with the order. tokenizer: a file of the tokenizers library that every executor has at this path; without it
    the installed one. No documents: no files. uri: a folder in the shared store; without it one in the scratch folder.
    """
    spark = docs.sparkSession
    uri = uri or scratch_path(spark, "tokens")
    fs, base = _filesystem(uri)
    fs.create_dir(base, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), row_hash(F.col("doc_id"), F.col("text")).alias("row"))
    dealt = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    # Arrow would give a nullable id as a float
    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))
    files = materialize(dealt.mapInPandas(_write(uri, tokenizer, end_id, file_ids), "file string, documents bigint, tokens bigint"), "token-files")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return uri, files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


_READ = "file string, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, content in zip(b["path"], b["content"], strict=True):
            file = TokenFile(content)
            for i in range(0, file.documents, 8192):
                index = np.arange(i, min(i + 8192, file.documents))
                start, end = file.spans(index)
                crc = [zlib.crc32(file.array[s:e].astype("<u4").tobytes()) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
                yield pd.DataFrame({"file": path.rpartition("/")[2], "doc_id": pd.array(file.doc_ids(index), dtype="Int64"), "local": start, "n_tokens": end - start, "ids_crc32": crc})


def read_tokens(files: DataFrame, uri: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, as the files have them."""
    spark = files.sparkSession
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(uri).select("path", "content")
    found = content.mapInPandas(_read, _READ)
    return found.join(files.select("file", "start"), "file").select("doc_id", (F.col("start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
