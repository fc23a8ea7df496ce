"""Benchmark decontamination: every passage queries a BM25 index of the test items by block-max WAND; overlap decides.

An item's impacts are divided by the sum of them all, so a score is the share of the item that the passage holds, from 0
to 1, and one threshold suits long and short items.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, packed, release, scratch_path, unpacked
from tidewater.llm.shingles import WORDS, word_hashes
from tidewater.llm.spans import row_hash

K1, B = 1.2, 0.75
#: Share of an item's BM25 mass in a passage from which on it is retrieved, and of the shingles of question and answer.
RETRIEVE, OVERLAP = 0.7, 0.8
#: One index holds so many items and so much text at most; a larger benchmark gets several, each broadcast for itself and gone before the next.
INDEX_ITEMS, INDEX_CHARS = 8192, 8_000_000
#: Blocks of an index, over which each term keeps the maximum of its impacts.
BLOCKS = 64
#: A passage has at least so many words; it has twice the longest item's, and every second half overlaps the next.
LEAST_PASSAGE = 64
_PIECE = 1 << 19
_SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+|\n|$)")


def parts_of(text: str) -> tuple[str, str]:
    """Question and answer of an item: the last sentence with words is the answer; a single one is both."""
    found = [s for s in _SENTENCE.findall(text) if any(c.isalnum() for c in s)]
    return (" ".join(found[:-1]), found[-1]) if len(found) > 1 else (text, text)


def _hashes(text: str) -> np.ndarray:
    return word_hashes([text.lower().encode("utf-8", "replace")])[0]


def _grams(words: np.ndarray, n: int) -> set[tuple[int, ...]]:
    w = words.tolist()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@dataclass
class Index:
    """An inverted index: of each term its items, their impacts, and the maxima by block."""

    items: list[int]
    parts: list[tuple[np.ndarray, np.ndarray]]
    terms: np.ndarray
    postings: list[tuple[np.ndarray, np.ndarray]]
    block_max: np.ndarray
    term_max: np.ndarray
    block_size: int
    passage: int


@dataclass
class Statistics:
    """Of all items with words: how many, their words on average and at most, and of each term needed its items."""

    n: int
    average: float
    longest: int
    frequency: dict[int, int]


def build_index(items: list[tuple[int, str]], whole: Statistics | None = None) -> Index | None:
    """None if no item has words. Items without words are not in it: they have nothing to be found by.

    whole: the statistics of the whole benchmark, where items are a part of it.
    """
    filled = [(i, t, h) for i, t in items if t and len(h := _hashes(t))]
    if not filled:
        return None
    lengths = [len(h) for *_, h in filled]
    counts = [Counter(h.tolist()) for *_, h in filled]
    if whole is None:
        whole = Statistics(len(filled), sum(lengths) / len(lengths), max(lengths), Counter(t for c in counts for t in c))
    frequency, average = whole.frequency, whole.average
    terms = np.array(sorted({t for c in counts for t in c}), dtype=np.uint64)
    number = {t: k for k, t in enumerate(terms.tolist())}
    lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for k, (c, n) in enumerate(zip(counts, lengths, strict=True)):
        w = {t: np.log1p((whole.n - frequency[t] + 0.5) / (frequency[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * n / average)) for t, f in c.items()}
        mass = sum(w.values())
        for t, x in w.items():
            lists[number[t]].append((k, x / mass))
    postings = [(np.array([k for k, _ in lists[t]]), np.array([x for _, x in lists[t]])) for t in range(len(terms))]
    size = -(-len(filled) // BLOCKS)
    block_max = np.zeros((len(terms), -(-len(filled) // size)), dtype=np.float32)
    for t, (k, x) in enumerate(postings):
        np.maximum.at(block_max[t], k // size, x.astype(np.float32))
    parts = [tuple(map(_hashes, parts_of(t))) for _, t, _ in filled]
    return Index([i for i, *_ in filled], parts, terms, postings, block_max, block_max.max(axis=1), size, max(LEAST_PASSAGE, 2 * whole.longest))


def block_max_wand(index: Index, query: list[int], threshold: float) -> list[tuple[int, float]]:
    """All items whose score for the distinct terms of the query reaches the threshold, in order."""
    lists = [(index.postings[t][0].tolist(), index.postings[t][1].tolist(), float(index.term_max[t]), index.block_max[t]) for t in query]
    at = [0] * len(lists)
    end, out = len(index.items), []
    live = list(range(len(lists)))
    slack = threshold - 1e-5  # maxima are single precision

    def seek(j: int, item: int) -> None:
        docs, i = lists[j][0], at[j]
        while i < len(docs) and docs[i] < item:
            i += 1
        at[j] = i

    while live:
        live = [j for j in live if at[j] < len(lists[j][0])]
        live.sort(key=lambda j: lists[j][0][at[j]])
        bound, pivot = 0.0, None
        for k, j in enumerate(live):
            bound += lists[j][2]
            if bound >= slack:
                pivot = k
                break
        if pivot is None:
            break
        item = lists[live[pivot]][0][at[live[pivot]]]
        while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]] == item:
            pivot += 1
        block = item // index.block_size
        head = live[: pivot + 1]
        if sum(float(lists[j][3][block]) for j in head) < slack:
            # no item of this block before the next list's can reach the threshold
            after = lists[live[pivot + 1]][0][at[live[pivot + 1]]] if pivot + 1 < len(live) else end
            target = max(item + 1, min((block + 1) * index.block_size, after))
            for j in head:
                seek(j, target)
            continue
        if lists[head[0]][0][at[head[0]]] == item:
            score = sum(lists[j][1][at[j]] for j in head)
            if score >= threshold - 1e-9:
                out.append((item, score))
            for j in head:
                at[j] += 1
        else:
            for j in head:
                seek(j, item)
    return out


def _overlap(part: np.ndarray, document: dict[int, set], words: np.ndarray) -> float:
    """Share of the part's shingles that the document has; a part of fewer words is one shingle."""
    n = min(WORDS, len(part))
    if n == 0:
        return 1.0
    if n not in document:
        document[n] = _grams(words, n)
    own = _grams(part, n)
    return len(own & document[n]) / len(own)


def find_items(texts: list[str], index: Index, retrieve: float = RETRIEVE, overlap: float = OVERLAP) -> list[list[dict]]:
    """Of each text the items that a passage of it retrieves and the text as a whole overlaps with."""
    out: list[list[dict]] = [[] for _ in texts]
    start = 0
    half = index.passage // 2
    while start < len(texts):
        encoded, size, first = [], 0, start
        while start < len(texts) and size < _PIECE:
            encoded.append(texts[start].lower().encode("utf-8", "replace"))
            size += len(encoded[-1])
            start += 1
        hashes, counts = word_hashes(encoded)
        term = np.searchsorted(index.terms, hashes)
        term[term == len(index.terms)] = 0
        known = index.terms[term] == hashes
        # passage h of a text holds its half passages h and h + 1
        owner = np.repeat(np.arange(len(counts)), counts)
        begins = np.cumsum(counts) - counts
        halves = np.maximum(1, -(-counts // half))
        base = np.cumsum(halves) - halves
        h = base[owner] + (np.arange(len(hashes)) - begins[owner]) // half
        h, t, o = h[known], term[known], owner[known]
        earlier = h > base[o]
        pairs = np.unique(np.concatenate([h * len(index.terms) + t, (h[earlier] - 1) * len(index.terms) + t[earlier]]))
        if not len(pairs):
            continue
        passage, t = pairs // len(index.terms), pairs % len(index.terms)
        cut = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        bounds = np.r_[cut, len(pairs)]
        step = 1 << 12
        for i in range(0, len(cut), step):
            low, high = bounds[i], bounds[min(i + step, len(cut))]
            best = np.add.reduceat(index.block_max[t[low:high]], cut[i : i + step] - low, axis=0).max(axis=1)
            for k in (i + np.flatnonzero(best >= retrieve - 1e-4)).tolist():
                text = int(np.searchsorted(base, passage[cut[k]], "right")) - 1
                for item, score in block_max_wand(index, t[bounds[k] : bounds[k + 1]].tolist(), retrieve):
                    out[first + text].append({"item": item, "score": score})
        for text in range(first, start):
            if out[text]:
                best_of: dict[int, float] = {}
                for x in out[text]:
                    best_of[x["item"]] = max(best_of.get(x["item"], 0.0), x["score"])
                words = hashes[begins[text - first] : begins[text - first] + counts[text - first]]
                grams: dict[int, set] = {}
                found = [(index.items[k], s, *(_overlap(p, grams, words) for p in index.parts[k])) for k, s in sorted(best_of.items())]
                out[text] = [{"item_id": i, "score": s, "question_overlap": q, "answer_overlap": a} for i, s, q, a in found if q >= overlap and a >= overlap]
    return out


KIND = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"


def _item_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        hashes = [_hashes(t) for t in b["text"]]
        # a row without a term holds the item's length
        terms = [[None, *np.unique(h).view(np.int64).tolist()] if len(h) else [] for h in hashes]
        lengths = [x for h, t in zip(hashes, terms, strict=True) if t for x in [len(h)] + [None] * (len(t) - 1)]
        yield pd.DataFrame({"part": b["part"].repeat([len(t) for t in terms]).to_numpy(), "t": pd.array([x for t in terms for x in t], dtype="Int64"), "length": pd.array(lengths, dtype="Int64")})


def _statistics(items: DataFrame) -> tuple[tuple[int, float, int], DataFrame]:
    """n, average and greatest length of all items with words; and (part, t, df), the items of each term of each part."""
    each = materialize(items.select("part", "text").mapInPandas(_item_terms, "part int, t bigint, length bigint"), "benchmark-terms")
    n, words, longest = each.agg(F.count("length"), F.sum("length"), F.max("length")).first()
    counted = each.where("t is not null").groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.collect_set("part").alias("parts"))
    frequencies = materialize(counted.select(F.explode("parts").alias("part"), "t", "df"), "benchmark-frequencies")
    release(each)
    return (n, words / n if n else 0.0, longest or 0), frequencies


def _indexes(benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """Indexes of the benchmark, one after the other, with the statistics of the whole, and whether there are several.

    Each comes to the driver by itself, in parts of bounded size; null texts and ids are left out.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, chars = items.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    shards = max(1, -(-n // (INDEX_ITEMS // 2)), -(-(chars or 0) // (INDEX_CHARS // 2))) if n > INDEX_ITEMS or (chars or 0) > INDEX_CHARS else 1
    if shards == 1:
        index = build_index([tuple(r) for r in items.orderBy("item_id", "text").collect()])
        if index is not None:
            yield index, False
        return
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
    sizes, frequencies = _statistics(items)
    # by part, so that each is read once
    dealt = materialize(items, "benchmark-parts", "part")
    frequencies = materialize(frequencies, "benchmark-parts", "part")
    for k in range(shards):
        part = dealt.where(F.col("part") == k).orderBy("item_id", "text").select("item_id", "text").collect()
        rows = frequencies.where(F.col("part") == k).select("t", "df").toPandas()
        whole = Statistics(*sizes, dict(zip(rows["t"].to_numpy(np.int64).view(np.uint64).tolist(), rows["df"].tolist(), strict=True)))
        index = build_index([tuple(r) for r in part], whole)
        if index is not None:
            yield index, True
    release(dealt, frequencies)


def _found(docs: DataFrame, index: Index) -> tuple[DataFrame, Broadcast]:
    """docs with a column found: the items of one index that text leaks."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    return docs.withColumn("found", F.pandas_udf(lambda texts: pd.Series(find_items(texts.fillna("").tolist(), sent.value)), KIND)("text")), sent


def _rated(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """doc_id, row, x of each leak; None where nothing can leak.

    With several indexes a pass over the documents for each, written before the next is made: no machine holds more than one.
    """
    rows = docs.select("doc_id", row_hash(F.col("doc_id"), F.col("text")).alias("row"), "text")
    path = None
    for index, several in _indexes(benchmark):
        with_items, sent = _found(rows, index)
        each = with_items.select("doc_id", "row", F.explode_outer("found").alias("x")).where("x is not null")
        if not several:
            return each
        path = path or scratch_path(docs.sparkSession, "leaks")
        each.write.mode("append").parquet(path)
        sent.destroy()
    return None if path is None else docs.sparkSession.read.schema(each.schema).parquet(path)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every leaked item of every document.

    Texts are compared by words without case. Null and empty texts leak nothing, nor does anything of an empty
    benchmark; equal items are each reported; repeated rows give repeated results.
    """
    rated = _rated(docs, benchmark)
    if rated is None:
        return docs.select("doc_id", F.explode(F.array().cast(KIND)).alias("x")).select("doc_id", "x.*")
    return rated.select("doc_id", "x.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with their own columns."""
    indexes = _indexes(benchmark)
    first = next(indexes, None)
    if first is None:
        return docs
    whole = packed(docs)
    if not first[1]:
        rated, _ = _found(whole.withColumn("text", F.col("doc.text")), first[0])
        return unpacked(rated.where(F.size("found") == 0), docs.columns)
    indexes.close()
    gone = _rated(docs, benchmark)
    keys = gone.select("doc_id", "row").distinct().select(F.struct("doc_id", "row").alias("g"))
    rows = whole.withColumn("row", row_hash(F.col("doc.doc_id"), F.col("doc.text")))
    return unpacked(rows.join(keys, (F.col("row") == F.col("g.row")) & F.col("doc.doc_id").eqNullSafe(F.col("g.doc_id")), "left_anti"), docs.columns)
