"""Substring dedup: sliding sentence spans that occurred before are removed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import packed, unpacked
from tidewater.llm.shingles import mixed, powers_to
from tidewater.llm.spans import merged, range_units, row_hash

#: Consecutive sentences of a span at least, and words; a run of short sentences goes on until it has both.
RUN, MIN_WORDS = 3, 20
#: A longer sentence counts as several, cut by its words and not by its start, so that long passages in it have spans.
MAX_WORDS = 16

#: Stops that end a sentence before white space, and those of scripts that put none after them.
_STOPS, _OTHER_STOPS = ".!?", "。！？．｡؟۔।॥"
#: Letters of scripts written without blanks (Thai to Lao, Burmese, Khmer, kana, ideographs); each is a word.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_SENTENCE = re.compile(rf"(?:[^{_STOPS}\n]++|[{_STOPS}]++(?!\s))*+(?:[{_STOPS}]++|\n|$)\s*")
_OTHER_SENTENCE = re.compile(rf"(?:[^{_STOPS}{_OTHER_STOPS}\n]++|[{_STOPS}]++(?!\s))*+(?:[{_STOPS}]++|[{_OTHER_STOPS}]++|\n|$)\s*")
_OTHER_STOP = re.compile(f"[{_OTHER_STOPS}]")
_WORD = re.compile(r"\S+\s*")
_LETTER = re.compile(f"[{_UNSPACED}]")
_LETTER_OR_WORD = re.compile(rf"[{_UNSPACED}]\s*|[^\s{_UNSPACED}]+\s*")
#: Spans of a task that are looked through for repeats at once, before they are dealt out.
HELD = 400_000
#: Texts are worked off in pieces of about so many characters, whatever the size of a batch.
PIECE = 1 << 19


class _Hashes(dict):
    """Hashes of words; those of short words are remembered, up to a bound."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) < 40:
            if len(self) >= 1 << 16:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()


def _ends(words: list[str]) -> list[int]:
    """Where the parts of a long sentence end: after each word whose hash is the lowest of five words with it in the
    middle, wherever the sentence begins; where these are over MAX_WORDS apart, after the last lowest word so far."""
    h = list(map(_hashes.__getitem__, words))
    out, at = [], 0
    found = [i for i, (a, b, c, d, e) in enumerate(zip(h, h[1:], h[2:], h[3:], h[4:]), 3) if a > c < b and c <= d and c <= e]
    for i in [*found, len(h)]:
        while i - at > MAX_WORDS:
            near = h[at : at + MAX_WORDS][::-1]
            at += MAX_WORDS - near.index(min(near))
            out.append(at)
        out.append(i)
        at = i
    return out


def sentences(text: str) -> list[str]:
    """The sentences with the white space after them; together they are the text. They end at . ! or ? before white
    space, at the stops of other scripts and at line feeds; those of over MAX_WORDS words come in parts of MAX_WORDS at most."""
    out = []
    unspaced = not text.isascii() and _LETTER.search(text) is not None
    pattern = _LETTER_OR_WORD if unspaced else _WORD
    sentence = _SENTENCE if text.isascii() or not _OTHER_STOP.search(text) else _OTHER_SENTENCE
    for line in text.splitlines(keepends=True):
        for s in sentence.findall(line):
            if not s:
                continue
            if not unspaced and (len(s) <= 2 * MAX_WORDS or len(s.split(None, MAX_WORDS)) <= MAX_WORDS):
                out.append(s)
                continue
            words = pattern.findall(s)
            if len(words) <= MAX_WORDS:
                out.append(s)
                continue
            lead = len(s) - sum(map(len, words))
            bare = _words(s.lower(), unspaced)
            if lead:
                words[0] = s[:lead] + words[0]
            at = 0
            for end in _ends(bare):
                out.append("".join(words[at:end]))
                at = end
    return out


def _words(text: str, unspaced: bool) -> list[str]:
    return [w.rstrip() for w in _LETTER_OR_WORD.findall(text)] if unspaced else text.split()


def spans_of(texts: list[str], run: int = RUN, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text (its index), s, e and two hashes of the shortest runs of enough filled sentences and words from each sentence on and up to each.

    Words are compared without case, which neither ends nor joins sentences. Hashes are of polynomials over the hashes
    of sentences, so a run's is a difference of prefix sums.
    """
    digests, sizes, at, counts = [], [], [], []
    for t in texts:
        t = t.lower()
        unspaced = not t.isascii() and _LETTER.search(t) is not None
        before = len(at)
        for i, unit in enumerate(sentences(t)):
            if words := _words(unit, unspaced):
                digests.append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")))
                sizes.append(len(words))
                at.append(i)
        counts.append(len(at) - before)
    n = len(at)
    counts, at = np.array(counts, dtype=np.int64), np.array(at, dtype=np.int32)
    text = np.repeat(np.arange(len(texts)), counts)
    low, high = np.repeat(np.cumsum(counts) - counts, counts), np.repeat(np.cumsum(counts), counts)  # of the text of each sentence
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    place = np.arange(n)
    ends = np.maximum(np.searchsorted(total, total[:-1] + min_words), place + run)  # of the run from here on
    starts = np.minimum(np.searchsorted(total, total[1:] - min_words, "right") - 1, place + 1 - run)  # of the run up to here
    ahead, back = ends <= high, starts >= low
    back[ends[np.where(back, starts, 0)] == place + 1] = False  # the same run once
    first, last = np.concatenate([place[ahead], starts[back]]), np.concatenate([ends[ahead], place[back] + 1])
    h = np.zeros((len(first), 2), dtype=np.int64)
    if len(first):
        up, down = powers_to(n + 1)
        each = np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64).reshape(-1, 2)
        for k in range(2):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(each[:, k] * up[:n], dtype=np.uint64)])
            h[:, k] = mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)).view(np.int64)
    return text[first], at[first], at[last - 1], h


_SPANS = "doc_id bigint, row bigint, s int, e int, h1 bigint, h2 bigint, known boolean"


def _islands(d: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The disjoint ranges that ranges [s, e] of documents d cover."""
    order = np.lexsort((s, d))
    d, s, e = d[order], s[order].astype(np.int64), e[order].astype(np.int64)
    offset = np.cumsum(np.r_[0, d[1:] != d[:-1]]) << 32
    reach = np.maximum.accumulate(e + offset)
    new = np.r_[True, s[1:] + offset[1:] > reach[:-1] + 1]
    return d[new], s[new], (reach - offset)[np.r_[new[1:], True]]


def _span_batches(run: int, min_words: int, held_spans: int):
    """The spans of a partition, equal ones once for each HELD of them: the first is dealt out to meet those of other
    tasks, what the others cover is known here and now. So a span that stands in any share of all rows comes from a
    task a few times at most."""
    schema = pa.schema([pa.field(n, {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in _SPANS.split(", "))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, spans, documents, count = [], [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal documents, count
            # null ids come before all others, rows of one id by their hash
            id_, row = pa.chunked_array(ids, pa.int64()).combine_chunks(), np.concatenate(rows)
            none, id_ = np.asarray(id_.is_null()), id_.fill_null(0).to_numpy()
            ranks = np.lexsort((row, id_, ~none))
            new = np.r_[True, (id_[ranks[1:]] != id_[ranks[:-1]]) | (row[ranks[1:]] != row[ranks[:-1]]) | (none[ranks[1:]] != none[ranks[:-1]])]
            rank = np.empty(len(ranks), dtype=np.int64)
            rank[ranks] = np.cumsum(new)  # repeated rows are one document
            place = np.zeros(len(ranks) + 1, dtype=np.int64)
            place[rank] = np.arange(len(ranks))
            d, s, e = (np.concatenate([x[k] for x in spans]) for k in range(3))
            h = np.concatenate([x[3] for x in spans])
            where = rank[d]
            order = np.lexsort((s, where, h[:, 1], h[:, 0]))
            where, s, e, h = where[order], s[order], e[order], h[order]
            head = np.r_[True, (h[1:] != h[:-1]).any(axis=1)]
            leader = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
            again = (where != where[leader]) | (s != s[leader])
            k, ks, ke = _islands(where[again], s[again], e[again]) if again.any() else (where[:0], s[:0], e[:0])
            where, s, e = np.concatenate([where[head], k]), np.concatenate([s[head], ks]), np.concatenate([e[head], ke])
            known = np.arange(len(where)) >= head.sum()
            at = place[where]
            # known ranges go anywhere; their document spreads them
            keys = [np.concatenate([h[head, 0], row[at[known]]]), np.concatenate([h[head, 1], s[known].astype(np.int64)])]
            made = [pa.array(id_[at], pa.int64(), mask=none[at]), pa.array(row[at]), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(keys[0]), pa.array(keys[1]), pa.array(known)]
            table = pa.RecordBatch.from_arrays(made, schema=schema)
            for i in range(0, table.num_rows, 1 << 16):
                yield table.slice(i, 1 << 16)
            ids.clear(), rows.clear(), spans.clear()
            documents = count = 0

        for b in batches:
            texts, sizes = b.column("text").to_pylist(), np.cumsum(np.asarray(pc.utf8_length(b.column("text"))))
            start = 0
            while start < len(texts):
                end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + PIECE)))
                d, s, e, h = spans_of(texts[start:end], run, min_words)
                ids.append(b.column("doc_id").slice(start, end - start))
                rows.append(b.column("row").slice(start, end - start).to_numpy(zero_copy_only=False))
                spans.append((d + documents, s, e, h))
                documents, count, start = documents + end - start, count + len(d), end
                if count >= held_spans:
                    yield from flush()
        if count:
            yield from flush()

    return of


def _later(texts: DataFrame, run: int, min_words: int, held_spans: int) -> DataFrame:
    """(doc_id, row, covered) of the documents that have non-first repeated spans. One pass over the texts, one exchange of spans."""
    found = texts.mapInArrow(_span_batches(run, min_words, held_spans), _SPANS)
    order = Window.partitionBy("h1", "h2", "known").orderBy(F.asc_nulls_first("doc_id"), "row", "s")
    later = found.withColumn("rank", F.rank().over(order)).where("known or rank > 1")
    return later.groupBy("doc_id", "row").agg(F.collect_set(F.struct("s", "e")).alias("covered"))


def _without(text: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    out, counts = [], []
    for t, cut in zip(text, ranges, strict=True):
        units = sentences(t) if t else []
        counts.append(len(units))
        if t and cut is not None and len(cut):
            keep, at = [], 0
            for r in cut:
                keep += units[at : r["s"]]
                at = r["e"] + 1
            t = "".join(keep + units[at:])
        out.append(t)
    return pd.DataFrame({"text": out, "n_sentences": counts})


def dedup_substrings(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, held_spans: int = HELD) -> DataFrame:
    """Each document without the sentences that a non-first repeated span of `run` or more consecutive sentences covers.

    Replaces text; adds n_sentences, n_removed and removed (ranges [s, e] of removed sentences, from 0), in place of
    columns of these names; n_chars, where docs has it, follows the text. Of a repeated span the occurrence of the
    smallest doc_id, then the earliest, stays (null ids come first, by the row's hash). Documents of under
    `run` sentences or min_words words have no spans, so shorter repeats stay; a letter of a script written without
    blanks counts as a word. Rows of equal doc_id and text are one document. Null texts stay null, empty ones empty.
    No documents: no rows. held_spans bounds what a task keeps in memory, whatever the number of its rows.
    """
    columns = docs.columns
    rows = packed(docs).withColumn("row", row_hash(F.col("doc.doc_id"), F.col("doc.text")))
    texts = rows.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "row", F.col("doc.text").alias("text")).where("text is not null")
    later = _later(texts, run, min_words, held_spans).select(F.struct("doc_id", "row", "covered").alias("l"))
    joined = rows.join(later, (F.col("row") == F.col("l.row")) & F.col("doc.doc_id").eqNullSafe(F.col("l.doc_id")), "left")
    ranged = joined.select("doc", merged(F.col("l.covered")).alias("removed"))
    without = F.pandas_udf(_without, "struct<text:string,n_sentences:int>")
    done = ranged.withColumn("new", without(F.col("doc.text"), F.col("removed")))
    made = {"text": F.col("new.text"), "n_sentences": F.col("new.n_sentences"), "n_removed": range_units(F.col("removed")), "removed": F.col("removed")}
    if "n_chars" in columns:
        made["n_chars"] = F.coalesce(F.length("new.text"), F.lit(0)).cast("long")
    return unpacked(done, columns, **made)
