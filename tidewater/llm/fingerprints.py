"""Document fingerprints from prefix polynomial hashes.

The prefix arrays of a text, modulo two primes, give the hash of any span by one subtraction and product. A fingerprint
keeps the hashes of some prefixes and suffixes, so two fingerprints tell, by binary search, how far their texts agree
from either end.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import binary_tree
from tidewater.llm.spans import row_hash

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525003)
#: Prefixes and suffixes that a fingerprint has at most of each; their lengths are multiples of a power of two.
SAMPLES = 32
#: Ranges of documents for each shuffle partition.
RANGES = 4
_LOWEST = -(1 << 63)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _powers_to(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the bases and of their inverses, 0 to n at least, by doubling."""
    if not _powers or len(_powers[0][0]) <= n:
        made = []
        for p, base in zip(PRIMES, BASES, strict=True):
            pair = []
            for b in (base % p, pow(base, -1, p)):
                a = np.ones(1, dtype=np.uint64)
                while len(a) <= n:
                    a = np.concatenate([a, a * np.uint64(pow(b, len(a), p)) % np.uint64(p)])
                pair.append(a)
            made.append(tuple(pair))
        _powers[:] = made
    return _powers


class Prefixes:
    """The prefix arrays of a text by code points."""

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        powers = _powers_to(self.n)
        self.sums = []
        for p, (up, _) in zip(PRIMES, powers, strict=True):
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            # terms are below 2 ** 31: 2 ** 32 of them fit
            np.cumsum(codes * up[: self.n] % np.uint64(p), out=sums[1:])
            self.sums.append(sums % np.uint64(p))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans [start, end), the same wherever a span stands; one row for each prime."""
        powers = _powers_to(self.n)
        return np.stack([(s[end] + np.uint64(p) - s[start]) % np.uint64(p) * down[start] % np.uint64(p) for p, s, (_, down) in zip(PRIMES, self.sums, powers, strict=True)])

    def equal(self, start: int, end: int, other: Prefixes, other_start: int) -> bool:
        here, there = np.array([start, end]), np.array([other_start, other_start + end - start])
        return bool((self.spans(here[:1], here[1:]) == other.spans(there[:1], there[1:])).all())

    def common_extension(self, i: int, other: Prefixes, j: int) -> int:
        """How many code points from i on are those of the other text from j on."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, i + mid, other, j) else (low, mid - 1)
        return low


class Joined:
    """Hashes of the text made of the first a code points of one and the first b of another, without its arrays."""

    def __init__(self, one: Prefixes, a: int, other: Prefixes, b: int) -> None:
        self.one, self.a, self.other, self.b, self.n = one, a, other, b, a + b

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a = self.a
        first = self.one.spans(np.minimum(start, a), np.minimum(end, a))
        second = self.other.spans(np.maximum(start, a) - a, np.maximum(end, a) - a)
        lead = np.maximum(a - start, 0)
        powers = _powers_to(self.n)
        return np.stack([(f + s * up[lead]) % np.uint64(p) for f, s, p, (up, _) in zip(first, second, PRIMES, powers, strict=True)])


def _stride(n: int) -> int:
    return 1 << max(0, (max(n, 1) - 1) // SAMPLES).bit_length()


def fingerprint(text: Prefixes | Joined) -> str:
    """Length, hash of the whole, hashes of prefixes, hashes of suffixes; 62 and 32 bits, in hexadecimal."""
    n = text.n
    at = np.append(np.arange(1, n // _stride(n) + 1) * _stride(n), n)
    zero = np.zeros(len(at), dtype=np.int64)
    ahead, back = text.spans(zero, at), text.spans(n - at, zero + n)
    whole = int(ahead[0, -1]) << 31 | int(ahead[1, -1])
    short = lambda h: ((h[0] ^ (h[1] << np.uint64(1))) & np.uint64(0xFFFFFFFF)).astype(">u4")[:-1].tobytes().hex()
    return f"{n:x}.{whole:016x}.{short(ahead)}.{short(back)}"


def _agreeing(a: str, b: str, step_a: int, step_b: int, most: int) -> int:
    """Samples are hashes of growing prefixes, so the last common one is found by binary search."""
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        i, j = mid * step_a * 8, mid * step_b * 8
        low, high = (mid, high) if a[i - 8 : i] == b[j - 8 : j] else (low, mid - 1)
    return low


def likeness(a: str, b: str) -> float:
    """Share of the longer text that agrees with the other from the start or the end, as far as the samples tell; 1 for equal ones."""
    if a == b:
        return 1.0
    (n, _, ahead, back), (m, _, other_ahead, other_back) = a.split("."), b.split(".")
    n, m = int(n, 16), int(m, 16)
    s, t = _stride(n), _stride(m)
    step = max(s, t)
    most = min(n, m) // step
    same = sum(_agreeing(x, y, step // s, step // t, most) for x, y in ((ahead, other_ahead), (back, other_back)))
    # both ends cannot hold more than the shorter text
    return min(same * step, min(n, m)) / max(n, m) if max(n, m) else 1.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with a column fingerprint (in place of one so named) of the whole text; a null text is as an empty one."""
    from tidewater.llm.common import packed, unpacked

    of = F.pandas_udf(lambda texts: pd.Series([fingerprint(Prefixes(t)) for t in texts.fillna("")], dtype=object), "string")
    return unpacked(packed(docs).withColumn("f", of(F.col("doc.text"))), docs.columns, fingerprint=F.col("f"))


_PAIRED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by range and descending order, the first row of the following range last: each row meets the one after it."""
    where, held = None, None
    for b in batches:
        out = []
        for bin_, halo, doc_id, text in zip(b["bin"], b["halo"], b["doc_id"], b["text"], strict=True):
            if bin_ != where:
                where, held = bin_, None
            elif held is None:
                continue  # a tie with the following range's first row
            own = Prefixes(text)
            row = (None if pd.isna(doc_id) else int(doc_id), text, own, fingerprint(own))
            if held is not None:
                out.append(_pair(held, row))
            held = None if halo else row
        yield pd.DataFrame({c: pd.Series([r[k] for r in out], dtype=t) for k, (c, t) in enumerate(zip([x.split()[0] for x in _PAIRED.split(", ")], ["Int64", "int64", object, object, object, float, float], strict=True))})


def _pair(one: tuple, after: tuple) -> tuple:
    doc_id, text, own, print_ = one
    _, next_text, following, next_print = after
    cut = own.n // 3
    joined = Joined(own, own.n - cut, following, min(cut, following.n))
    edited = text[: own.n - cut] + next_text[:cut]
    changed = fingerprint(joined)
    digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
    return doc_id, own.n, digest, print_, changed, likeness(print_, changed), likeness(print_, next_print)


def _bin(id_: Column, row: Column, cuts: Counter) -> Column:
    """The number of a row's range, ascending with (id, row). An id that several cuts fall on has several ranges of its own, by row."""
    bounds = sorted(cuts)
    below = binary_tree(id_, bounds)
    pieces = F.element_at(F.array(F.lit(1), *[F.lit(cuts[x]) for x in bounds]), below + 1)
    own = F.element_at(F.array(F.lit(None).cast("long"), *[F.lit(x) for x in bounds]), below + 1)
    place = F.floor((row.cast("double") / F.lit(2.0**64) + F.lit(0.5)) * pieces)
    piece = F.when(pieces == 1, F.lit(0)).when(id_ == own, F.least(place, pieces - 1)).otherwise(pieces)
    return below.cast("long") * F.lit(len(cuts) + sum(cuts.values()) + 1) + piece


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Of each document its fingerprint, that of its edited text, and their likeness, and that to the next document.

    The next document is the one of the next smaller doc_id (null last; rows of equal id by their hash), the first one
    after the last. The edited text has the last third of the code points replaced by the first as many of the next
    document, or all of them. Null texts are as empty ones. One document is its own next. No documents: no rows.
    Documents are dealt out by ranges of doc_id, those of an id that many rows share by ranges of their hash, and of each
    range the first row goes to the range before it as well, so no task needs more than its range in order, one text
    after the other.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LOWEST)).alias("id"), row_hash(F.col("doc_id"), F.col("text")).alias("row"))
    parts = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = Counter(int(x) for x in rows.select("id").approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts))
    rows = rows.withColumn("bin", _bin(F.col("id"), F.col("row"), cuts))
    tops = sorted((r["bin"], r["top"]["id"], r["top"]["row"]) for r in rows.groupBy("bin").agg(F.max(F.struct("id", "row")).alias("top")).collect())  # one row a range
    if not tops:
        return spark.createDataFrame([], _PAIRED)
    to = spark.createDataFrame([(i, r, tops[(k + 1) % len(tops)][0]) for k, (_, i, r) in enumerate(tops)], "top long, top_row long, target long")
    firsts = rows.where(F.col("id").isin([i for _, i, _ in tops])).join(F.broadcast(to), (F.col("id") == F.col("top")) & (F.col("row") == F.col("top_row"))).dropDuplicates(["target"])
    whole = rows.withColumn("halo", F.lit(False)).unionByName(firsts.select("doc_id", "text", "id", "row", F.col("target").alias("bin"), F.lit(True).alias("halo")))
    dealt = whole.repartition("bin").sortWithinPartitions("bin", "halo", F.desc("id"), F.desc("row"))
    return dealt.select("bin", "halo", "doc_id", "text").mapInPandas(_paired, _PAIRED)
