"""N-gram Jaccard join: MinHash banding finds candidates, full shingle sets verify every pair."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, packed, unpacked
from tidewater.llm.components import components
from tidewater.llm.shingles import WORDS, mixed, shingle_sets
from tidewater.llm.spans import row_hash

THRESHOLD = 0.8
#: The least probability with which a pair of exactly the threshold becomes a candidate.
RECALL = 0.99999
ROWS = 5
#: Sets that one verification block holds, and shingles in it.
BLOCK_SETS, BLOCK_SHINGLES = 128, 1_000_000
#: Up to so many large components (their size classes take some 100 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_LARGE = 20_000
#: Up to so many representatives (24 bytes each) are broadcast to fetch their texts; beyond, texts are fetched by shuffle.
BROADCAST_SETS = 200_000


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands of so many rows that reach the recall at the threshold."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return seeds[:n] | np.uint64(1), seeds[n:]


def signature(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The band hashes of a set: `rows` minima each."""
    a, b = _coefficients(bands * rows)
    low = np.full(bands * rows, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        hashed = a[:, None] * shingles[None, i : i + 2048] + b[:, None]
        hashed ^= hashed >> np.uint64(32)
        np.minimum(low, (hashed * np.uint64(0xD6E8FEB86659FD93)).min(axis=1), out=low)
    low = low.reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        out = mixed(out * np.uint64(31) + low[:, k])
    return out


def _sign(words: int, bands: int, rows: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, sizes, hashes, last = [], [], [], {}
            for s in shingle_sets(b["text"].tolist(), words):
                key = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
                if key not in last:  # copies in a batch share the work
                    last[key] = signature(s, bands, rows).view(np.int64) if len(s) else np.zeros(0, dtype=np.int64)
                ids.append(key)
                sizes.append(len(s))
                hashes.append(last[key])
            yield pd.DataFrame({"doc_id": b["doc_id"], "row": b["row"], "copy": b["copy"], "set": ids, "n": sizes, "bands": hashes})

    return of


def _find(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def linked_pairs(sets: list[np.ndarray], threshold: float, left: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) whose Jaccard similarity is at least the threshold, by counting common shingles of all at once.

    left: only pairs of one of the first `left` and one of the others.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, dtype=np.uint64)
    _, codes, uses = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = uses[codes] > 1
    codes, owner = codes[shared], owner[shared]
    _, codes = np.unique(codes, return_inverse=True)
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    width = 4096
    cuts = np.searchsorted(codes, np.arange(0, (codes[-1] if len(codes) else -1) + width + 1, width))
    for k in range(len(cuts) - 1):
        part = slice(cuts[k], cuts[k + 1])
        m = np.zeros((len(sets), width), dtype=np.float32)
        m[owner[part], codes[part] - k * width] = 1
        common += m @ m.T
    union = sizes[:, None] + sizes[None, :] - common
    # exact in integers: common / union >= threshold
    similar = (common >= threshold * union - 1e-6) & (union > 0)
    if left is not None:
        similar[:left, :left] = False
        similar[left:, left:] = False
    return np.nonzero(np.triu(similar, 1))


def _verify(words: int, threshold: float, bands: int, rows: int):
    def done(held: list[tuple]) -> pd.DataFrame:
        # a set that came twice (repeated rows) counts once
        one = {r[1]: r for r in sorted(held, key=lambda r: (not r[4], r[1]))}
        nodes = list(one)
        sets = list(shingle_sets([one[x][3] for x in nodes], words))
        _, _, _, _, _, within, band = one[nodes[0]]
        i, j = linked_pairs(sets, threshold, None if within else sum(one[x][4] for x in nodes))
        if band >= 0 and len(i):
            # a pair counts in the first bucket that it shares
            met = np.unique(np.concatenate([i, j]))
            signed = np.zeros((len(nodes), bands), dtype=np.uint64)
            signed[met] = [signature(sets[k], bands, rows) for k in met.tolist()]
            first = np.argmax(signed[i] == signed[j], axis=1) == band
            i, j = i[first], j[first]
        weight = np.array([one[x][2] for x in nodes], dtype=np.int64)
        links = np.bincount(i, weight[j], len(nodes)) + np.bincount(j, weight[i], len(nodes))
        parent = {k: k for k in range(len(nodes))}
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = _find(parent, a), _find(parent, b)
            parent[max(a, b)] = min(a, b)
        heads = [nodes[_find(parent, k)] for k in range(len(nodes))]
        out = pd.DataFrame({"set": nodes, "links": links.astype(np.int64), "head": heads})
        return out[out["links"] > 0]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for b in batches:
            for r in zip(b["block"], b["set"], b["weight"], b["text"], b["first"], b["within"], b["band"], strict=True):
                if r[0] != key:
                    if len(held) > 1:
                        yield done(held)
                    key, held = r[0], []
                held.append(r)
        if len(held) > 1:
            yield done(held)

    return of


def _parts(count: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(count / BLOCK_SETS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _numbered(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _block(name: Column, first: Column, within: Column) -> Column:
    return F.struct(name.alias("name"), first.alias("first"), within.alias("within"))


_BLOCK_COLUMNS = ["set", "weight", "doc_id", "row", "block", "first", "within", "band"]


def _blocks(sets: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """Each candidate set once for every verification block that it is part of.

    A component of candidates is one block where it is small enough. A larger one is parted in one of two ways, whichever
    sends fewer texts. By size: size classes, of which only equal and adjacent ones can hold links, in parts by hash; two
    parts meet in one block, so every pair that can be linked meets in exactly one block. By bucket: the sets of each
    band's bucket, in parts alike, so that only candidate pairs meet, and a pair counts in the first bucket it shares;
    a bucket of the same sets as one of an earlier band is left out, as no pair is first there. No task holds more than
    two parts.
    """
    # only components of more than one part need a size to be looked up; they have BLOCK_SETS sets or a long text each
    large = sets.groupBy("root").agg(_parts(F.count(F.lit(1)), F.sum("n")).alias("all_parts")).where("all_parts > 1").select("root", F.lit(True).alias("large"))
    large = materialize(large, "large")
    n_large = large.count()
    if not n_large:
        name = F.to_json(F.struct("root"))
        return sets.select("set", "weight", "doc_id", "row", name.alias("block"), F.lit(True).alias("first"), F.lit(True).alias("within"), F.lit(-1).alias("band"))
    sent = F.broadcast if n_large <= BROADCAST_LARGE else (lambda df: df)
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold))).cast("int")
    sets = sets.join(sent(large), "root", "left").withColumn("level", F.when(F.col("large"), level).otherwise(F.lit(0)))
    by_level = materialize(sets.where("large").groupBy("root", "level").agg(_parts(F.count(F.lit(1)), F.sum("n")).alias("parts"), F.count(F.lit(1)).alias("sets")), "levels")
    above = by_level.select("root", (F.col("level") - 1).alias("level"), F.col("parts").alias("parts_above"))
    below = by_level.select("root", (F.col("level") + 1).alias("level"), F.col("parts").alias("parts_below"))
    sized = by_level.join(above, ["root", "level"], "left").join(below, ["root", "level"], "left")

    # from the signatures, so that the bands of all other sets are not dealt out once more
    big = sets.where("large").select("set", "root", "n")
    big = materialize(big, "large-sets")
    big = F.broadcast(big) if big.count() <= BROADCAST_SETS else big
    members = materialize(signed.select("set", "bands").join(big, "set").groupBy("set", "root", "n").agg(F.any_value("bands").alias("bands")).select("set", "root", "n", F.posexplode("bands").alias("band", "hash")), "members")
    buckets = members.groupBy("band", "hash").agg(F.min("root").alias("root"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.bit_xor(F.xxhash64("set")).alias("mark")).where("size > 1")
    # one bucket of each different group of sets, that of the first band
    different = buckets.groupBy("root", "mark", "size", "shingles").agg(F.min(F.struct("band", "hash")).alias("b"))
    different = materialize(different.select("root", "b.band", "b.hash", "size", _parts(F.col("size"), F.col("shingles")).alias("parts")), "buckets")
    by_size = sized.groupBy("root").agg(F.sum(F.col("sets") * (F.col("parts") + F.coalesce("parts_above", F.lit(0)) + F.coalesce("parts_below", F.lit(0)))).alias("by_size"))
    costs = by_size.join(different.groupBy("root").agg(F.sum(F.col("size") * F.col("parts")).alias("by_bucket")), "root")
    chosen = materialize(costs.where("by_bucket < by_size").select("root", F.lit(True).alias("by_bucket")), "by-bucket")

    mine = sets.join(sent(chosen), "root", "left").where("by_bucket is null").join(sent(sized.drop("sets")), ["root", "level"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = mine.withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
    zero = F.lit(0)

    def block(low: Column, a: Column, high: Column, b: Column, first: Column) -> Column:
        name = F.to_json(F.struct(F.col("root"), low.alias("low"), a.alias("a"), high.alias("high"), b.alias("b")))
        return _block(name, first, (low == high) & (a == b))

    at, part = F.col("level"), F.col("part")
    same = F.transform(_numbered(F.col("parts")), lambda p: block(at, F.least(p, part), at, F.greatest(p, part), part <= p))
    up = F.transform(_numbered(F.coalesce("parts_above", zero)), lambda p: block(at, part, at + 1, p, F.lit(True)))
    down = F.transform(_numbered(F.coalesce("parts_below", zero)), lambda p: block(at - 1, p, at, part, F.lit(False)))
    each = mine.select("set", "weight", "doc_id", "row", F.explode_outer(F.concat(same, up, down)).alias("x"), F.lit(-1).alias("band"))

    # keys of a hot component are many, as each bucket is one
    dealt = members.join(different.join(sent(chosen), "root").select("band", "hash", "parts"), ["band", "hash"])
    dealt = dealt.join(sets.where("large").select("set", "weight", "doc_id", "row"), "set").withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
    low, high = lambda p: F.least(p, F.col("part")), lambda p: F.greatest(p, F.col("part"))
    of_bucket = lambda p: _block(F.to_json(F.struct("band", "hash", low(p).alias("a"), high(p).alias("b"))), F.col("part") <= p, F.col("part") == p)
    more = dealt.select("set", "weight", "doc_id", "row", F.explode_outer(F.transform(_numbered(F.col("parts")), of_bucket)).alias("x"), "band")
    return each.unionAll(more).select("set", "weight", "doc_id", "row", F.col("x.name").alias("block"), "x.first", "x.within", "band")


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, rows: int = ROWS) -> DataFrame:
    """doc_id, row, class_id, class_row, n_links of each document: classes are the components of all verified links.

    class_id is the smallest doc_id of the class (null last) and class_row the hash of that row. n_links counts the
    other different texts of similarity >= threshold (texts of equal shingles among them); copies add no links. Texts
    of under `words` words are one shingle; all texts without words, null ones among them, are one class without links
    between different ones. Repeated rows give repeated results. No documents: no rows.
    """
    bands = bands_for(threshold, recall, rows)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_hash(F.col("doc_id"), F.col("text")).alias("row"),
        F.xxhash64(F.lit("text"), F.coalesce("text", F.lit(""))).alias("copy"), F.coalesce("text", F.lit("")).alias("text"),
    )
    kind = "doc_id bigint, row bigint, copy bigint, set bigint, n int, bands array<bigint>"
    signed = materialize(texts.mapInPandas(_sign(words, bands, rows), kind), "signatures")
    different = signed.groupBy("set", "copy").agg(F.lit(1).alias("one")).groupBy("set").agg(F.count(F.lit(1)).alias("weight"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    heads = signed.groupBy("set").agg(first.alias("head"), F.max("n").alias("n"))
    sets = materialize(heads.join(different, "set").select("set", "n", "weight", "head.doc_id", "head.row"), "sets")

    # one row a set and band; a band's bucket links each of its sets to the smallest
    banded = signed.where("n > 0").select("set", F.posexplode("bands").alias("band", "hash"))
    banded = banded.groupBy("band", "hash", "set").agg(F.lit(1).alias("one")).select("band", "hash", "set")
    buckets = banded.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("size"), F.min("set").alias("low")).where("size > 1")
    edges = banded.join(buckets, ["band", "hash"]).where("set <> low").select(F.col("set").alias("a"), F.col("low").alias("b"))
    near = components(edges)

    candidates = sets.join(near, sets["set"] == near["node"]).select("set", "n", "weight", "doc_id", "row", "root")
    blocks = materialize(_blocks(candidates, signed, threshold), "blocks")
    fetch = blocks.select(F.struct(*_BLOCK_COLUMNS).alias("b"))
    if blocks.count() <= BROADCAST_SETS:
        fetch = F.broadcast(fetch)
    met = texts.join(fetch, (F.col("row") == F.col("b.row")) & F.col("doc_id").eqNullSafe(F.col("b.doc_id"))).select("b.set", "b.weight", "b.block", "b.first", "b.within", "b.band", "text")
    found = met.repartition("block").sortWithinPartitions("block").mapInPandas(_verify(words, threshold, bands, rows), "set bigint, links bigint, head bigint")
    found = materialize(found, "links")
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("set").alias("a"), F.col("head").alias("b")))

    placed = sets.join(roots, sets["set"] == roots["node"], "left").select("set", "weight", "doc_id", "row", F.coalesce("root", "set").alias("root"))
    tops = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("top"))
    classes = placed.join(tops, "root").join(links, "set", "left")
    classes = classes.select("set", F.col("top.doc_id").alias("class_id"), F.col("top.row").alias("class_row"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"))
    # as a table, so that the join starts from plain shuffles and the rows of a set of many copies can be split
    classes = materialize(classes, "set-classes")
    empty = F.col("n") == 0
    return signed.join(classes, "set").select("doc_id", "row", "class_id", "class_row", F.when(empty, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"))


def first_of_each(docs: DataFrame, **options: float) -> DataFrame:
    """The documents that come first in their class (smallest doc_id, null last), with their own columns; repeated rows once."""
    columns = docs.columns
    found = materialize(similar_documents(docs, **options), "classes")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("row") == F.col("class_row"))).groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("times"))
    keep = kept.select(F.struct("doc_id", "row", "times").alias("k"))
    rows = packed(docs).withColumn("row", row_hash(F.col("doc.doc_id"), F.col("doc.text")))
    joined = rows.join(keep, (F.col("row") == F.col("k.row")) & F.col("doc.doc_id").cast("long").eqNullSafe(F.col("k.doc_id")), "inner")
    if kept.where("times > 1").isEmpty():
        return unpacked(joined, columns)
    once = joined.where("k.times = 1").select("doc", "row")
    repeated = joined.where("k.times > 1").withColumn("doc_id", F.col("doc.doc_id")).dropDuplicates(["doc_id", "row"]).select("doc", "row")
    return unpacked(once.unionAll(repeated), columns)
