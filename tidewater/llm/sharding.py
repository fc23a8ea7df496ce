"""Sharding by histogram sort: refine splitters over exact byte counts, then exchange once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import binary_tree, materialize, packed, unpacked

#: A key is 40 bits of the text's hash (equal texts are neighbours) above 16 bits of the document's (which can part a large group).
GROUP_BITS, SALT_BITS = 40, 16
KEY_BITS = GROUP_BITS + SALT_BITS
#: Each round splits every open interval into 2 ** ROUND_BITS probes.
ROUND_BITS = 12
#: A group of equal texts of over 1 / HEAVY of all bytes is parted by salt; there are at most HEAVY such groups.
HEAVY = 512
LAW = "bytes"


@dataclass
class Splitters:
    """Keys at which shards 1, 2, ... begin, with the bytes below each and all bytes."""

    keys: list[int]
    below: list[int]
    total: int
    rounds: int


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 1; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1).cast("long")


def sort_key(text: Column, doc_id: Column) -> Column:
    group = F.shiftrightunsigned(F.xxhash64(F.lit("group"), text), 64 - GROUP_BITS)
    salt = F.shiftrightunsigned(F.xxhash64(F.lit("salt"), doc_id), 64 - SALT_BITS)
    return F.shiftleft(group, SALT_BITS).bitwiseOR(salt)


def find_splitters(keys: DataFrame, shards: int, tolerance: float = 0.001) -> Splitters:
    """Splitters of the (key, size) rows such that the bytes below splitter i are i / shards of all, within tolerance of a shard.

    Each round counts exact bytes below the candidate keys of all open intervals in one distributed aggregation of at
    most (shards - 1) * 2 ** ROUND_BITS rows, takes for each splitter the nearest candidate, and refines the interval
    around those that are not near enough. Candidates on a group's first key come first, so groups of equal texts stay
    whole where the tolerance allows it.
    """
    start = {0: (0, 0)}  # first key of an open interval: (bytes below it, its rank)
    width, total, found, rounds = KEY_BITS, None, {}, 0
    targets: dict[int, float] = {}
    where = keys
    while width > 0:
        bits = min(ROUND_BITS, width)
        shift = width - bits
        sums = {r["bin"]: r["bytes"] for r in where.groupBy(F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("bytes")).collect()}
        rounds += 1
        if total is None:
            total = sum(sums.values())
            targets = {i: total * i / shards for i in range(1, shards)}
        candidates = []  # (key, bytes below)
        for first, (below, _) in start.items():
            for b in range(first >> shift, (first >> shift) + (1 << bits)):
                candidates.append((b << shift, below))
                below += sums.get(b, 0)
            candidates.append((first + (1 << width), below))
        candidates.sort()
        opened = {}
        for i, target in targets.items():
            if i in found and found[i][2]:
                continue
            best = min(candidates, key=lambda c: (abs(c[1] - target), c[0] & ((1 << SALT_BITS) - 1)))
            near = abs(best[1] - target) <= tolerance * total / shards
            if i not in found or abs(best[1] - target) < abs(found[i][1] - target):
                found[i] = (best[0], best[1], near)
            if not near:
                at = max((c for c in candidates if c[1] <= target), key=lambda c: (c[1], c[0]))
                opened[at[0]] = (at[1], 0)
        start, width = opened, shift
        if not opened:
            break
        where = keys.where(F.shiftright("key", width).isin(sorted({k >> width for k in opened})))
    ordered = sorted(found.items())
    return Splitters([x[1][0] for x in ordered], [x[1][1] for x in ordered], total or 0, rounds)


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, chunk_bytes: int = 64 << 20) -> DataFrame:
    """Every document with its shard (0 to shards - 1) and its slot in it (0, 1, ... without gaps), under the law `bytes`.

    Adds size, shard, slot and law in place of columns of these names. Sizes of shards differ by the tolerance (a share
    of a shard) and one document at most. Equal texts stand next to each other and in one shard, but for groups that a
    boundary must part. Rows of the same text and doc_id are alike, so it does not matter which gets which slot. A null
    text is as an empty one of size 1; a null doc_id sorts first. No documents: no rows.
    Each shard is dealt out in key ranges of about chunk_bytes, or less where that would leave tasks idle, and a large
    group of equal texts by salt; a task sorts the ranges that hash to it, a few at most. Slots come from exact counts of
    the ranges: for these, one row a range, a task a shard.
    """
    columns = docs.columns
    base = packed(docs).select("doc", sort_key(F.col("doc.text"), F.col("doc.doc_id")).alias("key"), text_size(F.col("doc.text")).alias("size"))
    keys = materialize(base.select("key", "size"), "shard-keys")
    split = find_splitters(keys, shards, tolerance)
    group = F.shiftright("key", SALT_BITS)
    limit = max(split.total / HEAVY, 1.0)
    heavy = {r["g"]: r["bytes"] for r in keys.groupBy(group.alias("g")).agg(F.sum("size").alias("bytes")).where(F.col("bytes") > limit).collect()}
    tasks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-tasks // shards), min(1 << 20, -(-split.total // (shards * chunk_bytes))))
    edges = [0, *split.keys, 1 << KEY_BITS]

    def bins(df: DataFrame) -> DataFrame:
        of = binary_tree(F.col("key"), split.keys)
        low, high = (F.element_at(F.array(*[F.lit(x) for x in e]), F.col("shard") + 1) for e in (edges[:-1], edges[1:]))
        df = df.withColumn("shard", of)
        part = F.floor((F.col("key") - low) / F.greatest(high - low, F.lit(1)) * parts).cast("int")
        if not heavy:
            return df.withColumns({"part": part, "heavy": F.lit(0).cast("long"), "piece": F.lit(0)})
        pieces = max(2, min(1 << SALT_BITS, -(-max(heavy.values()) // min(chunk_bytes, max(1, int(limit / 4))))))
        is_heavy = group.isin(sorted(heavy))
        piece = F.floor((F.col("key") % (1 << SALT_BITS)) * pieces / (1 << SALT_BITS)).cast("int")
        return df.withColumns({"part": part, "heavy": F.when(is_heavy, group + 1).otherwise(0), "piece": F.when(is_heavy, piece).otherwise(0)})

    where = ["shard", "part", "heavy", "piece"]
    counts = bins(keys).groupBy(*where).agg(F.count(F.lit(1)).alias("n"))
    first = F.sum("n").over(Window.partitionBy("shard").orderBy("part", "heavy", "piece").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select(F.struct(*where, F.coalesce(first, F.lit(0)).alias("first")).alias("f"))
    # one row a range: about bytes / chunk_bytes of them, and HEAVY groups in pieces
    rank = F.row_number().over(Window.partitionBy(*where).orderBy("key", F.col("doc.doc_id")))
    placed = bins(base).withColumn("rank", rank)
    on = [F.col(c) == F.col(f"f.{c}") for c in where]
    joined = placed.join(F.broadcast(firsts) if parts * shards <= 4096 else firsts, on)
    return unpacked(joined, columns, size=F.col("size"), law=F.lit(LAW), shard=F.col("shard"), slot=(F.col("f.first") + F.col("rank") - 1).cast("long"))
