"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import packed, unpacked

#: A greater rate is parted into equal ones of this at most: a sum of Poisson draws is one of the summed rate.
MOST_RATE = 256.0
#: Up to so many sources their tables are broadcast (under 4 KB each, as no rate exceeds MOST_RATE); beyond, they are joined by shuffle.
BROADCAST_SOURCES = 2_000
#: Copies of a document that one array holds; more come from several.
BLOCK_COPIES = 4096
#: Hash digits of the uniform draw: 13 hex digits are 52 bits, exact in a double.
DRAW_DIGITS = 13


def target_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """source, n, rate: the mean number of copies that brings each source to its share of as many rows as there are.

    weights gives shares by source (a source it does not name gets 0); without it shares are proportional to
    n ** temperature. The null source counts as one source.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        items = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        share = F.coalesce(F.create_map(*items)[F.col("source")], F.lit(0.0)) if items else F.lit(0.0)
    shares = counts.withColumn("share", share)
    all_n, all_share = shares.agg(F.sum("n"), F.sum("share")).first()
    if not all_share:
        return shares.select("source", "n", F.lit(0.0).alias("rate"))
    return shares.select("source", "n", (F.col("share") / F.lit(all_share) * F.lit(float(all_n)) / F.col("n")).alias("rate"))


def poisson_table(rate: Column) -> Column:
    """The distribution function of Poisson(rate) at 0, 1, 2, ... up to where the tail is below a double's resolution.

    Terms are built from their logarithms, so rates of some hundreds do not underflow. For rates up to MOST_RATE or so.
    """
    last = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(24.0)).cast("int")
    start = F.struct((-rate).alias("log_p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate) - F.log(k.cast("double"))
        return F.struct(log_p.alias("log_p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(log_p))).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(1.0)))


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the parts; a null part counts as the word null."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DRAW_DIGITS), 16, 10).cast("double") / F.lit(float(16**DRAW_DIGITS))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, seed: str = "mix") -> DataFrame:
    """Each document as often as a Poisson draw with its source's mean says, in a globally shuffled order.

    Adds copy (0, 1, ...) and shuffle_key (in [0, 1)); a column of docs with one of these names is replaced. The draw
    inverts the distribution function at a uniform number hashed from doc_id, so it is the same in every run; rows that
    share a doc_id (repeated ones, or a null id) share the draw. A rate over MOST_RATE is the sum of equal ones below it,
    each with a draw hashed from doc_id and its number. Null texts count like others. No documents: no rows.
    The shuffle deals rows by the hash of their random key and sorts each partition by it, so one source or one group
    of copies never meets in one task; documents of a rate over MOST_RATE are dealt out before they are copied too.
    """
    columns = docs.columns
    parts = F.greatest(F.ceil(F.col("rate") / MOST_RATE), F.lit(1)).cast("long")
    rates = target_rates(docs, weights, temperature).select("source", "rate", parts.alias("parts")).select(F.struct("source", "parts", poisson_table(F.col("rate") / F.col("parts")).alias("cdf")).alias("r"))
    many = not rates.where("r.parts > 1").isEmpty()
    if len(rates.select(F.lit(1)).head(BROADCAST_SOURCES + 1)) <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = packed(docs).join(rates, F.col("doc.source").eqNullSafe(F.col("r.source")))
    below = lambda u: F.size(F.filter(F.col("r.cdf"), lambda c: c <= u)).cast("long")
    once = joined.where("r.parts = 1").withColumn("u", uniform(seed, F.col("doc.doc_id"))).withColumn("n", below(F.col("u"))).where("n > 0")
    # in an array the document stays whole: where a plan needs some of its fields, the optimizer would part it below each explosion and lose them
    box = F.array("doc").alias("box")
    keyed = lambda df: df.withColumn("shuffle_key", uniform(f"{seed} order", F.element_at("box", 1)["doc_id"], F.col("copy")))
    copies = keyed(once.select(box, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")))
    if many:
        # the draws in blocks: no array holds those of a whole document
        step = lambda n: F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / BLOCK_COPIES).cast("long"))
        inner = lambda b, n: F.sequence(b * BLOCK_COPIES, F.least((b + 1) * BLOCK_COPIES, n) - 1)
        drawn = lambda b: F.aggregate(inner(b, F.col("r.parts")), F.lit(0).cast("long"), lambda a, j: a + below(uniform(seed, F.col("doc.doc_id"), j)))
        often = joined.where("r.parts > 1").withColumn("n", F.aggregate(step(F.col("r.parts")), F.lit(0).cast("long"), lambda a, b: a + drawn(b)))
        # dealt out with their numbers, so that the explosion does not make them again
        often = often.select("doc", "n").repartition("n", F.xxhash64("doc.doc_id")).where("n > 0")
        blocks = often.select("doc", "n", F.explode(step(F.col("n"))).alias("block")).repartition("block", F.xxhash64("doc.doc_id"))
        copies = copies.unionAll(keyed(blocks.select(box, F.explode(inner(F.col("block"), F.col("n"))).alias("copy"))))
    dealt = copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return unpacked(dealt.withColumn("doc", F.element_at("box", 1)), columns, copy=F.col("copy"), shuffle_key=F.col("shuffle_key"))
