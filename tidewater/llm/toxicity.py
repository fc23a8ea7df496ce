"""Toxicity by class-conditional Kneser-Ney models over bytes.

Two models of the next byte, one of toxic and one of ordinary training documents, each of Kneser-Ney type from five
bytes of context down to two, end in the same continuation counts of one byte of context and none, gathered from both.
A text's evidence is the difference of its log-likelihoods over its length, as a whole and in its two most toxic
blocks; a logistic curve fitted on other labelled rows turns it into a score from 0 to 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import binary_tree, materialize, packed, release, unpacked

#: Bytes of a gram: five of context and the one foretold. Six bytes fill 48 bits of a long.
ORDER = 6
#: Grams of up to so many bytes count for both classes together.
SHARED = 2
DISCOUNT = 0.75
#: Bytes of a block; a text's two most toxic blocks are evidence beside the whole.
BLOCK = 32
#: So many grams of the model are broadcast at once (12 bytes each, in a table at most 60 % full); of a larger one each part in a pass of its own.
BROADCAST_GRAMS = 4_000_000
#: Up to so many labels (16 bytes each) are broadcast to the documents; beyond, both meet in a shuffled join.
BROADCAST_LABELS = 500_000
#: The logistic curve has five parameters and is fitted on about so many labelled rows at most, chosen by the hash of their id.
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.3
#: Texts are worked off in pieces of about so many bytes, whatever the size of a batch.
PIECE = 1 << 19
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 4).cast("int")


def _pieces(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, grams of some texts, in order, and how many each has).

    A text counts in lower case with a run of white space as one blank; its first bytes follow zeros.
    """
    start, parts, size = 0, [], 0
    for i, t in enumerate(texts):
        parts.append(" ".join(t.lower().split()).encode("utf-8", "replace"))
        size += len(parts[-1])
        if size >= PIECE or i == len(texts) - 1:
            pad = b"\0" * (ORDER - 1)
            flat = np.frombuffer(pad + pad.join(parts), dtype=np.uint8).astype(np.uint64)
            lengths = np.array([len(p) for p in parts], dtype=np.int64)
            n = len(flat) - ORDER + 1
            grams = np.zeros(max(n, 0), dtype=np.uint64)
            for k in range(ORDER):
                grams <<= np.uint64(8)
                grams |= flat[k : k + n]
            # grams that end in the zeros between texts are none
            starts = np.cumsum(lengths + (ORDER - 1)) - lengths - (ORDER - 1)
            keep = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            yield start, grams[keep], lengths
            start, parts, size = i + 1, [], 0


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts by class of the grams of a partition, given out whenever some millions have gathered."""
    keys, counts, held = [], [], 0

    def flush() -> pd.DataFrame:
        k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
        toxic = (k & np.uint64(1)).astype(bool)
        return pd.DataFrame({"gram": (k >> np.uint64(1)).astype(np.int64), "toxic": np.where(toxic, n, 0), "plain": np.where(toxic, 0, n)})

    for b in batches:
        for label in (0, 1):
            texts = b["text"][b["label"] == label].tolist()
            for _, grams, _ in _pieces(texts):
                k, n = np.unique((grams << np.uint64(1)) | np.uint64(label), return_counts=True)
                keys.append(k)
                counts.append(n)
                held += len(k)
                if held > 2_000_000:
                    yield flush()
                    keys, counts, held = [], [], 0
    if keys:
        yield flush()


def _mask(order: int) -> int:
    return (1 << (8 * order)) - 1


def _keyed(order: int, gram: Column) -> Column:
    """A gram, or a context by the order of the gram it belongs to, as one number."""
    return gram.bitwiseOR(F.lit(order << 48))


def gram_tables(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, value) of seen grams with their log-likelihood ratio, and of contexts with that of their back-off weights.

    labelled: text, label. Counts come from all rows; below the highest order the count of a gram is the number of
    bytes that were seen before it, in its class or, up to SHARED bytes, in either.
    """
    counted = labelled.mapInPandas(_count_grams, "gram bigint, toxic bigint, plain bigint").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))
    levels = {ORDER: materialize(counted, "toxicity-grams")}
    for k in range(ORDER - 1, 0, -1):
        kinds = [F.sum((F.col(c) > 0).cast("long")).alias(c) for c in ("toxic", "plain")] if k > SHARED else [F.count(F.lit(1)).alias("toxic")]
        kinds += [] if k > SHARED else [F.count(F.lit(1)).alias("plain")]
        levels[k] = levels[k + 1].groupBy(F.col("gram").bitwiseAND(_mask(k)).alias("gram")).agg(*kinds)
    grams, contexts, below = [], [], None
    for k in range(1, ORDER + 1):
        context = F.shiftright("gram", 8)
        of = Window.partitionBy(context)  # at most 256 rows
        made = {"context": context, "low": F.col("gram").bitwiseAND(_mask(k - 1))}
        for c in ("toxic", "plain"):
            made |= {f"{c}_all": F.sum(c).over(of), f"{c}_kinds": F.sum((F.col(c) > 0).cast("int")).over(of)}
        seen = levels[k].withColumns(made)
        seen = seen.withColumns({"toxic_low": F.lit(1.0 / 256), "plain_low": F.lit(1.0 / 256)}) if below is None else seen.join(below, "low")

        def weight(c: str) -> Column:
            return F.when(F.col(f"{c}_all") > 0, F.lit(DISCOUNT) * F.col(f"{c}_kinds") / F.col(f"{c}_all")).otherwise(F.lit(1.0))

        def p(c: str) -> Column:
            return F.when(F.col(f"{c}_all") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"{c}_all")).otherwise(F.lit(0.0)) + weight(c) * F.col(f"{c}_low")

        level = seen.select("gram", "context", p("toxic").alias("toxic_low"), p("plain").alias("plain_low"), F.log(weight("toxic") / weight("plain")).cast("float").alias("weight"))
        if k > SHARED:
            level = materialize(level, "toxicity-level")
            grams.append(level.select(_keyed(k, F.col("gram")).alias("key"), F.log(F.col("toxic_low") / F.col("plain_low")).cast("float").alias("value")))
            contexts.append(level.groupBy(_keyed(k, F.col("context")).alias("key")).agg(F.max("weight").alias("value")))
        below = level.select(F.col("gram").alias("low"), "toxic_low", "plain_low")
    return reduce(DataFrame.unionAll, grams), reduce(DataFrame.unionAll, contexts)


class Lookup:
    """An open-addressing table from 48-bit keys to floats, filled and read by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) / 0.6))))
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _EMPTY, dtype=np.uint64)
        self.values = np.zeros(1 << bits, dtype=np.float32)
        keys = keys.astype(np.uint64)
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slots[left]] == _EMPTY
            at, first = np.unique(slots[left[free]], return_index=True)
            won = left[free][first]
            self.keys[at], self.values[at] = keys[won], values[won]
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none) and whether there is one."""
        slots = self._slot(keys)
        found = self.keys[slots]
        hit = found == keys
        out = np.where(hit, self.values[slots], np.float32(0))
        open_ = np.flatnonzero(~hit & (found != _EMPTY))
        while len(open_):
            slots[open_] = (slots[open_] + np.uint64(1)) & self.mask
            found = self.keys[slots[open_]]
            same = found == keys[open_]
            out[open_[same]] = self.values[slots[open_[same]]]
            hit[open_[same]] = True
            open_ = open_[~same & (found != _EMPTY)]
        return out, hit


def block_sums(texts: list[str], grams: Lookup, contexts: Lookup, low: int = 0, high: int = 1 << 16) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes of each text, sums of the log-likelihood ratios of each of their blocks), of some texts at once.

    Only bytes after two bytes from low to below high, as one number, count: what is looked up for a byte is in the part
    of the model for the two bytes before it, whatever the order.
    """
    for start, g, lengths in _pieces(texts):
        if not len(g):
            yield start, lengths, np.zeros(0)
            continue
        ratio, open_ = np.zeros(len(g), dtype=np.float32), np.arange(len(g))
        if (low, high) != (0, 1 << 16):
            before = (g >> np.uint64(8)) & np.uint64(0xFFFF)
            open_ = np.flatnonzero((before >= np.uint64(low)) & (before < np.uint64(high)))
        for k in range(ORDER, SHARED, -1):
            part, tag = g[open_] & np.uint64(_mask(k)), np.uint64(k << 48)
            value, hit = grams.get(part | tag)
            ratio[open_] += value
            open_ = open_[~hit]
            ratio[open_] += contexts.get((part[~hit] >> np.uint64(8)) | tag)[0]
        begins = np.cumsum(lengths) - lengths
        per = -(-lengths // BLOCK)
        block_begins = np.repeat(begins - (np.cumsum(per) - per) * BLOCK, per) + np.arange(per.sum()) * BLOCK
        yield start, lengths, np.add.reduceat(ratio, block_begins, dtype=np.float64)


def _summary(lengths: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Of each text the mean ratio a byte, and those of its first and second most toxic block, a missing one 0."""
    out = np.zeros((len(lengths), 3))
    filled = np.flatnonzero(lengths)
    if not len(filled):
        return out
    per = -(-lengths[filled] // BLOCK)
    first = np.cumsum(per) - per
    out[filled, 0] = np.add.reduceat(sums, first) / lengths[filled]
    top = np.maximum.reduceat(sums, first)
    out[filled, 1] = top / BLOCK
    rest = sums.copy()
    at = np.flatnonzero(sums == np.repeat(top, per))
    rest[at[np.unique(np.repeat(np.arange(len(per)), per)[at], return_index=True)[1]]] = -np.inf
    second = np.maximum.reduceat(rest, first)
    out[filled, 2] = np.where(np.isfinite(second), second, 0) / BLOCK
    return out


def evidence(texts: list[str], grams: Lookup, contexts: Lookup) -> np.ndarray:
    """Of each text a row of the mean log-likelihood ratio a byte, and those of its first and second most toxic block."""
    found = [_summary(lengths, sums) for _, lengths, sums in block_sums(texts, grams, contexts)]
    return np.concatenate(found) if found else np.zeros((0, 3))


@dataclass
class Model:
    """Grams and contexts as tables with a column part, the ranges of two bytes that the parts stand for, and the logistic curve.

    A model of one part is broadcast once and for all; of several parts each is broadcast for a pass of its own.
    """

    grams: DataFrame
    contexts: DataFrame
    ranges: list[tuple[int, int]]
    curve: list[float]
    centre: list[float]
    scale: list[float]
    sent: tuple[Broadcast, Broadcast] | None = None

    def part(self, k: int) -> tuple[Broadcast, Broadcast]:
        spark = self.grams.sparkSession
        return tuple(spark.sparkContext.broadcast(_lookup(t.where(F.col("part") == k).select("key", "value"))) for t in (self.grams, self.contexts))

    def rated(self, rows: DataFrame, text: Column) -> DataFrame:
        """rows with a column e: mean, peak, second. Each pass over several parts adds to the sums of blocks, which go with their rows."""
        if len(self.ranges) == 1:
            self.sent = self.sent or self.part(0)
            return rows.withColumn("e", _evidence_column(text, *self.sent))
        columns, done = rows.columns, rows.withColumn("sums", F.lit(None).cast("array<double>"))
        for k, (low, high) in enumerate(self.ranges):
            sent = self.part(k)
            passed = materialize(done.withColumn("sums", _sums_column(text, F.col("sums"), *sent, low, high)), "toxicity-pass")
            release(done)
            done = passed
            for one in sent:
                one.destroy()
        return done.select(*columns, _summary_column(text, F.col("sums")).alias("e"))


def _parted(grams: DataFrame, contexts: DataFrame, most: int) -> tuple[DataFrame, DataFrame, list[tuple[int, int]]]:
    """The tables with a column part, and the range of two bytes before a foretold one that each part has: as many as `most` grams hold, one at least."""
    before = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    counts = {r["before"]: r["count"] for r in grams.groupBy(before.alias("before")).count().collect()}  # 2 ** 16 at most
    bounds, held = [], 0
    for x in sorted(counts):
        if held and held + counts[x] > most:
            bounds.append(x)
            held = 0
        held += counts[x]
    made = [t.withColumn("part", binary_tree(b, bounds)) for t, b in ((grams, before), (contexts, F.col("key").bitwiseAND(0xFFFF)))]
    if bounds:
        made = [materialize(t, "toxicity-parts", "part") for t in made]
    return *made, list(zip([0, *bounds], [*bounds, 1 << 16], strict=True))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float], list[float]]:
    """Ridge logistic regression by Newton steps, on standardised evidence."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w)), a.T @ (p - y) + 0.1 * w)
    return w.tolist(), centre.tolist(), scale.tolist()


def _features(rated: pd.DataFrame) -> np.ndarray:
    e = [rated[c].fillna(0.0).to_numpy() for c in ("mean", "peak", "second")]
    return np.column_stack([*e, np.minimum(e[1], 2 * np.maximum(e[2], 0))])


def train(docs: DataFrame, labels: DataFrame, broadcast_grams: int = BROADCAST_GRAMS) -> Model | float:
    """Counts from all labelled rows of folds 0 and 1, the curve from rows of fold 3; nothing from fold 2.

    Several labels of a document count as its largest. Without rows of both classes: the share of toxic rows, or 0.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))

    few = marks.count() <= BROADCAST_LABELS

    def rows(folds: list[int]) -> DataFrame:
        texts = docs.where(F.col("text").isNotNull() & fold(F.col("doc_id")).isin(folds)).select("doc_id", "text")
        wanted = marks.where(fold(F.col("doc_id")).isin(folds))
        return texts.join(F.broadcast(wanted) if few else wanted, "doc_id")

    shares = marks.where(fold(F.col("doc_id")) != 2).agg(F.avg("label")).first()[0] or 0.0
    if shares in (0.0, 1.0):
        return float(shares)
    grams, contexts = (materialize(t, "toxicity-model") for t in gram_tables(rows([0, 1]).select("text", "label")))
    share = CALIBRATION_ROWS / max(CALIBRATION_ROWS, marks.where(fold(F.col("doc_id")) == 3).count())
    held = rows([3]).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(share * (1 << 20))).select("label", "text")
    model = Model(*_parted(grams, contexts, broadcast_grams), [], [], [])
    rated = model.rated(held, F.col("text")).select("label", "e.*").toPandas()
    if rated["label"].nunique() < 2:
        return float(shares)
    model.curve, model.centre, model.scale = _fit_curve(_features(rated), rated["label"].to_numpy().astype(float))
    return model


def _lookup(table: DataFrame) -> Lookup:
    """From two columns, which come as Arrow batches; 12 bytes a row."""
    keys, values = table.toArrow().columns
    return Lookup(keys.to_numpy(), values.to_numpy())


_EVIDENCE = "mean double, peak double, second double"


def _framed(summary: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame(summary, columns=["mean", "peak", "second"])


def _evidence_column(text: Column, grams: Broadcast, contexts: Broadcast) -> Column:
    return F.pandas_udf(lambda texts: _framed(evidence(texts.fillna("").tolist(), grams.value, contexts.value)), _EVIDENCE)(text)


def _sums_column(text: Column, sums: Column, grams: Broadcast, contexts: Broadcast, low: int, high: int) -> Column:
    def of(texts: pd.Series, before: pd.Series) -> pd.Series:
        out = []
        for _, lengths, sums in block_sums(texts.fillna("").tolist(), grams.value, contexts.value, low, high):
            out += np.split(sums, np.cumsum(-(-lengths // BLOCK))[:-1])
        return pd.Series([x if b is None else x + b for x, b in zip(out, before, strict=True)], dtype=object)

    return F.pandas_udf(of, "array<double>")(text, sums)


def _summary_column(text: Column, sums: Column) -> Column:
    def of(texts: pd.Series, sums: pd.Series) -> pd.DataFrame:
        lengths = np.array([len(" ".join(t.lower().split()).encode("utf-8", "replace")) for t in texts.fillna("")], dtype=np.int64)
        return _framed(_summary(lengths, np.concatenate(sums.tolist()) if len(sums) else np.zeros(0)))

    return F.pandas_udf(of, _EVIDENCE)(text, sums)


def score(docs: DataFrame, labels: DataFrame, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """Every document with held_out, score, predicted, evidence_mean and evidence_peak, in place of columns so named.

    Null and empty texts have no evidence and get the score of that. Repeated rows get equal scores. A null doc_id is
    not held out and never trains. No documents: no rows.
    """
    columns = docs.columns
    model = train(docs, labels, broadcast_grams)
    rows = packed(docs)
    held_out = F.coalesce(fold(F.col("doc.doc_id")) == 2, F.lit(False))
    if isinstance(model, float):
        value = F.lit(model)
        return unpacked(rows, columns, held_out=held_out, score=value, predicted=(value >= THRESHOLD).cast("int"), evidence_mean=F.lit(0.0), evidence_peak=F.lit(0.0))
    rated = model.rated(rows, F.col("doc.text"))
    mean, peak, second = (F.coalesce(f"e.{c}", F.lit(0.0)) for c in ("mean", "peak", "second"))
    z = F.lit(model.curve[0])
    for x, w, c, s in zip((mean, peak, second, F.least(peak, 2 * F.greatest(second, F.lit(0.0)))), model.curve[1:], model.centre, model.scale, strict=True):
        z = z + F.lit(w) * (x - F.lit(c)) / F.lit(s)
    value = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    rated = rated.withColumn("value", value)
    return unpacked(rated, columns, held_out=held_out, score=F.col("value"), predicted=(F.col("value") >= THRESHOLD).cast("int"), evidence_mean=mean, evidence_peak=peak)


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is under the threshold, with their own columns, whatever their names."""
    columns = docs.columns
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own"))
    return score(whole, labels).where(F.col("score") < threshold).select(*[F.col("own").getField(c).alias(c) for c in columns])
