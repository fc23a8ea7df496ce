"""Repeated spans: find spans of units (lines, sentences) that occurred before, anywhere, and cover them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tidewater.llm.common import materialize

#: The order of occurrences in one number: doc_id, then 28 bits of the row's hash, then 32 bits of position.
_ROW_BITS, _POS_BITS = 28, 32


def row_hash(doc_id: Column, text: Column) -> Column:
    """Tells rows that share a doc_id apart; repeated rows are one document."""
    return F.xxhash64(F.lit("row"), doc_id, text)


def _order(doc_id: Column, row: Column, pos: Column) -> Column:
    wide = DecimalType(20, 0)
    return F.coalesce(doc_id, F.lit(-(1 << 63))).cast(wide) * F.lit(1 << (_ROW_BITS + _POS_BITS)).cast(wide) + (
        row.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) * F.lit(1 << _POS_BITS) + pos.cast("long")
    ).cast(wide)


def later_occurrences(each: DataFrame) -> DataFrame:
    """(doc_id, row, covered): for each document that has any, the [s, e] unit ranges of its non-first repeated spans.

    each: doc_id, row, s, e, h1, h2, a row for each span. The first occurrence of a span is the one of the smallest
    doc_id (null before all), then position. Counting is pre-aggregated by 128 bits of hash before the shuffle; the
    repeated spans are then a table, so the join back starts from plain shuffles on both sides, and the adaptive
    planner can split a hot span's rows, of which the other side has one.
    """
    order = _order(F.col("doc_id"), F.col("row"), F.col("s"))
    firsts = each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1").select("h1", "h2", "first")
    firsts = materialize(firsts, "repeated-spans")
    later = each.join(firsts, ["h1", "h2"]).where(order != F.col("first"))
    return later.groupBy("doc_id", "row").agg(F.collect_set(F.struct("s", "e")).alias("covered"))


def merged(covered: Column) -> Column:
    """Sorted, disjoint unit ranges [s, e] from overlapping ones; null and empty give none. Work grows with the units covered."""
    kind = "array<struct<s:int,e:int>>"
    units = F.sort_array(F.array_distinct(F.flatten(F.transform(F.coalesce(covered, F.array().cast(kind)), lambda x: F.sequence(x["s"], x["e"])))))

    def ranges(u: Column) -> Column:
        starts = F.filter(u, lambda x, i: (i == 0) | (x > F.get(u, i - 1) + 1))
        ends = F.filter(u, lambda x, i: (i == F.size(u) - 1) | (F.get(u, i + 1) > x + 1))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))

    # as a lambda's argument the units are made once
    return F.element_at(F.transform(F.array(units), ranges), 1)


def kept_units(units: Column, ranges: Column) -> Column:
    """The units outside the merged ranges, in order: one slice for each gap."""
    starts = F.concat(F.array(F.lit(0)), F.transform(ranges, lambda r: r["e"] + 1))
    ends = F.concat(F.transform(ranges, lambda r: r["s"]), F.array(F.size(units)))
    gaps = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    return F.flatten(F.transform(gaps, lambda g: F.slice(units, g["a"] + 1, g["b"] - g["a"])))


def range_units(ranges: Column) -> Column:
    """How many units the merged ranges hold."""
    return F.aggregate(ranges, F.lit(0), lambda acc, r: acc + r["e"] - r["s"] + 1)
