"""Line dedup: overlapping three-line windows that occurred before are removed. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import packed, unpacked
from tidewater.llm.spans import kept_units, later_occurrences, merged, range_units, row_hash

#: Lines of a window.
WINDOW = 3


def _lines(text: Column) -> Column:
    """Lines with their line feeds, so that what is kept can be joined again exactly."""
    return F.split(F.coalesce(text, F.lit("")), "(?<=\n)", -1)


def _filled(text: Column) -> Column:
    """i, x of each line that is not blank, without outer white space."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("i"), F.trim(F.translate(x, "\r\t", "  ")).alias("x")))
    return F.filter(trimmed, lambda line: line["x"] != "")


def _windows(filled: Column, window: int) -> Column:
    """s, e, h1, h2 of each run of `window` consecutive filled lines. filled: a plain column, as each lambda call evaluates it."""

    def at(j: Column) -> Column:
        run = F.concat_ws("\n", *[F.element_at(filled, j + k)["x"] for k in range(window)])
        return F.struct(
            F.element_at(filled, j)["i"].alias("s"), F.element_at(filled, j + (window - 1))["i"].alias("e"),
            F.xxhash64(run).alias("h1"), F.xxhash64(F.lit("second"), run).alias("h2"),
        )

    return F.when(F.size(filled) >= window, F.transform(F.sequence(F.lit(1), F.size(filled) - (window - 1)), at))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each document without the lines of its windows that occurred before, in a smaller doc_id or earlier in it.

    Replaces text; adds n_lines, n_removed and removed (the ranges [s, e] of removed lines, from 0), in place of
    columns of these names; n_chars, where docs has it, follows the text. Blank lines are no part of a window, but
    those inside a removed range go with it. Documents of under `window` filled lines stay as they are, as do null
    texts (null) and empty ones. Rows of equal doc_id and text are one document: none is a copy of the other. Of rows
    with a null doc_id, which come before all others, the row's hash decides which is first. No documents: no rows.
    """
    columns = docs.columns
    rows = packed(docs).withColumn("row", row_hash(F.col("doc.doc_id"), F.col("doc.text")))
    filled = rows.select(F.col("doc.doc_id").alias("doc_id"), "row", _filled(F.col("doc.text")).alias("filled"))
    found = filled.select("doc_id", "row", _windows(F.col("filled"), window).alias("spans"))
    # not explode(): the filter that the optimizer derives from it would evaluate the spans once more for each of their references
    each = found.select("doc_id", "row", F.explode_outer("spans").alias("x")).where("x is not null").select("doc_id", "row", "x.s", "x.e", "x.h1", "x.h2")
    later = later_occurrences(each).select(F.struct("doc_id", "row", "covered").alias("l"))
    joined = rows.join(later, (F.col("row") == F.col("l.row")) & F.col("doc.doc_id").eqNullSafe(F.col("l.doc_id")), "left")
    ranged = joined.select("doc", merged(F.col("l.covered")).alias("removed"), _lines(F.col("doc.text")).alias("lines"))
    text = F.when(F.size("removed") > 0, F.array_join(kept_units(F.col("lines"), F.col("removed")), "")).otherwise(F.col("doc.text"))
    ranged = ranged.withColumn("text", text)
    made = {"text": F.col("text"), "n_lines": F.size("lines"), "n_removed": range_units(F.col("removed")), "removed": F.col("removed")}
    if "n_chars" in columns:
        made["n_chars"] = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return unpacked(ranged, columns, **made)
