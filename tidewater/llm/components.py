"""Connected components by contraction, with every round's edges cut off in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component, for each node of the edges (a, b: long).

    Each round points every node at its smallest neighbour, shortens the paths, and contracts the edges to the ends of
    the pointers; a node that has a neighbour never stays alone, so the nodes at least halve. Edges that are stars end
    in two rounds. Nothing but the number of edges left comes to the driver.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
        short = materialize(low, "pointers")
        to = materialize(_followed(short, short), "pointers")
        new_roots = to if roots is None else materialize(_followed(roots, to), "roots")
        a, b = to.select(F.col("node").alias("a"), F.col("root").alias("ra")), to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = edges.join(a, "a").join(b, "b").where("ra <> rb")
        new_edges = materialize(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        release(edges, short, roots, None if to is new_roots else to)
        edges, roots = new_edges, new_roots
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _followed(first: DataFrame, then: DataFrame) -> DataFrame:
    """node and where `then` leads from its root; roots that `then` does not know stay."""
    then = then.select(F.col("node").alias("root"), F.col("root").alias("end"))
    return first.join(then, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
