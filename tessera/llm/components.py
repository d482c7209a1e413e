"""Connected components of a graph of any shape, by contraction; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """node, comp for every end of an edge of edges (x, y, longs): comp is the same for connected nodes, and one of them.

    Each round every node moves to the least of its neighbours' and its own number, twice over, and edges are drawn anew
    between where their ends went; nodes without an edge to another place are done. Numbers should be hashes: then the
    nodes left shrink by a share each round, also along paths. A hub's edges are only ever reduced by a minimum or joined
    with a written table, which Spark may split. Each round's tables are written to the shared folder.
    """
    here = written(edges.where("x <> y").select("x", "y").distinct(), "edges")
    labels: DataFrame | None = None
    while not here.isEmpty():
        both = here.union(here.select(F.col("y").alias("x"), F.col("x").alias("y")))
        to = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("p")), "parents")
        up = to.select(F.col("node").alias("p"), F.col("p").alias("q"))
        to = written(to.join(up, "p", "left").select("node", F.coalesce("q", "p").alias("to")), "parents")
        if labels is None:
            labels = to.select("node", F.col("to").alias("comp"))
        else:
            step = to.select(F.col("node").alias("comp"), F.col("to"))
            labels = written(labels.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        moved = here.join(to.select(F.col("node").alias("x"), F.col("to").alias("a")), "x").join(to.select(F.col("node").alias("y"), F.col("to").alias("b")), "y")
        here = written(moved.where("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct(), "edges")
    return edges.select(F.col("x").alias("node"), F.col("y").alias("comp")).limit(0) if labels is None else labels
