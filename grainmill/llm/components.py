"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from grainmill.llm import words as W


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``links`` (columns ``a, b``); comp is the smallest node.

    In each round every node takes its smallest neighbour as parent, then its parent's parent,
    and the links are rewritten to parents. Links inside one parent vanish, so rounds grow with
    the logarithm of the longest chain. All steps are joins and grouped minima with partial
    results; each round is written to the shared folder.
    """
    links = W.bounded_rows(links.select("a", "b").where("a <> b").distinct(), "links")
    comp = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    comp = comp.withColumn("comp", F.col("node"))
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("_near"))
        parent = parent.select(F.col("a").alias("node"), F.least("a", "_near").alias("parent"))
        parent = W.bounded_rows(parent, "parents")
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        parent = W.bounded_rows(
            parent.join(up, "parent", "left").select(
                "node", F.coalesce("_up", "parent").alias("parent")
            ),
            "parents",
        )
        of = parent.withColumnRenamed("node", "comp")
        comp = W.bounded_rows(
            comp.join(of, "comp", "left").select("node", F.coalesce("parent", "comp").alias("comp")),
            "components",
        )
        of_a = parent.select(F.col("node").alias("a"), F.col("parent").alias("_a"))
        of_b = parent.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
        links = W.bounded_rows(
            links.join(of_a, "a").join(of_b, "b").where("_a <> _b")
            .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(),
            "links",
        )
    return comp
