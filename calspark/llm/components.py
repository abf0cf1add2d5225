"""Connected components of an edge table by contraction.

Every round links each node to its smallest smaller neighbour, follows those links
up to four steps, and replaces both ends of every edge by where they lead. A path
shrinks at least fourfold a round, a star vanishes in one. Rounds are written to
the shared folder; only a count reaches the driver. The links of a hub
are reduced by a partial minimum before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calspark.llm.storage import materialize


def _through(df: DataFrame, column: str, up: DataFrame) -> DataFrame:
    """``df`` with ``column`` replaced by where ``up`` leads from it."""
    step = up.select(F.col("a").alias(column), F.col("b").alias("_to"))
    return df.join(step, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def _edges(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, label): label is the smallest node of the component; isolated nodes are absent.

    ``edges`` has columns a, b and, where that is known, at most ``rows`` rows. Self links
    and nulls are dropped, repeats ignored.
    """
    links = materialize(_edges(edges), "cc-edges", rows)
    labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    most = 2 * links.count()
    while n := links.count():  # from the files' footers
        # written before it is joined with itself, so that adaptive execution can split a hub's rows
        up = materialize(links.groupBy("a").agg(F.min("b").alias("b")), "cc-least", n)
        up = _through(up, "b", up)
        up = materialize(_through(up, "b", up), "cc-up", n)
        labels = materialize(_through(labels, "label", up), "cc-labels", most)
        links = materialize(_edges(_through(_through(links, "a", up), "b", up)), "cc-edges", n)
    return labels
