"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import settle

#: Rounds after which the input must be at fault: each one at least halves the
#: longest pointer chain.
MOST_ROUNDS = 100


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node of the component of each node that has an edge.

    edges: a, b (long), in any direction, repeats and loops allowed.  Returns
    node, component.  Alternates two steps until the edges stop changing: every
    node links its larger neighbours to its smallest one, then every node links
    all its smaller neighbours and itself to the smallest (Kiveris et al., 2014).
    Neighbour lists are never gathered: only minima are, which combine before the
    shuffle.  Nulls in a or b are no edge; an empty table gives no rows.
    """
    now = settle(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    for _ in range(MOST_ROUNDS):
        large = _star(now, larger=True)
        following = settle(_star(large, larger=False))
        # Both hold distinct (larger, smaller) pairs; equal sums mean equal sets.
        mark = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
        if now.agg(*mark).first() == following.agg(*mark).first():
            break
        now = following
    else:
        raise RuntimeError("components did not settle")
    return (
        now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")))
        .groupBy("node").agg(F.min("component").alias("component"))
    )


def _star(pairs: DataFrame, *, larger: bool) -> DataFrame:
    """pairs: a > b, distinct.  One step of the alternation, in the same form."""
    if larger:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        out = pairs.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()
