"""Edges, word vectors, triads and walks of the relationship graph.

Edges have id, cm1_id, cm2_id, level, vector, strength and weight; parents are a
table of their own (child_id, parent_id), so that nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.functions import vectors as V
from filigree.operators import matching, similarity
from filigree.sources.tables import settle


def sense_edges(matched: DataFrame, nodes: DataFrame, *, type_vector: Column | None = None) -> DataFrame:
    """Edges of matched pairs: i, j, q, vector.

    matched: i, j, q; nodes: id, vector.  Without a type vector, the centroid of both
    ends stands for it.
    """
    a = nodes.select(F.col("id").alias("i"), F.col("vector").alias("v1"))
    b = nodes.select(F.col("id").alias("j"), F.col("vector").alias("v2"))
    rows = matched.join(a, "i").join(b, "j")
    kind = V.centroid(F.col("v1"), F.col("v2")) if type_vector is None else type_vector
    return rows.select("i", "j", "q", V.edge_vector(F.col("v1"), F.col("v2"), kind, F.col("q")).alias("vector"))


def orphans(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Nodes that have a vector and no parent."""
    return nodes.where("vector IS NOT NULL").join(parents, nodes["id"] == parents["child_id"], "left_anti")


def reentry_edges(lonely: DataFrame, edges: DataFrame) -> DataFrame:
    """An edge from each orphan to its nearest edge, whose strength it inherits.

    lonely: id, vector; edges: id, vector, q, type_vector.  Without any edge there
    is none.  Returns cm1_id, cm2_id, q, vector.
    """
    near = similarity.nearest(lonely, edges.select("id", "vector"))
    a = lonely.select(F.col("id").alias("query_id"), F.col("vector").alias("v1"))
    b = edges.select("id", F.col("vector").alias("v2"), "q", "type_vector")
    rows = near.join(a, "query_id").join(b, "id")
    return rows.select(
        F.col("query_id").alias("cm1_id"), F.col("id").alias("cm2_id"), "q",
        V.edge_vector(F.col("v1"), F.col("v2"), F.col("type_vector"), F.col("q")).alias("vector"),
    )


def sum_vectors(parts: DataFrame, key: list[str]) -> DataFrame:
    """Unit vector of the sum of each key's vectors; rows without a vector are left out.

    Components are summed one by one with map-side combining, so no key's vectors
    are gathered.
    """
    flat = parts.where("vector IS NOT NULL").select(*key, F.posexplode("vector").alias("at", "x"))
    sums = flat.groupBy(*key, "at").agg(F.sum(F.col("x").cast("double")).alias("x"))
    made = sums.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("s"))
    return made.select(*key, V.normalize(F.transform("s", lambda p: p["x"])).alias("vector"))


def word_vectors(senses: DataFrame, edges: DataFrame) -> DataFrame:
    """Vectors of words from their senses' distinct parents and parentless senses.

    senses: word, pos, id, vector, parent_id; edges: id, vector.
    """
    up = (
        senses.where("parent_id IS NOT NULL").select("word", "pos", "parent_id").distinct()
        .join(edges.select(F.col("id").alias("parent_id"), "vector"), "parent_id").select("word", "pos", "vector")
    )
    own = senses.where("parent_id IS NULL").select("word", "pos", "vector")
    return sum_vectors(up.unionByName(own), ["word", "pos"])


def resolve_targets(relations: DataFrame, words: DataFrame) -> DataFrame:
    """Word ids of relation targets: the same class first, else the first entry.

    relations: i, pos, target and more; words: id, word, pos, seq, vector.  Words
    without a vector are no target.  Of entries with one word and class the last
    counts.  Unresolved relations and loops are left out.
    """
    known = words.where("vector IS NOT NULL")
    same = known.groupBy(F.col("word").alias("target"), "pos").agg(F.max_by("id", "seq").alias("same_id"))
    first = known.groupBy(F.col("word").alias("target")).agg(F.min_by("id", "seq").alias("first_id"))
    found = relations.join(same, ["target", "pos"], "left").join(first, "target", "left")
    return found.withColumn("j", F.coalesce("same_id", "first_id")).drop("same_id", "first_id").where("j IS NOT NULL AND j <> i")


def triads(children: DataFrame, bridges: DataFrame, threshold: float, level: int, alpha: float = 0.5, *, first: int = 50) -> DataFrame:
    """Triads of one level: matched children, each pair with a bridge of its own.

    children, bridges: id, vector, weight; none has a parent.  Pairs are matched by
    cosine, then served by falling cosine with the bridge nearest to their
    centroid.  A pair starts with its ``first`` nearest bridges and gets more when all
    of them went to pairs before it.  Returns cm1_id, cm2_id, bridge_id, level, strength, weight, vector.
    """
    pairs = matching.nearest_match(children.select("id", "vector"), threshold)
    kids = children.select("id", "vector", "weight")
    a = kids.toDF("i", "v1", "w1")
    b = kids.toDF("j", "v2", "w2")
    both = settle(pairs.join(a, "i").join(b, "j").withColumn("middle", V.centroid(F.col("v1"), F.col("v2"))))
    # A child is in one pair, so its id names the pair.
    middles = both.select(F.col("i").alias("pair"), F.struct((-F.col("q")).alias("far"), "i").alias("rank"), F.col("middle").alias("vector"))

    given = matching.nearest_assignment(middles, bridges.select("id", "vector"), first=first)
    c = bridges.select(F.col("id").alias("bridge"), F.col("vector").alias("v3"), F.col("weight").alias("w3"))
    rows = both.join(given.select(F.col("pair").alias("i"), "bridge"), "i").join(c, "bridge")
    strength = V.triad_strength(F.col("w1"), F.col("w2"), F.col("w3"))
    return rows.select(
        F.col("i").alias("cm1_id"), F.col("j").alias("cm2_id"), F.col("bridge").alias("bridge_id"), F.lit(level).alias("level"),
        strength.alias("strength"), (strength * V.level_factor(F.lit(level), alpha)).alias("weight"),
        V.triad_vector(F.col("v1"), F.col("v2"), F.col("v3"), F.col("w1"), F.col("w2"), F.col("w3")).alias("vector"),
    )


def leaves(links: DataFrame, seeds: DataFrame, max_depth: int = 15) -> DataFrame:
    """Nodes below each seed: seed, id, depth (fetch rounds, the seed's is 1).

    links: parent_id, child_id of edges; an id without links is a leaf.  A round
    visits only what is new to the seed.  Returns every visited id with its first
    depth, the seed included.
    """
    seen = settle(seeds.select(F.col("id").alias("seed"), F.col("id").alias("id"), F.lit(1).alias("depth")))
    frontier = seen
    for depth in range(2, max_depth + 1):
        down = frontier.join(links, frontier["id"] == links["parent_id"]).select("seed", F.col("child_id").alias("id")).distinct()
        frontier = settle(down.join(seen, ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = settle(seen.unionByName(frontier))
    return seen


def ancestors(parents: DataFrame, seeds: DataFrame, max_depth: int = 15) -> DataFrame:
    """seed, id, depth (0 for the seed) on the way to the root."""
    seen = now = settle(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")))
    for depth in range(1, max_depth + 1):
        now = settle(now.join(parents, now["id"] == parents["child_id"]).select("seed", F.col("parent_id").alias("id"), F.lit(depth).alias("depth")))
        if now.isEmpty():
            break
        seen = seen.unionByName(now)
    return seen


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id and edge columns for each edge at a node; a loop counts once."""
    ends = edges.withColumn("node_id", F.explode(F.array_distinct(F.array("cm1_id", "cm2_id"))))
    return ends.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")


def graph_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by keys, and the total in the row whose keys are null."""
    return rows.groupingSets([keys, []], *keys).agg(F.count("*").alias("n"))


def canonical_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs of different values."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def seeded_sample(df: DataFrame, key: list[str], fraction: float, seed: int = 42) -> DataFrame:
    """max(1, round half even(n fraction)) rows, drawn by the MD5 of key and seed."""
    n = df.count()
    take = max(1, round(n * fraction)) if n else 0
    return df.orderBy(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))), *key).limit(take)


def running_ratio(rows: DataFrame, order: str, value: Column) -> DataFrame:
    """Rows with the mean of ``value`` over all rows up to each one by ``order`` (distinct).

    Rows are cut into ranges of ``order``; a range's sum comes from its own rows and one
    total for each range before it, so no task sees all rows.
    """
    from pyspark.sql import Window as W

    ranged = settle(rows.withColumn("__v", value.cast("double")).repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    # One row for each partition.
    totals = ranged.groupBy("__part").agg(F.sum("__v").alias("__s"), F.count("__v").alias("__c"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("__part", F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__s"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__c"))
    own = W.partitionBy("__part").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = ranged.join(F.broadcast(totals), "__part")
    ratio = (F.col("__s") + F.sum("__v").over(own)) / (F.col("__c") + F.count("__v").over(own))
    return out.withColumn("running", ratio).drop("__part", "__v", "__s", "__c")


def recall(hits: DataFrame) -> DataFrame:
    """hits: query_id, hit (boolean).  The share of queries with a hit; null without any."""
    per = hits.groupBy("query_id").agg(F.max(F.col("hit").cast("int")).alias("hit"))
    return per.agg(F.count("*").alias("n_queries"), F.sum("hit").cast("long").alias("n_hits"), F.avg(F.col("hit").cast("double")).alias("recall"))
