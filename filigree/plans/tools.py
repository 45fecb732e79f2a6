"""Questions to a built graph; each answer is a frame, or JSON lines of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.functions import text as X
from filigree.functions import vectors as V
from filigree.operators import graph, similarity
from filigree.plans.build import Graph
from filigree.sources.tables import settle


def find_word(g: Graph, word: str) -> DataFrame:
    """Entries of a word with their number of edges, over all levels."""
    found = g.read("nodes").where((F.col("node_type") == "word") & (F.col("word") == word))
    n = found.select("id").join(g.read("ends"), F.col("id") == F.col("node_id")).groupBy("node_id").agg(F.count("*").alias("n"))
    rows = found.join(n, found["id"] == n["node_id"], "left")
    return rows.select(
        found["id"], "word", "pos", "ipa", X.clipped(F.col("etymology"), 150).alias("etymology"), F.slice("forms", 1, 6).alias("forms"),
        F.size("sense_ids").alias("sense_count"), F.coalesce("n", F.lit(0)).alias("edge_count"), F.col("parent_id").isNotNull().alias("has_parent_edge"),
    ).orderBy("id")


def word_senses(g: Graph, word: str) -> DataFrame:
    """Senses of a word by their place in the record."""
    found = g.read("nodes").where((F.col("node_type") == "sense") & (F.col("word") == word))
    return found.select("id", "sense_idx", "pos", "gloss", "tags", "topics", F.col("parent_id").isNotNull().alias("paired")).orderBy("sense_idx", "pos")


def word_edges(g: Graph, word: str, pos: str | None = None) -> DataFrame:
    """Edges between words at a word, with the labels of both ends."""
    all_nodes = g.read("nodes")
    own = all_nodes.where((F.col("node_type") == "word") & (F.col("word") == word))
    own = own.where(F.col("pos") == pos) if pos else own
    ends = g.read("ends").where("level = 14")
    at = own.select(F.col("id").alias("node_id")).join(ends, "node_id").select(F.col("edge_id").alias("id")).distinct()
    rows = g.read("edges").join(at, "id", "left_semi")
    for end in ("cm1", "cm2"):
        labels = all_nodes.select(F.col("id").alias(f"{end}_id"), F.col("label").alias(end))
        rows = rows.join(labels, f"{end}_id", "left").withColumn(end, F.coalesce(end, F.col(f"{end}_id").cast("string")))
    return rows.select(F.col("id").alias("edge_id"), "edge_type", "cm1", "cm2", "q", F.col("weight").alias("accumulated_weight")).orderBy("edge_id")


def leaf_words(g: Graph, seeds: DataFrame) -> DataFrame:
    """seed, words (sorted, distinct) of the nodes below edges.  seeds: id."""
    ends = g.read("edges").select(F.col("id").alias("parent_id"), F.explode(F.array("cm1_id", "cm2_id")).alias("child_id"))
    below = graph.leaves(ends, seeds, g.settings.max_depth)
    named = below.join(g.read("nodes").select("id", "word"), "id")
    return named.groupBy("seed").agg(F.sort_array(F.collect_set("word")).alias("words"))


def edge_info(g: Graph, edge_id: int) -> DataFrame:
    """One edge with the words below it; no row for an unknown id."""
    found = g.read("edges").where(F.col("id") == edge_id)
    words = leaf_words(g, found.select("id"))
    rows = found.join(words, found["id"] == words["seed"], "left")
    return rows.select(
        "id", "level", "edge_type", "q", F.col("strength").alias("connection_strength"), F.col("weight").alias("accumulated_weight"),
        _words().alias("cm_leaf_words"), "cm1_id", "cm2_id", F.col("parent_id").isNotNull().alias("has_parent"), "parent_id",
    )


def _words() -> Column:
    return F.coalesce("words", F.array().cast("array<string>"))


def semantic_search(g: Graph, query: str, doc_type: str = "baryedge", top_k: int = 10, *, where: Column | None = None) -> DataFrame:
    """Edges or nodes nearest to a text, by an exact scan; ties go to the smaller id.

    score is (1 + cosine) / 2.  ``where`` narrows the rows before the ranking.
    """
    if doc_type not in ("baryedge", "node"):
        raise ValueError(f"no documents of type {doc_type!r}")
    rows = g.read("edges" if doc_type == "baryedge" else "nodes").where("vector IS NOT NULL")
    rows = rows if where is None else rows.where(where)
    # The one row of the question is joined, so that the plan holds no literal vector.
    rows = rows.join(F.broadcast(_asked(g, query)))
    best = rows.withColumn("cos", V.cosine(F.col("vector"), F.col("asked"))).drop("asked").orderBy(F.desc("cos"), "id").limit(top_k)
    score = F.round((F.lit(1.0) + F.col("cos")) / 2, 4).alias("score")
    if doc_type == "node":
        return best.select("id", score, "level", "node_type", "word", F.coalesce(X.clipped(F.col("gloss"), 100), F.lit("")).alias("gloss"), "cos").orderBy(F.desc("cos"), "id")
    words = leaf_words(g, best.select("id"))
    hits = best.join(words, best["id"] == words["seed"], "left")
    return hits.select("id", score, "level", "edge_type", _words().alias("cm_words"), F.col("weight").alias("accumulated_weight"), "cos").orderBy(F.desc("cos"), "id")


def search_with_parents(g: Graph, query: str, top_k: int = 10) -> DataFrame:
    """Nodes and edges nearest to a text in one list, with the ends of the edge they belong to.

    An edge belongs to itself, a node to its parent; a node without one has null ends.
    Ties go to the smaller id.  Ends without a label show their id.
    """
    asked = settle(_asked(g, query))
    cos = V.cosine(F.col("vector"), F.col("asked"))
    nodes = g.read("nodes").where("vector IS NOT NULL").select("id", F.lit("node").alias("doc_type"), "word", F.col("parent_id").alias("edge_id"), "vector")
    edges = g.read("edges").where("vector IS NOT NULL").select("id", F.lit("baryedge").alias("doc_type"), F.lit(None).cast("string").alias("word"), F.col("id").alias("edge_id"), "vector")
    best = nodes.unionByName(edges).join(F.broadcast(asked)).withColumn("cos", cos).drop("vector", "asked").orderBy(F.desc("cos"), "id").limit(top_k)
    rows = settle(best).join(g.read("edges").select(F.col("id").alias("edge_id"), "cm1_id", "cm2_id"), "edge_id", "left")
    for end in ("cm1", "cm2"):
        labels = g.read("nodes").select(F.col("id").alias(f"{end}_id"), F.col("label").alias(end))
        rows = rows.join(labels, f"{end}_id", "left").withColumn(end, F.coalesce(end, F.col(f"{end}_id").cast("string")))
    score = F.round((F.lit(1.0) + F.col("cos")) / 2, 4).alias("score")
    return rows.select("id", "doc_type", score, "word", "edge_id", "cm1", "cm2", "cos").orderBy(F.desc("cos"), "id")


def _asked(g: Graph, query: str) -> DataFrame:
    """One row: the text's vector."""
    return g.spark.createDataFrame([([float(x) for x in g.embedder([query])[0]],)], "asked array<double>")


def graph_stats(g: Graph) -> DataFrame:
    """Counts by kind of document, and the total in the row without a kind."""
    nodes = g.read("nodes").select(F.lit("node").alias("doc_type"), "level", "node_type", F.lit(None).cast("string").alias("edge_type"))
    edges = g.read("edges").select(F.lit("baryedge").alias("doc_type"), "level", F.lit(None).cast("string").alias("node_type"), "edge_type")
    counts = graph.graph_stats(nodes.unionByName(edges), ["doc_type", "level", "node_type", "edge_type"])
    return counts.orderBy(F.asc_nulls_last("doc_type"), F.desc("level"), "node_type", "edge_type")


def holdout(g: Graph, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """A seeded sample of synonym pairs of known words: word_a, gloss_a, word_b."""
    nodes = g.read("nodes")
    words = nodes.where("node_type = 'word'")
    listed = words.select("word", F.explode("relations").alias("r")).where("r.kind = 'synonyms'").select("word", F.col("r.word").alias("other"))
    known = listed.join(words.select(F.col("word").alias("other")).distinct(), "other", "left_semi")
    drawn = graph.seeded_sample(graph.canonical_pairs(known, "word", "other"), ["a", "b"], fraction, seed)
    first = nodes.where("node_type = 'sense'").groupBy("word").agg(F.min_by("gloss", F.struct("pos", "sense_idx")).alias("gloss"))
    rows = drawn.join(first, drawn["a"] == first["word"], "left")
    return rows.select(F.col("a").alias("word_a"), F.coalesce("gloss", "a").alias("gloss_a"), F.col("b").alias("word_b"))


def recall(g: Graph, pairs: DataFrame, k: int = 20) -> DataFrame:
    """Share of pairs whose second word is among the k hits for the first one's gloss.

    One row: n_queries, edge_recall (edges, by the words below them), flat_recall
    (nodes), delta; the shares are null without pairs.
    """
    numbered = pairs.select(F.xxhash64("word_a", "word_b").alias("id"), "gloss_a", "word_b").dropDuplicates(["id"])
    asked = settle(g.embed(numbered, "gloss_a", "vector").withColumn("vector", V.normalize(F.col("vector"))))
    targets = asked.select(F.col("id").alias("query_id"), "word_b")
    unit = V.normalize(F.col("vector")).alias("vector")
    nodes = g.read("nodes").select("id", "word", unit)
    near = settle(similarity.search(asked.select("id", "vector"), g.read("edges").select("id", unit), k).select("query_id", "id"))
    words = leaf_words(g, near.select("id").distinct())
    by_edge = near.join(words, near["id"] == words["seed"]).join(targets, "query_id").where(F.array_contains("words", F.col("word_b"))).select("query_id").distinct()
    flat = similarity.search(asked.select("id", "vector"), nodes.select("id", "vector"), k).select("query_id", "id")
    flat = flat.join(nodes.select("id", "word"), "id").join(targets, "query_id").where("word = word_b").select("query_id").distinct()
    hits = targets.join(by_edge.withColumn("b", F.lit(1.0)), "query_id", "left").join(flat.withColumn("f", F.lit(1.0)), "query_id", "left").na.fill(0.0, ["b", "f"])
    shares = hits.agg(F.count("*").alias("n_queries"), F.avg("b").alias("edge_recall"), F.avg("f").alias("flat_recall"))
    return shares.withColumn("delta", F.col("edge_recall") - F.col("flat_recall"))


def as_json(df: DataFrame) -> DataFrame:
    """One column ``json`` of the rows' objects, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
