"""Stages that build a graph from dictionary records, each one committed table set.

A stage reads only tables of stages before it and replaces its own, so running it
again gives the same tables.  Word ids are the number of the word's first line (not
negative, in file order, by which matching takes turns); ids of senses and edges are
63-bit hashes of their keys with the sign set, and are checked to be distinct.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filigree.functions import text as X
from filigree.functions import vectors as V
from filigree.operators import embed, graph, matching, parse, similarity
from filigree.plans.manifest import Manifest, StageError, State
from filigree.settings import Settings
from filigree.sources.tables import keep_last, read_jsonl, settle, write_table

# Sentences whose vectors stand for the edge types of words.
TYPE_SENTENCES = {
    "same_phenomenon": "these two words describe the same concept",
    "contradicts": "these two words have opposite meanings",
    "extends": "one word is derived from or extends the other",
    "applies_to": "these two words share a common origin or root",
    "is_instance_of": "this relationship is a specific instance of the broader relationship",
}

SENSE_LEVEL, WORD_LEVEL = 15, 14

EDGE = (
    "id long, cm1_id long, cm2_id long, level int, vector array<double>, strength double, weight double, "
    "edge_type string, type_vector array<double>, q double, source string, confidence double"
)
PARENT = "child_id long, parent_id long, level int"


def hashed(*key: Column) -> Column:
    """A negative id from a key."""
    return F.xxhash64(*key).bitwiseOR(F.lit(-(1 << 63)))


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns in order, of its types; missing ones are null."""
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


class Graph:
    """Tables under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings(), *, embedder: embed.Embedder | None = None, source: str | None = None, limit: int | None = None, resume: bool = False):
        self.spark, self.root, self.settings, self.source, self.limit = spark, root, settings, source, limit
        #: Whether stages go on from what their tables hold; the last line that parse took.
        self.resume, self.after = resume, -1
        self.embedder = embedder or (embed.fake_embedder(settings.embed_dim) if settings.fake_embed else embed.http_embedder(settings.embed_url, settings.embed_model))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def has(self, name: str) -> bool:
        """Whether a table was written whole."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def embed(self, df: DataFrame, column: str, out: str) -> DataFrame:
        return embed.embed_column(df, column, self.embedder, batch=self.settings.embed_batch_size, out=out)


Tables = dict[str, DataFrame]


def parsed(g: Graph) -> Tables:
    """Words and senses of the source's records, the first ``limit`` lines at most.

    When resumed, of the lines behind the last one taken, beside what the tables hold.
    """
    if g.source is None:
        raise StageError("parse needs a source")
    raw = read_jsonl(g.spark, g.source, parse.RECORD).where(F.col("line") > g.after)
    if g.limit is not None:
        raw = raw.orderBy("line").limit(g.limit)
    raw = settle(raw)
    last = raw.agg(F.max("line")).first()[0]
    made = {"words": parse.words(raw), "senses": parse.senses(raw)}
    if g.resume and g.has("words") and g.has("senses"):
        made = {name: settle(g.read(name).unionByName(df)) for name, df in made.items()}
    g.after = g.after if last is None else last
    return made


def embedded(g: Graph) -> Tables:
    """Senses with vectors; of repeated sense ids the last one stays."""
    rows = keep_last(g.read("senses"), ["sense_id"], [F.col("line"), F.col("sense_idx")])
    return {"sense_vectors": g.embed(rows, "embed_text", "vector")}


def nodes(g: Graph) -> Tables:
    """Sense and word nodes by key, the last entry's values and the first one's turn."""
    own = g.read("words")
    first = own.groupBy("word", "pos").agg(F.min("line").alias("id"))
    words = keep_last(own, ["word", "pos"], [F.col("line")]).drop("line").join(first, ["word", "pos"])
    kept = F.transform("relations", lambda r: F.struct(r["kind"].alias("kind"), r["word"].alias("word")))
    words = words.withColumns({"relations": kept, "level": F.lit(WORD_LEVEL), "label": parse.label_word(), "surface": F.greatest(F.lit(1), F.size("sense_ids")), "rotation": F.lit(0.0)})
    senses = g.read("sense_vectors").drop("relations", "embed_text").withColumns({
        "id": hashed(F.lit("sense"), F.col("sense_id")), "level": F.lit(SENSE_LEVEL), "label": parse.label_sense(), "surface": F.lit(1), "rotation": F.lit(0.0),
    })
    return {"sense_nodes": senses, "word_nodes": words}


def _edges(rows: DataFrame, level: int) -> DataFrame:
    """Stored form of rows with cm1_id, cm2_id, vector, q and more."""
    made = rows.withColumns({"id": hashed(F.lit("edge"), F.lit(level), F.col("cm1_id"), F.col("cm2_id")), "level": F.lit(level), "strength": F.col("q")})
    return shaped(made if "weight" in rows.columns else made.withColumn("weight", F.col("q")), EDGE)


def _parents(edges: DataFrame, *ends: str) -> DataFrame:
    return edges.select(F.explode(F.array(*ends)).alias("child_id"), F.col("id").alias("parent_id"), "level")


def _neighbourhoods(g: Graph) -> DataFrame:
    """word, pos, ants, syns of the word nodes."""

    def of(kind: str) -> Column:
        return F.transform(F.filter("relations", lambda r: r["kind"] == kind), lambda r: r["word"])

    return g.read("word_nodes").select("word", "pos", of("antonyms").alias("ants"), of("synonyms").alias("syns"))


def _equal_pairs(senses: DataFrame, threshold: float) -> DataFrame:
    """Matched pairs i, j, q of senses with equal vectors, by id two by two.

    Best-first matching takes these before any other pair and in this order, so a
    vector that many senses have needs no pair of each two of them.
    """
    turns = W.partitionBy("vector").orderBy("id")
    cos = V.dot(F.col("vector"), F.col("vector"))
    turn = senses.where("vector IS NOT NULL").select(F.col("id").alias("i"), F.lead("id").over(turns).alias("j"), F.row_number().over(turns).alias("turn"), cos.alias("q"))
    return turn.where((F.col("turn") % 2 == 1) & F.col("j").isNotNull() & (F.col("q") >= threshold) & (F.col("q") > 1 - 1e-9)).select("i", "j", "q")


def _matched_senses(g: Graph, senses: DataFrame) -> DataFrame:
    """Best-first matching i, j, q of senses: id, word, pos, vector.

    Pairs that reach the threshold come before all that the floor lets in.
    """
    s = g.settings
    found = matching.nearest_match(senses.select("id", "vector"), s.q_min_l15)
    if s.polysemy_q_floor >= s.q_min_l15:
        # The floor lets senses of one word match at any cosine.
        rest = senses.where("vector IS NOT NULL").join(found.select(F.explode(F.array("i", "j")).alias("id")), "id", "left_anti")
        a = rest.select(F.col("id").alias("i"), "word", "pos", F.col("vector").alias("v1"))
        b = rest.select(F.col("id").alias("j"), "word", "pos", F.col("vector").alias("v2"))
        alike = a.join(b, ["word", "pos"]).where("i < j").select("i", "j", V.dot(F.col("v1"), F.col("v2")).alias("q"))
        found = found.unionByName(matching.ordered_matching(alike, [-F.col("q")]))
    name = F.struct("word", "pos")
    a, b = senses.select(F.col("id").alias("i"), name.alias("wi")), senses.select(F.col("id").alias("j"), name.alias("wj"))
    return found.join(a, "i").join(b, "j").select("i", "j", V.floored(F.col("q"), F.col("wi") == F.col("wj"), s.polysemy_q_floor).alias("q"))


def sense_edges(g: Graph) -> Tables:
    """Edges of matched senses, then one from each lone sense to its nearest such edge.

    When resumed with edges there, matching is left out: senses without a parent join them.
    """
    s = g.settings
    senses = g.read("sense_nodes").select("id", "word", "pos", V.normalize(F.col("vector")).alias("vector"))
    if g.resume and g.has("sense_edges") and g.has("sense_parents"):
        main, up = settle(g.read("sense_edges")), settle(g.read("sense_parents"))
        extra = _sense_reentry(g, senses, main, up)
        return {"sense_edges": settle(main.unionByName(extra)), "sense_parents": settle(up.unionByName(_parents(extra, "cm1_id")))}
    equal = settle(_equal_pairs(senses, s.q_min_l15))
    rest = senses.join(equal.select(F.explode(F.array("i", "j")).alias("id")), "id", "left_anti")
    matched = settle(equal.unionByName(_matched_senses(g, rest)))
    side = _sides(g, senses)
    both = matched.join(side("i", 1), "i").join(side("j", 2), "j")
    both = both.withColumn("text", X.type_text(*[F.col(c) for c in ("w1", "a1", "s1", "w2", "a2", "s2")]))
    typed = g.embed(both.select("i", "j", "q", "v1", "v2", "text"), "text", "type_vector")
    main = typed.select(F.col("i").alias("cm1_id"), F.col("j").alias("cm2_id"), "q", "type_vector", _made(), F.lit("inferred").alias("source"), F.lit(1.0).alias("confidence"))
    main = settle(_edges(main, SENSE_LEVEL))
    up = _parents(main, "cm1_id", "cm2_id")
    extra = _sense_reentry(g, senses, main, up)
    return {"sense_edges": main.unionByName(extra), "sense_parents": up.unionByName(_parents(extra, "cm1_id"))}


def _sides(g: Graph, senses: DataFrame) -> Callable[[str, int], DataFrame]:
    """Senses with their words' neighbourhoods, named for either end of an edge."""
    known = senses.join(_neighbourhoods(g), ["word", "pos"], "left")
    none = F.array().cast("array<string>")

    def side(key: str, n: int) -> DataFrame:
        return known.select(F.col("id").alias(key), F.col("vector").alias(f"v{n}"), F.col("word").alias(f"w{n}"), F.coalesce("ants", none).alias(f"a{n}"), F.coalesce("syns", none).alias(f"s{n}"))

    return side


def _sense_reentry(g: Graph, senses: DataFrame, main: DataFrame, up: DataFrame) -> DataFrame:
    """An edge from each sense without a parent to its nearest edge."""
    none = F.array().cast("array<string>")
    lone = graph.orphans(senses.select("id", "vector"), up)
    near = similarity.nearest(lone, main.select("id", "vector"))
    ends = main.select("id", F.col("vector").alias("v2"), "q")
    rows = near.join(_sides(g, senses)("query_id", 1), "query_id").join(ends, "id")
    rows = rows.withColumn("text", X.type_text(F.col("w1"), F.col("a1"), F.col("s1"), F.col("w1"), none, none))
    typed = g.embed(rows.select("query_id", "id", "q", "v1", "v2", "text"), "text", "type_vector")
    extra = typed.select(F.col("query_id").alias("cm1_id"), F.col("id").alias("cm2_id"), "q", "type_vector", _made(), F.lit("inferred").alias("source"), F.col("q").alias("confidence"))
    return settle(_edges(extra, SENSE_LEVEL))


def _made() -> Column:
    """The vector of an edge from v1, v2, type_vector and q."""
    return V.edge_vector(F.col("v1"), F.col("v2"), F.col("type_vector"), F.col("q")).alias("vector")


def word_vectors(g: Graph) -> Tables:
    """Vectors of words; a word without any sense or edge has no row."""
    up = g.read("sense_parents").select(F.col("child_id").alias("id"), "parent_id")
    senses = g.read("sense_nodes").select("id", "word", "pos", "vector").join(up, "id", "left")
    made = graph.word_vectors(senses, g.read("sense_edges").select("id", "vector"))
    return {"word_vectors": made.join(g.read("word_nodes").select("id", "word", "pos"), ["word", "pos"]).select("id", "vector")}


def word_edges(g: Graph) -> Tables:
    """Edges of words matched by relation tiers."""
    words = g.read("word_nodes").join(g.read("word_vectors"), "id")
    listed = words.select(F.col("id").alias("i"), "pos", F.posexplode("relations").alias("ord", "r"))
    relations = listed.select("i", "pos", "ord", F.col("r.word").alias("target"), matching.tier_of(F.col("r.kind")).alias("tier")).where("tier IS NOT NULL")
    found = graph.resolve_targets(relations, words.select("id", "word", "pos", F.col("id").alias("seq"), "vector"))
    matched = matching.tiered_match(found, dict(g.settings.q_seeds))
    # One row for each edge type.
    kinds = g.embed(g.spark.createDataFrame(list(TYPE_SENTENCES.items()), "edge_type string, sentence string").coalesce(1), "sentence", "type_vector").drop("sentence")
    a, b = words.select(F.col("id").alias("i"), F.col("vector").alias("v1")), words.select(F.col("id").alias("j"), F.col("vector").alias("v2"))
    rows = matched.join(a, "i").join(b, "j").join(F.broadcast(kinds), "edge_type")
    made = settle(_edges(rows.select(
        F.col("i").alias("cm1_id"), F.col("j").alias("cm2_id"), "q", "edge_type", "type_vector",
        V.edge_vector(F.col("v1"), F.col("v2"), F.col("type_vector"), F.col("q")).alias("vector"), F.lit("ingested").alias("source"), F.lit(1.0).alias("confidence"),
    ), WORD_LEVEL))
    return {"word_edges": made, "word_parents": _parents(made, "cm1_id", "cm2_id")}


def reentry(g: Graph) -> Tables:
    """An edge from each unmatched word to its nearest word edge, whose kind it inherits."""
    main = g.read("word_edges")
    lone = graph.orphans(g.read("word_vectors"), g.read("word_parents"))
    near = graph.reentry_edges(lone, main.select("id", "vector", "q", "type_vector"))
    rows = near.join(main.select(F.col("id").alias("cm2_id"), "weight", "edge_type", "type_vector"), "cm2_id")
    made = settle(_edges(rows.withColumns({"source": F.lit("inferred"), "confidence": F.col("q")}), WORD_LEVEL))
    return {"reentry_edges": made, "reentry_parents": _parents(made, "cm1_id")}


def triads(g: Graph) -> Tables:
    """Triads from level 13 upwards: matched children of level n, bridges of level n - 1."""
    s = g.settings
    edges = reduce(DataFrame.unionByName, [g.read(t).select("id", "level", "vector", "weight") for t in ("sense_edges", "word_edges", "reentry_edges")])
    taken = g.empty(PARENT)
    made, ups = g.empty(EDGE), taken
    for child in range(SENSE_LEVEL, 2, -1):
        free = settle(edges.where(F.col("level").isin(child, child - 1)).join(taken, edges["id"] == taken["child_id"], "left_anti"))
        children, bridges = free.where(F.col("level") == child), free.where(F.col("level") == child - 1)
        if children.limit(2).count() < 2 or bridges.isEmpty():
            break
        rows = graph.triads(children, bridges, s.meta_bary_cos_threshold, child - 2, s.level_factor_alpha)
        rows = settle(rows.withColumn("id", hashed(F.lit("triad"), F.col("level"), F.col("cm1_id"), F.col("cm2_id"), F.col("bridge_id"))))
        if rows.isEmpty():
            break
        up = _parents(rows, "cm1_id", "cm2_id", "bridge_id")
        made, ups, taken = made.unionByName(shaped(rows, EDGE)), ups.unionByName(shaped(up, PARENT)), taken.unionByName(shaped(up, PARENT))
        edges = edges.unionByName(rows.select("id", "level", "vector", "weight"))
    return {"triad_edges": made, "triad_parents": ups}


def index(g: Graph) -> Tables:
    """Tables for queries: nodes by word, edges by id, edge ends by node, each with its parent."""
    kinds = ("sense", "word", "reentry", "triad")
    up = reduce(DataFrame.unionByName, [g.read(f"{k}_parents").select("child_id", "parent_id") for k in kinds])
    edges = reduce(DataFrame.unionByName, [g.read(f"{k}_edges") for k in kinds])
    words = g.read("word_nodes").join(g.read("word_vectors"), "id", "left").withColumn("node_type", F.lit("word"))
    senses = g.read("sense_nodes").withColumn("node_type", F.lit("sense"))
    both = senses.withColumn("vector", F.col("vector").cast("array<double>")).unionByName(words, allowMissingColumns=True)

    def with_parent(df: DataFrame) -> DataFrame:
        return df.join(up, df["id"] == up["child_id"], "left").drop("child_id")

    ends = edges.select(F.col("id").alias("edge_id"), "level", F.explode(F.array_distinct(F.array("cm1_id", "cm2_id"))).alias("node_id"))
    return {
        "nodes": with_parent(both.drop("line")).repartitionByRange("word", "id").sortWithinPartitions("word", "id"),
        "edges": with_parent(edges).repartitionByRange("id").sortWithinPartitions("id"),
        "ends": ends.repartitionByRange("node_id", "edge_id").sortWithinPartitions("node_id", "edge_id"),
    }


#: Work of each stage; the first table it names is the one whose rows are counted.
WORK: dict[str, Callable[[Graph], Tables]] = {
    "parse": parsed, "embed": embedded, "nodes": nodes, "sense_edges": sense_edges, "word_vectors": word_vectors,
    "word_edges": word_edges, "reentry": reentry, "triads": triads, "index": index,
}


#: Stages whose edges would be there twice if another run's were still in use.
GUARDED = {"sense_edges": "sense_edges", "word_edges": "word_edges", "reentry": "reentry_edges", "triads": "triad_edges"}


def run_stage(g: Graph, manifest: Manifest, stage: str, *, reset: bool = False, force: bool = False, dry_run: bool = False) -> int:
    """Run one stage under the manifest's guards; a dry run writes no table.

    Returns the rows of its first table.  Raises StageError if ids repeat, and if a stage
    that is not done has edges of an earlier run, unless it is reset, forced or resumed.
    """
    if stage == "parse" and g.resume and g.has("words"):
        g.after = int(manifest.load("parse").last_id or -1)

    def work() -> int:
        if stage in GUARDED and not (reset or force or dry_run or g.resume) and g.has(GUARDED[stage]):
            raise StageError(f"{stage}: {GUARDED[stage]} is there already; reset or force the stage")
        made = WORK[stage](g)
        n = 0
        for at, (name, df) in enumerate(made.items()):
            if not dry_run:
                write_table(df, f"{g.root}/{name}")
                df = g.read(name)
            if at == 0:
                n = df.count()
            if name in ("sense_nodes", "edges") and not df.groupBy("id").count().where("count > 1").isEmpty():
                raise StageError(f"{name}: ids repeat")
        if stage == "parse" and not dry_run:
            manifest.save(State("parse", last_id=str(g.after), processed=n))
        return n

    return manifest.run(stage, work, reset=reset, force=force, again=g.resume, dry_run=dry_run)


def build(g: Graph, manifest: Manifest) -> dict[str, int]:
    """All stages that are not done yet: rows by stage."""
    return {s: run_stage(g, manifest, s) for s in manifest.stages if not manifest.is_done(s)}
