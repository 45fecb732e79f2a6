"""Registered queries of record parsing, build stages and tools, with their SQL.

Records are made from the standard tables: documents stand for dictionary entries,
suppliers for a small dictionary that all stages are run on, and a graph of customers,
embeddings and the edges between them answers the tools.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions.text import is_object_id
from filigree.operators import parse
from filigree.plans import build, tools
from filigree.queries import query
from filigree.settings import Settings
from filigree.sources.tables import read_jsonl, scratch, table, write_table

# ---------------------------------------------------------------- records of documents

_SENSES = """transform(sequence(0, CAST(doc_id % 4 AS INT)), j -> struct(
  CASE WHEN (doc_id + j) % 2 = 0 THEN concat('id', doc_id, '_', j) ELSE '' END AS id,
  CASE WHEN (doc_id + j) % 3 = 0 THEN CAST(array() AS ARRAY<STRING>) WHEN j = 3 THEN array('') ELSE array(concat('gloss ', j, ' of ', lang), 'more') END AS glosses,
  transform(array('e0', '', 'e1', 'e2'), t -> struct(CASE WHEN t = '' THEN '' ELSE concat(t, '_', j) END AS text)) AS examples,
  CASE WHEN j % 2 = 0 THEN array('tag') END AS tags, CASE WHEN j % 2 = 1 THEN array('topic', lang) END AS topics,
  array(struct(concat('hyper', j) AS word)) AS hypernyms))"""
_RECORD = {
    "word": "CASE WHEN doc_id % 17 = 5 THEN '' ELSE concat(source, '_', doc_id % 97) END",
    "pos": "CASE WHEN doc_id % 19 = 7 THEN '' ELSE lang END",
    "lang_code": "CASE doc_id % 5 WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'fr' ELSE 'en' END",
    "etymology_text": "CASE WHEN doc_id % 3 <> 0 THEN concat('from ', lang) END",
    "sounds": "CASE doc_id % 4 WHEN 0 THEN array(named_struct('ipa', '/u/', 'tags', array('US')), named_struct('ipa', '/p/', 'tags', CAST(array() AS ARRAY<STRING>)))"
    " WHEN 1 THEN array(named_struct('ipa', '', 'tags', array('x')), named_struct('ipa', '/t/', 'tags', array('UK'))) END",
    "forms": "array(named_struct('form', concat('f', doc_id)), named_struct('form', ''))",
    "senses": _SENSES,
    "antonyms": "CASE WHEN doc_id % 2 = 0 THEN array(named_struct('word', 'anti', '_dis1', '0 3'), named_struct('word', '', '_dis1', '1')) END",
    "derived": "CASE WHEN doc_id % 3 = 0 THEN array(named_struct('word', 'der', '_dis1', ' 1 x ')) END",
    "synonyms": "array(named_struct('word', concat('syn', doc_id % 7)))",
}


def records(spark: SparkSession, d: str) -> DataFrame:
    """Parsed lines of a JSON file made from documents, with broken and blank lines in it."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("s")).alias("source"), F.coalesce("lang", F.lit("l")).alias("lang"))
    lines = docs.select(F.to_json(F.struct(*[F.expr(v).alias(k) for k, v in _RECORD.items()])).alias("value"))
    bad = docs.select(F.when(F.col("doc_id") % 10 == 0, "{broken").when(F.col("doc_id") % 10 == 1, "").otherwise("[]").alias("value"))
    path = f"{scratch(spark)}/records-{uuid.uuid4().hex}"
    lines.unionByName(bad).write.text(path)
    return read_jsonl(spark, path, parse.RECORD)


_ENTRY_SQL = """d AS (SELECT doc_id, coalesce(source, 's') || '_' || (doc_id % 97) AS word, coalesce(lang, 'l') AS lang,
  list_filter(range(0, doc_id % 4 + 1), lambda j: (doc_id + j) % 3 <> 0 AND j <> 3) AS kept FROM documents),
w AS (SELECT * FROM d WHERE doc_id % 17 <> 5 AND doc_id % 19 <> 7 AND lang <> '' AND doc_id % 5 <> 3 AND len(kept) > 0)"""


def _joined(kind: str, words: str, dis: str) -> str:
    return f"'{kind}:' || {words} || ':{dis}'"


@query(f"""WITH {_ENTRY_SQL}
SELECT word, lang AS pos, 'en' AS lang_code, CASE doc_id % 4 WHEN 0 THEN '/p/' WHEN 1 THEN '/t/' END AS ipa, 'f' || doc_id AS forms,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'from ' || lang END AS etymology,
  array_to_string(list_transform(kept, lambda j: CASE WHEN (doc_id + j) % 2 = 0 THEN 'id' || doc_id || '_' || j ELSE word || '-' || lang || '-' || j END), '|') AS sense_ids,
  concat_ws('|', CASE WHEN doc_id % 2 = 0 THEN {_joined('antonyms', "'anti'", '0,3')} END, CASE WHEN doc_id % 3 = 0 THEN {_joined('derived', "'der'", '1,0')} END,
    {_joined('synonyms', "'syn' || (doc_id % 7)", '')}) AS relations, word || ' (' || lang || ')' AS label
FROM w""")
def parse_words(spark, d):
    """Words of JSON records: defaults, pronunciation, sense ids and relations in their order."""
    found = parse.words(records(spark, d))
    listed = F.transform("relations", lambda r: F.concat(r["kind"], F.lit(":"), r["word"], F.lit(":"), F.array_join(r["dis1"].cast("array<string>"), ",")))
    return found.select(
        "word", "pos", "lang_code", "ipa", F.array_join("forms", "|").alias("forms"), "etymology", F.array_join("sense_ids", "|").alias("sense_ids"),
        F.array_join(listed, "|").alias("relations"), parse.label_word().alias("label"),
    )


@query(f"""WITH {_ENTRY_SQL}, s AS (SELECT doc_id, word, lang, unnest(kept) AS j FROM w)
SELECT word, lang AS pos, CASE WHEN (doc_id + j) % 2 = 0 THEN 'id' || doc_id || '_' || j ELSE word || '-' || lang || '-' || j END AS sense_id, CAST(j AS INTEGER) AS sense_idx,
  'gloss ' || j || ' of ' || lang AS gloss, 'e0_' || j || '|e1_' || j || '|e2_' || j AS examples, CASE WHEN j % 2 = 0 THEN 'tag' ELSE '' END AS tags,
  CASE WHEN j % 2 = 1 THEN 'topic|' || lang ELSE '' END AS topics, 'hypernyms:hyper' || j AS relations,
  'gloss ' || j || ' of ' || lang || ' e0_' || j || ' e1_' || j AS embed_text, word || ' (' || lang || ') [' || j || ']' AS label
FROM s""")
def parse_senses(spark, d):
    """Senses of JSON records by their first gloss, with their place in the record."""
    found = parse.senses(records(spark, d))
    listed = F.transform("relations", lambda r: F.concat(r["kind"], F.lit(":"), r["word"]))
    return found.select(
        "word", "pos", "sense_id", "sense_idx", "gloss", F.array_join("examples", "|").alias("examples"), F.array_join("tags", "|").alias("tags"),
        F.array_join("topics", "|").alias("topics"), F.array_join(listed, "|").alias("relations"), "embed_text", parse.label_sense().alias("label"),
    )


@query("SELECT doc_id, 20 + doc_id % 8 = 24 AS valid FROM documents")
def object_ids(spark, d):
    """Which strings are 24 hexadecimal digits; made of MD5 prefixes of several lengths."""
    given = F.expr("left(md5(cast(doc_id AS string)), cast(20 + doc_id % 8 AS int))")
    return table(spark, d, "documents").select("doc_id", is_object_id(given).alias("valid"))


# ---------------------------------------------------------------- stages on suppliers

#: Thresholds that every pair reaches, so that counts follow from the stages' rules alone.
ALL_PAIRS = Settings(fake_embed=True, embed_dim=8, q_min_l15=-1.0, polysemy_q_floor=-1.0, meta_bary_cos_threshold=-1.0)

_WORDS_SQL = """n AS (SELECT 1 + max(s_suppkey) AS n FROM supplier), w AS (SELECT s_suppkey AS i FROM supplier),
rel AS (SELECT w.i, 'antonyms' AS kind, 0 AS ord, (w.i * 7 + 1) % n.n AS j FROM w, n WHERE w.i % 3 = 0
  UNION ALL SELECT w.i, 'hyponyms', 1, (w.i * 5 + 2) % n.n FROM w, n WHERE w.i % 4 = 1
  UNION ALL SELECT w.i, 'synonyms', 2, (w.i * 3 + 5) % n.n FROM w, n WHERE w.i % 2 = 0),
t AS (SELECT i, j, ord, CASE kind WHEN 'antonyms' THEN 1 WHEN 'hyponyms' THEN 3 ELSE 6 END AS tier FROM rel WHERE i <> j)"""

# Turns one by one: an edge is taken if both of its ends are free.
_TIERS_SQL = f"""{_WORDS_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY tier, i, ord) AS n FROM t),
g(n, taken, got) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), false
  UNION ALL
  SELECT o.n, CASE WHEN list_contains(taken, o.i) OR list_contains(taken, o.j) THEN taken ELSE list_append(list_append(taken, o.i), o.j) END,
         NOT (list_contains(taken, o.i) OR list_contains(taken, o.j))
  FROM g JOIN o ON o.n = g.n + 1),
m AS (SELECT o.* FROM o JOIN g USING (n) WHERE g.got)"""


def supplier_graph(spark: SparkSession, d: str) -> build.Graph:
    """A graph whose words are the suppliers by key, with one to three senses each."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"))
    n = 1 + (rows.agg(F.max("i")).first()[0] or 0)
    none = F.lit(None).cast("array<struct<word:string>>")

    def relation(when, target):
        return F.when(F.expr(when), F.array(F.struct(F.concat(F.lit("w"), F.expr(target).cast("string")).alias("word")))).otherwise(none)

    sense = "transform(sequence(0, CAST(i % 3 AS INT)), j -> named_struct('id', concat('s', i, '_', j), 'glosses', array(concat('sense ', j, ' of ', i))))"
    lines = rows.select(F.to_json(F.struct(
        F.concat(F.lit("w"), F.col("i").cast("string")).alias("word"), F.lit("noun").alias("pos"), F.lit("en").alias("lang_code"), F.expr(sense).alias("senses"),
        relation("i % 3 = 0", f"(i * 7 + 1) % {n}").alias("antonyms"), relation("i % 4 = 1", f"(i * 5 + 2) % {n}").alias("hyponyms"),
        relation("i % 2 = 0", f"(i * 3 + 5) % {n}").alias("synonyms"),
    )).alias("value"), "i")
    root = f"{scratch(spark)}/graph-{uuid.uuid4().hex}"
    # One file, so that file order is the order of the words' numbers.
    lines.coalesce(1).sortWithinPartitions("i").select("value").write.text(f"{root}/records")
    return build.Graph(spark, f"{root}/tables", ALL_PAIRS, source=f"{root}/records")


def _run(g: build.Graph, *stages: str) -> build.Graph:
    for stage in stages:
        for name, df in build.WORK[stage](g).items():
            write_table(df, f"{g.root}/{name}")
    return g


def _number(label: str):
    return F.regexp_extract(label, r"^w([0-9]+)", 1).cast("long")


@query(f"""WITH RECURSIVE {_TIERS_SQL}
SELECT i, j, 14 AS level, CASE tier WHEN 1 THEN 'contradicts' WHEN 3 THEN 'is_instance_of' ELSE 'same_phenomenon' END AS edge_type,
  CASE tier WHEN 1 THEN 0.85::DOUBLE WHEN 3 THEN 0.65::DOUBLE ELSE 0.9::DOUBLE END AS q, 'ingested' AS source, 1.0::DOUBLE AS confidence, 2 AS n_parented FROM m""")
def stage_word_edges(spark, d):
    """Stages parse to word edges: matching by tiers over records, with the parents it sets."""
    g = _run(supplier_graph(spark, d), "parse", "embed", "nodes", "sense_edges", "word_vectors", "word_edges")
    label = g.read("word_nodes").select("id", _number("word").alias("i"))
    up = g.read("word_parents").groupBy("parent_id").agg(F.count("*").cast("int").alias("n_parented"))
    rows = g.read("word_edges").join(up, F.col("id") == F.col("parent_id")).drop("id")
    rows = rows.join(label.toDF("cm1_id", "i"), "cm1_id").join(label.toDF("cm2_id", "j"), "cm2_id")
    return rows.select("i", "j", "level", "edge_type", "q", "source", "confidence", "n_parented")


@query(f"""WITH {_WORDS_SQL}
SELECT 'w' || i || ' (noun)' AS label, 'word' AS kind, 14 AS level, CAST(i % 3 + 1 AS INTEGER) AS surface, CAST((SELECT count(*) FROM rel r WHERE r.i = w.i) AS INTEGER) AS n_relations FROM w
UNION ALL SELECT 'w' || i || ' (noun) [' || s || ']', 'sense', 15, 1, 0 FROM w, range(3) r(s) WHERE s <= i % 3""")
def stage_nodes(spark, d):
    """Stages parse to nodes."""
    g = _run(supplier_graph(spark, d), "parse", "embed", "nodes")
    words = g.read("word_nodes").select("label", F.lit("word").alias("kind"), "level", "surface", F.size("relations").alias("n_relations"))
    senses = g.read("sense_nodes").select("label", F.lit("sense").alias("kind"), "level", "surface", F.lit(0).alias("n_relations"))
    return words.unionByName(senses)


# Levels follow by counting: children of one level pair up, each pair takes a bridge.
_LEVELS_SQL = f"""{_TIERS_SQL}, s AS (SELECT CAST(sum(i % 3 + 1) AS BIGINT) AS n FROM w), c AS (SELECT s.n AS senses, (SELECT count(*) FROM w) AS words, (SELECT count(*) FROM m) AS pairs FROM s),
first AS (SELECT senses, words, pairs, senses // 2 + senses % 2 AS e15, CASE WHEN pairs > 0 THEN words - pairs ELSE 0 END AS e14 FROM c),
up(level, children, bridges, made) AS (
  SELECT 13, e15, e14, least(e15 // 2, e14) FROM first
  UNION ALL
  SELECT level - 1, bridges - made, made, least((bridges - made) // 2, made) FROM up WHERE made > 0 AND level > 1)"""


@query(f"""WITH RECURSIVE {_LEVELS_SQL}
SELECT 'sense_edges' AS kind, 15 AS level, CAST(e15 AS BIGINT) AS n FROM first
UNION ALL SELECT 'word_edges', 14, CAST(pairs AS BIGINT) FROM first WHERE pairs > 0
UNION ALL SELECT 'reentry_edges', 14, CAST(words - 2 * pairs AS BIGINT) FROM first WHERE pairs > 0 AND words > 2 * pairs
UNION ALL SELECT 'triad_edges', level, CAST(made AS BIGINT) FROM up WHERE made > 0
UNION ALL SELECT 'parents', 13 - 2, CAST(0 AS BIGINT) FROM first WHERE FALSE""")
def build_levels(spark, d):
    """All nine stages: edges of each kind and level."""
    g = _run(supplier_graph(spark, d), *build.WORK)
    out = None
    for kind in ("sense_edges", "word_edges", "reentry_edges", "triad_edges"):
        one = g.read(kind).groupBy(F.lit(kind).alias("kind"), "level").agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- tools on a written graph

_GRAPHS: dict[tuple, str] = {}
WORD_EDGE, SENSE, SENSE_EDGE, TOP = 2_000_000_000, 3_000_000_000, 4_000_000_000, 5_000_000_000


def tool_graph(spark: SparkSession, d: str) -> build.Graph:
    """Words are customers, senses are embeddings; written once for a session and folder."""
    key = (spark.sparkContext.applicationId, d)
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")
    asked = vectors.where("vec_id = 0").select("vector").first()
    settings = Settings(fake_embed=True)
    if key not in _GRAPHS:
        root = f"{scratch(spark)}/tools-{uuid.uuid4().hex}"
        c = table(spark, d, "customer")
        n, m = c.count(), vectors.count()
        pair = "array(named_struct('kind', 'synonyms', 'word', concat('BUILDING_', (c_custkey * 3) % 50)), named_struct('kind', 'antonyms', 'word', 'x'))"
        words = c.selectExpr(
            "c_custkey AS id", "concat(c_mktsegment, '_', c_custkey % 50) AS word", "concat('p', c_nationkey % 3) AS pos", "'word' AS node_type", "14 AS level",
            "concat(c_mktsegment, '_', c_custkey % 50, ' (p', c_nationkey % 3, ')') AS label", "concat('/', c_name, '/') AS ipa", "repeat(concat(c_name, ' '), 12) AS etymology",
            "transform(sequence(1, 8), x -> concat('f', x, '_', c_custkey)) AS forms", "transform(sequence(0, CAST(c_custkey % 4 AS INT)), x -> concat('s', x)) AS sense_ids",
            f"{pair} AS relations", f"IF(c_custkey % 3 = 0, {WORD_EDGE} + c_custkey, NULL) AS parent_id",
        )
        senses = vectors.selectExpr(
            f"{SENSE} + vec_id AS id", "concat('BUILDING_', label) AS word", "'p0' AS pos", "'sense' AS node_type", "15 AS level", "concat('sense ', vec_id) AS label",
            "CAST(vec_id AS INT) AS sense_idx", "repeat(concat('gloss of ', vec_id, '; '), 9) AS gloss", "array('t', CAST(label AS STRING)) AS tags", "CAST(array() AS ARRAY<STRING>) AS topics",
            f"IF(vec_id % 2 = 0, {SENSE_EDGE} + vec_id, NULL) AS parent_id", "vector",
        )
        write_table(words.unionByName(senses, allowMissingColumns=True), f"{root}/nodes")
        none = F.lit(None).cast("array<double>").alias("vector")
        low = c.selectExpr(
            f"{WORD_EDGE} + c_custkey AS id", "c_custkey AS cm1_id", f"(c_custkey * 13) % {n} AS cm2_id", "14 AS level", "IF(c_custkey % 2 = 0, 'contradicts', 'extends') AS edge_type",
            "0.5D AS q", "0.25D AS strength", "0.125D AS weight", f"IF(c_custkey < {m}, {TOP} + c_custkey, NULL) AS parent_id",
        ).withColumn("vector", none)
        mid = vectors.selectExpr(
            f"{SENSE_EDGE} + vec_id AS id", f"{SENSE} + vec_id AS cm1_id", f"{SENSE} + (vec_id + 1) % {m} AS cm2_id", "15 AS level", "CAST(NULL AS STRING) AS edge_type",
            "0.75D AS q", "0.75D AS strength", "0.75D AS weight", "CAST(NULL AS BIGINT) AS parent_id", "vector",
        )
        top = vectors.selectExpr(
            f"{TOP} + vec_id AS id", f"{WORD_EDGE} + vec_id % {n} AS cm1_id", f"{SENSE_EDGE} + vec_id AS cm2_id", "13 AS level", "CAST(NULL AS STRING) AS edge_type",
            "CAST(NULL AS DOUBLE) AS q", "0.5D AS strength", "0.5D AS weight", "CAST(NULL AS BIGINT) AS parent_id",
        ).withColumn("vector", none)
        edges = low.unionByName(mid).unionByName(top)
        write_table(edges, f"{root}/edges")
        ends = edges.select(F.col("id").alias("edge_id"), "level", F.explode(F.array_distinct(F.array("cm1_id", "cm2_id"))).alias("node_id"))
        write_table(ends, f"{root}/ends")
        _GRAPHS[key] = root
    # Every text is asked as the first vector of the table.
    return build.Graph(spark, _GRAPHS[key], settings, embedder=lambda texts: [list(asked[0])] * len(texts))


_GRAPH_SQL = f"""c AS (SELECT *, c_mktsegment || '_' || (c_custkey % 50) AS word, 'p' || (c_nationkey % 3) AS pos, count(*) OVER () AS n FROM customer),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, count(*) OVER () AS m FROM embeddings),
low AS (SELECT {WORD_EDGE} + c_custkey AS id, c_custkey AS cm1, (c_custkey * 13) % n AS cm2, CASE WHEN c_custkey % 2 = 0 THEN 'contradicts' ELSE 'extends' END AS edge_type FROM c),
mid AS (SELECT {SENSE_EDGE} + vec_id AS id, {SENSE} + vec_id AS cm1, {SENSE} + (vec_id + 1) % m AS cm2, v FROM v)"""


@query(f"""WITH {_GRAPH_SQL}, x AS (SELECT cm1 AS node, id FROM low UNION SELECT cm2, id FROM low)
SELECT c_custkey AS id, word, pos, '/' || c_name || '/' AS ipa, left(repeat(c_name || ' ', 12), 150) AS etymology, array_to_string(list_transform(range(1, 7), lambda i: 'f' || i || '_' || c_custkey), '|') AS forms,
  CAST(c_custkey % 4 + 1 AS INTEGER) AS sense_count, (SELECT count(*) FROM x WHERE node = c_custkey) AS edge_count, c_custkey % 3 = 0 AS has_parent_edge FROM c WHERE word = 'BUILDING_2'""")
def tool_find_word(spark, d):
    found = tools.find_word(tool_graph(spark, d), "BUILDING_2")
    return found.withColumn("forms", F.array_join("forms", "|"))


@query(f"""WITH {_GRAPH_SQL} SELECT {SENSE} + vec_id AS id, CAST(vec_id AS INTEGER) AS sense_idx, 'p0' AS pos, repeat('gloss of ' || vec_id || '; ', 9) AS gloss, 't|' || label AS tags, '' AS topics, vec_id % 2 = 0 AS paired
FROM v WHERE label = 3""")
def tool_word_senses(spark, d):
    found = tools.word_senses(tool_graph(spark, d), "BUILDING_3")
    return found.withColumn("tags", F.array_join("tags", "|")).withColumn("topics", F.array_join("topics", "|"))


@query(f"""WITH {_GRAPH_SQL} SELECT low.id AS edge_id, edge_type, a.word || ' (' || a.pos || ')' AS cm1, b.word || ' (' || b.pos || ')' AS cm2, 0.5::DOUBLE AS q, 0.125::DOUBLE AS accumulated_weight
FROM low JOIN c a ON a.c_custkey = low.cm1 JOIN c b ON b.c_custkey = low.cm2 WHERE (a.word = 'BUILDING_2' AND a.pos = 'p1') OR (b.word = 'BUILDING_2' AND b.pos = 'p1')""")
def tool_word_edges(spark, d):
    return tools.word_edges(tool_graph(spark, d), "BUILDING_2", "p1")


_LEAVES_SQL = f"""leaf AS (SELECT t.vec_id AS k, c.word AS word FROM v t JOIN low ON low.id = {WORD_EDGE} + t.vec_id % (SELECT count(*) FROM customer) JOIN c ON c.c_custkey IN (low.cm1, low.cm2)
  UNION SELECT t.vec_id, 'BUILDING_' || s.label FROM v t JOIN v s ON s.vec_id IN (t.vec_id, (t.vec_id + 1) % t.m)),
sets AS (SELECT k, array_to_string(list_sort(list(DISTINCT word)), '|') AS words FROM leaf GROUP BY k)"""


@query(f"WITH {_GRAPH_SQL}, {_LEAVES_SQL} SELECT {TOP} + k AS seed, words FROM sets")
def tool_leaf_words(spark, d):
    """Sorted distinct words below every edge of level 13."""
    g = tool_graph(spark, d)
    found = tools.leaf_words(g, g.read("edges").where("level = 13").select("id"))
    return found.select("seed", F.array_join("words", "|").alias("words"))


@query(f"""WITH {_GRAPH_SQL}, {_LEAVES_SQL} SELECT {TOP} + 5 AS id, 13 AS level, CAST(NULL AS VARCHAR) AS edge_type, CAST(NULL AS DOUBLE) AS q, 0.5::DOUBLE AS connection_strength, 0.5::DOUBLE AS accumulated_weight,
  words AS cm_leaf_words, {WORD_EDGE} + 5 % (SELECT count(*) FROM customer) AS cm1_id, {SENSE_EDGE} + 5 AS cm2_id, FALSE AS has_parent, CAST(NULL AS BIGINT) AS parent_id FROM sets WHERE k = 5""")
def tool_edge_info(spark, d):
    found = tools.edge_info(tool_graph(spark, d), TOP + 5)
    return found.withColumn("cm_leaf_words", F.array_join("cm_leaf_words", "|"))


_ASKED = "cos AS (SELECT b.*, list_cosine_similarity(a.v, b.v) AS cos FROM v a, v b WHERE a.vec_id = 0)"


@query(f"""WITH {_GRAPH_SQL}, {_ASKED} SELECT {SENSE} + vec_id AS id, round((1 + cos) / 2, 4) AS score, 15 AS level, 'sense' AS node_type, 'BUILDING_' || label AS word,
  left(repeat('gloss of ' || vec_id || '; ', 9), 100) AS gloss FROM cos ORDER BY cos DESC, vec_id LIMIT 10""")
def tool_search_nodes(spark, d):
    return tools.semantic_search(tool_graph(spark, d), "x", "node").drop("cos")


@query(f"""WITH {_GRAPH_SQL}, {_ASKED} SELECT {SENSE_EDGE} + vec_id AS id, round((1 + cos) / 2, 4) AS score, 15 AS level, CAST(NULL AS VARCHAR) AS edge_type,
  array_to_string(list_sort(list_distinct(['BUILDING_' || cos.label, 'BUILDING_' || (SELECT s.label FROM v s WHERE s.vec_id = (cos.vec_id + 1) % cos.m)])), '|') AS cm_words, 0.75::DOUBLE AS accumulated_weight
FROM cos ORDER BY cos DESC, vec_id LIMIT 10""")
def tool_search_edges(spark, d):
    found = tools.semantic_search(tool_graph(spark, d), "x").drop("cos")
    return found.withColumn("cm_words", F.array_join("cm_words", "|"))


@query(f"""WITH {_GRAPH_SQL}, {_ASKED}, hits AS (
  SELECT {SENSE} + vec_id AS id, 'node' AS doc_type, cos, 'BUILDING_' || label AS word, CASE WHEN vec_id % 2 = 0 THEN {SENSE_EDGE} + vec_id END AS edge_id, vec_id FROM cos
  UNION ALL SELECT {SENSE_EDGE} + vec_id, 'baryedge', cos, NULL, {SENSE_EDGE} + vec_id, vec_id FROM cos),
best AS (SELECT * FROM hits ORDER BY cos DESC, id LIMIT 20)
SELECT best.id AS id, doc_type, round((1 + cos) / 2, 4) AS score, word, edge_id, CASE WHEN edge_id IS NOT NULL THEN 'sense ' || vec_id END AS cm1,
  CASE WHEN edge_id IS NOT NULL THEN 'sense ' || ((vec_id + 1) % (SELECT max(m) FROM v)) END AS cm2 FROM best""")
def tool_search_with_parents(spark, d):
    """Nodes and edges by nearness, each with the edge it is or belongs to and both of its ends."""
    return tools.search_with_parents(tool_graph(spark, d), "x", 20).drop("cos")


@query(f"""WITH {_GRAPH_SQL}, x AS (SELECT 'node' AS doc_type, 14 AS level, 'word' AS node_type, CAST(NULL AS VARCHAR) AS edge_type FROM c
  UNION ALL SELECT 'node', 15, 'sense', NULL FROM v UNION ALL SELECT 'baryedge', 14, NULL, edge_type FROM low UNION ALL SELECT 'baryedge', 15, NULL, NULL FROM v UNION ALL SELECT 'baryedge', 13, NULL, NULL FROM v)
SELECT doc_type, level, node_type, edge_type, count(*) AS n FROM x GROUP BY 1, 2, 3, 4 UNION ALL SELECT NULL, NULL, NULL, NULL, count(*) FROM x""")
def tool_graph_stats(spark, d):
    return tools.graph_stats(tool_graph(spark, d))


@query(f"""WITH {_GRAPH_SQL}, pairs AS (SELECT DISTINCT least(word, 'BUILDING_' || ((c_custkey * 3) % 50)) AS a, greatest(word, 'BUILDING_' || ((c_custkey * 3) % 50)) AS b FROM c
  WHERE 'BUILDING_' || ((c_custkey * 3) % 50) IN (SELECT word FROM c) AND word <> 'BUILDING_' || ((c_custkey * 3) % 50)),
drawn AS (SELECT a, b, row_number() OVER (ORDER BY md5(a || '|' || b || '|42'), a, b) AS r, count(*) OVER () AS n FROM pairs),
g AS (SELECT 'BUILDING_' || label AS word, min(vec_id) AS first FROM v GROUP BY 1)
SELECT a AS word_a, coalesce(repeat('gloss of ' || first || '; ', 9), a) AS gloss_a, b AS word_b FROM drawn LEFT JOIN g ON g.word = a WHERE r <= greatest(1, round_even(n * 0.25::DOUBLE, 0))""")
def tool_holdout(spark, d):
    return tools.holdout(tool_graph(spark, d), 0.25)


@query(f"""WITH {_GRAPH_SQL} SELECT CAST(json_object('seed', {TOP} + vec_id, 'parent', NULL) AS VARCHAR) AS json FROM v""")
def tool_json(spark, d):
    """Answers as JSON objects, nulls kept."""
    rows = tool_graph(spark, d).read("edges").where("level = 13").select(F.col("id").alias("seed"), F.col("parent_id").alias("parent"))
    return tools.as_json(rows)
