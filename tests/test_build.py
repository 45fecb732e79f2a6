"""Stages, tools and command line on a small dictionary."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.__main__ import main
from filigree.operators import embed, matching, similarity
from filigree.plans import build, tools
from filigree.plans.manifest import Manifest, StageError
from filigree.plans.preflight import preflight
from filigree.settings import Settings
from filigree.sources.tables import lines_of_words

FAKE = Settings(fake_embed=True, embed_dim=16, q_min_l15=0.0, meta_bary_cos_threshold=-1.0)


def record(word, gloss, *, ant=(), syn=(), n=1):
    return {
        "word": word, "pos": "adj", "lang_code": "en", "antonyms": [{"word": w} for w in ant], "synonyms": [{"word": w} for w in syn],
        "senses": [{"id": f"{word}-{i}", "glosses": [f"{gloss} {i}"]} for i in range(n)],
    }


RECORDS = [
    record("loud", "with much sound", ant=["quiet"], syn=["noisy", "deafening"], n=2),
    record("quiet", "with little sound", ant=["loud"], syn=["silent"]),
    record("noisy", "rather loud", ant=["hushed"], syn=["loud"]),
    record("hushed", "rather quiet", ant=["noisy"], syn=["quiet"]),
    record("silent", "without sound", syn=["quiet", "unknown"]),
    record("deafening", "very loud", syn=["loud"], n=2),
    record("plain", "neither"),
]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("graph")
    source = folder / "records.jsonl"
    source.write_text("".join(json.dumps(r) + "\n" for r in RECORDS) + "{broken\n")
    g = build.Graph(spark, f"{folder}/tables", FAKE, source=str(source))
    return g, Manifest(folder / "state"), build.build(g, Manifest(folder / "state"))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_all_stages(made):
    g, manifest, done = made
    assert list(done) == list(manifest.stages)
    assert done["nodes"] == 9 and g.read("word_nodes").count() == 7
    edges, nodes = g.read("edges"), g.read("nodes")
    label = {r["id"]: r["word"] for r in nodes.select("id", "word").collect()}
    kinds = [(label[a], label[b], k, q) for a, b, k, q in rows(g.read("word_edges").select("cm1_id", "cm2_id", "edge_type", "q").orderBy("cm1_id"))]
    # Turns go by file order; plain, silent and deafening find no free partner.
    assert kinds == [("loud", "quiet", "contradicts", 0.85), ("noisy", "hushed", "contradicts", 0.85)]
    again = rows(g.read("reentry_edges").select("cm1_id", "edge_type", "q", "weight", "confidence"))
    assert sorted(label[r[0]] for r in again) == ["deafening", "plain", "silent"]
    assert {r[1:] for r in again} == {("contradicts", 0.85, 0.85, 0.85)}
    assert nodes.where("vector IS NULL OR parent_id IS NULL").isEmpty()
    parents = nodes.select("parent_id").union(edges.where("parent_id IS NOT NULL").select("parent_id"))
    assert parents.join(edges.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").isEmpty()
    ids = nodes.select("id").union(edges.select("id"))
    assert ids.count() == ids.distinct().count()
    size = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    assert edges.where(F.abs(size - 1) > 1e-9).isEmpty()
    assert edges.where("strength < 0 OR strength > 1").isEmpty()


def test_triads_have_three_children(made):
    g, _, done = made
    top = g.read("triad_edges")
    assert done["triads"] == top.count() >= 1
    assert top.where("edge_type IS NOT NULL OR type_vector IS NOT NULL OR q IS NOT NULL").isEmpty()
    assert {r[0] for r in rows(g.read("triad_parents").groupBy("parent_id").count().select("count"))} == {3}
    assert g.read("triad_parents").count() == g.read("triad_parents").select("child_id").distinct().count()


def test_tools(made):
    g, _, _ = made
    found = tools.find_word(g, "loud").first()
    n = g.read("edges").where((F.col("cm1_id") == found["id"]) | (F.col("cm2_id") == found["id"])).count()
    assert (found["pos"], found["sense_count"], found["edge_count"], found["has_parent_edge"]) == ("adj", 2, n, True)
    assert tools.find_word(g, "none").isEmpty() and tools.word_edges(g, "none").isEmpty()
    assert [(r["sense_idx"], r["gloss"], r["paired"]) for r in tools.word_senses(g, "loud").collect()] == [(0, "with much sound 0", True), (1, "with much sound 1", True)]
    (edge,) = [r for r in tools.word_edges(g, "quiet", "adj").collect() if r["cm1"] == "loud (adj)"]
    assert (edge["cm2"], edge["edge_type"], edge["q"]) == ("quiet (adj)", "contradicts", 0.85)
    assert tools.word_edges(g, "quiet", "noun").isEmpty()
    main_edge = g.read("word_edges").where(F.col("cm1_id") == found["id"]).first()
    info = tools.edge_info(g, main_edge["id"]).first()
    assert info["cm_leaf_words"] == ["loud", "quiet"] and info["level"] == 14
    assert tools.edge_info(g, 12345).isEmpty()
    text = json.loads(tools.as_json(tools.edge_info(g, main_edge["id"])).first()[0])
    assert text["edge_type"] == "contradicts" and "parent_id" in text


def test_search_ranks_as_brute_force(made):
    g, _, _ = made
    asked = g.embedder(["without sound 0"])[0].astype(float)
    for kind, table in (("node", "nodes"), ("baryedge", "edges")):
        hits = tools.semantic_search(g, "without sound 0", kind, 4).collect()
        all_rows = g.read(table).select("id", "vector").collect()
        cos = {r["id"]: float(np.dot(r["vector"], asked) / np.linalg.norm(r["vector"]) / np.linalg.norm(asked)) for r in all_rows}
        assert [h["id"] for h in hits] == sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:4]
        assert hits[0]["score"] == pytest.approx((1 + max(cos.values())) / 2, abs=1e-4)
    only = tools.semantic_search(g, "sound", where=F.col("edge_type") == "contradicts").collect()
    assert only and {h["edge_type"] for h in only} == {"contradicts"}
    with pytest.raises(ValueError, match="no documents"):
        tools.semantic_search(g, "x", "page")


def test_stats_holdout_and_recall(made):
    g, _, _ = made
    stats = {tuple(r)[:4]: r["n"] for r in tools.graph_stats(g).collect()}
    assert stats[("node", 15, "sense", None)] == 9 and stats[("node", 14, "word", None)] == 7
    assert stats[(None, None, None, None)] == g.read("nodes").count() + g.read("edges").count()
    pairs = tools.holdout(g, 1.0)
    assert sorted((r["word_a"], r["word_b"]) for r in pairs.collect()) == [("deafening", "loud"), ("hushed", "quiet"), ("loud", "noisy"), ("quiet", "silent")]
    assert dict((r["word_a"], r["gloss_a"]) for r in pairs.collect())["loud"] == "with much sound 0"
    assert tools.holdout(g, 0.01).count() == 1
    got = tools.recall(g, pairs, 50).first()
    assert (got["n_queries"], got["edge_recall"], got["flat_recall"], got["delta"]) == (4, 1.0, 1.0, 0.0)
    none = tools.recall(g, pairs.limit(0)).first()
    assert none["n_queries"] == 0 and none["edge_recall"] is None


def test_stage_guards_and_dry_run(made, tmp_path):
    g, manifest, done = made
    with pytest.raises(StageError, match="is done"):
        build.run_stage(g, manifest, "nodes")
    other = build.Graph(g.spark, str(tmp_path / "t"), FAKE, source=g.source, limit=3)
    fresh = Manifest(tmp_path / "s")
    with pytest.raises(StageError, match="needs"):
        build.run_stage(other, fresh, "nodes")
    assert build.run_stage(other, fresh, "parse", dry_run=True) == 3
    assert not (tmp_path / "t").exists() and not fresh.is_done("parse")
    assert build.run_stage(other, fresh, "parse") == 3
    before = rows(g.read("edges").select("id", "parent_id").orderBy("id"))
    assert build.run_stage(g, manifest, "index", force=True) == done["index"]
    assert rows(g.read("edges").select("id", "parent_id").orderBy("id")) == before


def test_parse_goes_on_and_edges_are_guarded(made, tmp_path):
    g, _, _ = made
    state = Manifest(tmp_path / "s")
    first = build.Graph(g.spark, str(tmp_path / "t"), FAKE, source=g.source, limit=3)
    assert build.run_stage(first, state, "parse") == 3
    later = build.Graph(g.spark, str(tmp_path / "t"), FAKE, source=g.source, resume=True)
    assert build.run_stage(later, state, "parse") == 7
    assert sorted(rows(later.read("words").select("word"))) == sorted(rows(g.read("words").select("word")))
    assert build.run_stage(later, state, "parse") == 7
    for stage in ("embed", "nodes", "sense_edges"):
        build.run_stage(first, state, stage)
    state.reset("sense_edges")
    with pytest.raises(StageError, match="already"):
        build.run_stage(first, state, "sense_edges")
    before = rows(later.read("sense_edges").select("id", "cm1_id", "cm2_id"))
    assert build.run_stage(later, state, "sense_edges") == len(before)
    assert sorted(rows(later.read("sense_edges").select("id", "cm1_id", "cm2_id"))) == sorted(before)
    assert build.run_stage(first, state, "sense_edges", force=True) == len(before)


def test_floor_above_the_threshold_pairs_senses_of_one_word(made, spark, tmp_path):
    g, _, _ = made
    strict = build.Graph(spark, g.root, Settings(fake_embed=True, embed_dim=16, q_min_l15=0.999, polysemy_q_floor=0.999))
    main = build.sense_edges(strict)["sense_edges"].where("confidence = 1.0")
    labels = g.read("sense_nodes").select("id", "word")
    pairs = main.join(labels.toDF("cm1_id", "a"), "cm1_id").join(labels.toDF("cm2_id", "b"), "cm2_id")
    assert sorted(rows(pairs.select("a", "b"))) == [("deafening", "deafening"), ("loud", "loud")]


def test_embedding_service(spark):
    class Service(BaseHTTPRequestHandler):
        fails = 1

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if Service.fails:
                Service.fails -= 1
                self.send_error(503)
                return
            body = json.dumps({"embeddings": [[3.0, 4.0] if t else [0.0, 0.0] for t in asked["input"]]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        got = embed.http_embedder(f"http://127.0.0.1:{server.server_port}/", "m")(["a", ""])
    finally:
        server.shutdown()
    assert np.allclose(got, [[0.6, 0.8], [0, 0]])


def test_command_line(made, capsys, monkeypatch):
    g, _, _ = made
    assert main([]) == 1 and main(["--help"]) == 0 and main(["nonsense"]) == 2
    capsys.readouterr()
    monkeypatch.setenv("FAKE_EMBED", "1")
    monkeypatch.setenv("EMBED_DIM", "16")
    assert main(["find_word", "quiet", "--root", g.root]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["word"] == "quiet"
    assert main(["nodes", "--root", f"{g.root}-none"]) == 1


def test_preflight_reports_every_check(made, spark, tmp_path):
    g, manifest, _ = made
    report = preflight(g, manifest)
    assert [name for name, _, _ in report] == ["session", "checkpoints", "folder", "records", "vectors", "state"]
    assert all(passed for _, passed, _ in report) and report[-1][2].startswith("parse, embed")
    bad = build.Graph(spark, str(tmp_path / "t"), Settings(embed_url="http://127.0.0.1:9/", embed_dim=4), embedder=lambda t: [[1.0]] * len(t), source=str(tmp_path / "none"))
    found = {name: passed for name, passed, _ in preflight(bad, Manifest(tmp_path / "s"))}
    assert found == {"session": True, "checkpoints": True, "folder": True, "records": False, "vectors": False, "state": True}


def test_lines_of_words_are_kept_as_they_are(made, spark):
    g, _, _ = made
    with open(g.source) as f:
        want = [line.rstrip("\n") for line in f if '"word": "loud", "pos"' in line or '"word": "silent", "pos"' in line]
    assert [r[0] for r in lines_of_words(spark, g.source, ["loud", "silent"]).collect()] == want
    assert len(want) == 2


def test_equal_senses_of_a_large_graph_match_each_other(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (20_100, 16))
    x[:1001] = x[0]
    near = range(2000, 2400, 2)
    x[2001:2401:2] = x[2000:2400:2] + rng.normal(0, 1e-4, (200, 16))
    senses = spark.createDataFrame([(i, f"w{i}", "noun", v) for i, v in enumerate(x.tolist())], "id long, word string, pos string, vector array<double>")
    senses.write.parquet(f"{tmp_path}/sense_nodes")
    none = spark.createDataFrame([], "word string, pos string, relations array<struct<kind:string,word:string>>")
    none.write.parquet(f"{tmp_path}/word_nodes")
    g = build.Graph(spark, str(tmp_path), Settings(fake_embed=True, embed_dim=16, q_min_l15=0.999))
    made = build.sense_edges(g)
    main = made["sense_edges"].where("confidence = 1.0 AND q > 0.999999").select("cm1_id", "cm2_id")
    assert sorted(rows(main)) == [(i, i + 1) for i in range(0, 1000, 2)] + [(i, i + 1) for i in near]
    up = made["sense_parents"]
    assert up.count() == up.select("child_id").distinct().count() == 20_100


@pytest.mark.parametrize("n", [1, 2, 5])
def test_equal_senses_match_as_greedy_matching(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    x = rng.normal(0, 1, (40, 4))
    x = np.concatenate([x] + [x[: 40 // (c + 1)] for c in range(1, n)])
    ids = rng.permutation(len(x)).tolist()
    x /= np.linalg.norm(x, axis=1)[:, None]
    senses = spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), "id long, vector array<double>")
    senses = senses.withColumns({"word": F.col("id").cast("string"), "pos": F.lit("noun")})
    want = matching.greedy_match(similarity.pairs_above(senses.select("id", "vector"), 0.3), 0.3)
    equal = build._equal_pairs(senses, 0.3)
    rest = senses.join(equal.select(F.explode(F.array("i", "j")).alias("id")), "id", "left_anti")
    g = build.Graph(spark, str(tmp_path), Settings(fake_embed=True, q_min_l15=0.3, polysemy_q_floor=0.0))
    got = rows(equal.select("i", "j")) + rows(matching.greedy_match(build._sense_pairs(g, rest), 0.3).select("i", "j"))
    assert sorted(got) == sorted(rows(want.select("i", "j")))


def test_stages_list_no_pairs_of_senses(spark, small, monkeypatch):
    """Where every pair of senses reaches the threshold, they are matched without a list of all pairs."""
    from filigree import build_queries
    from filigree.operators import matching, similarity

    monkeypatch.setattr(similarity, "pairs_above", None)
    monkeypatch.setattr(matching, "TAIL_VECTORS", 4)
    g = build_queries._run(build_queries.supplier_graph(spark, small), "parse", "embed", "nodes", "sense_edges")
    n = g.read("sense_nodes").count()
    ends = g.read("sense_edges").select("cm1_id", "cm2_id").collect()
    main = g.read("sense_parents").groupBy("child_id").count()
    assert n == 19 and len(ends) == 10 and main.count() == n and main.where("count > 1").isEmpty()
