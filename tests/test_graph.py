"""Operators of the graph engine against plain code and hand-derived values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.functions import text as X
from filigree.functions import vectors as V
from filigree.operators import embed, graph, matching, parse, similarity, vector_index
from filigree.plans.manifest import Manifest, StageError
from filigree.settings import Q_SEEDS, Settings
from filigree.sources.tables import keep_last, ping, read_jsonl, upsert


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_vector_formulas(spark):
    x, y, z = np.array([2.0, -1.0, 2.0]), np.array([0.0, 3.0, 1.0]), np.array([-1.0, 1.0, 4.0])
    unit = lambda v: v / np.linalg.norm(v)
    r = one(
        spark, n=V.normalize(vec(*x)), zero=V.normalize(vec(0, 0, 0)), c=V.cosine(vec(*x), vec(0, 0, 0)), c2=V.cosine(vec(*x), vec(*y)),
        part=V.edge_vector(vec(*x), vec(*y), vec(*z), F.lit(0.37)), mean=V.edge_vector(vec(*x), vec(*y), vec(*z), F.lit(1.0)), kind=V.edge_vector(vec(*x), vec(*y), vec(*z), F.lit(0.0)),
        s=V.triad_strength(F.lit(0.2), F.lit(0.9), F.lit(0.6)), s0=V.triad_strength(F.lit(0.0), F.lit(0.0), F.lit(0.0)),
        l7=V.level_factor(F.lit(7)), l2=V.level_factor(F.lit(2)), flat=V.level_factor(F.lit(5), 0.0), v32=V.norm(vec(2, 3, 6).cast("array<float>")),
    )
    assert r["n"] == pytest.approx(list(unit(x))) and r["zero"] == [0, 0, 0] and r["c"] == 0
    assert r["c2"] == pytest.approx(float(unit(x) @ unit(y)))
    assert r["part"] == pytest.approx(list(unit(0.37 * (x + y) + 0.63 * z))) or r["part"] == pytest.approx(list(unit(0.37 * unit(x + y) + 0.63 * unit(z))))
    assert r["mean"] == pytest.approx(list(unit(x + y))) and r["kind"] == pytest.approx(list(unit(z)))
    assert r["s"] == pytest.approx(0.36 / math.sqrt(0.2**4 + 0.9**4 + 0.6**4)) and r["s0"] == 0
    assert (r["l7"], r["l2"], r["flat"], r["v32"]) == pytest.approx((1 + 0.5 * 7 / 13, 1 + 0.5 * 12 / 13, 1, 7))


def test_text_functions(spark):
    none = F.array().cast("array<double>")
    w = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    r = one(
        spark, a=X.parse_dis1(F.lit("7 12")), b=X.parse_dis1(F.lit("")), c=X.parse_dis1(F.lit(None).cast("string")), d=X.parse_dis1(F.lit("  4 q  9 ")),
        s1=X.assign_sense(w(2, 1, 8, 8), none), s2=X.assign_sense(w(0, 0, 0), vec(0.1, 0.73, 0.72)), s3=X.assign_sense(w(), vec(0.3, 0.71)), s4=X.assign_sense(w(0), none),
        t=X.type_text(F.lit("tide"), F.array(F.lit("ebb")), F.array(F.lit("flow"), F.lit("surge")), F.lit("moon"), none.cast("array<string>"), none.cast("array<string>")),
        e=X.embed_text(F.lit("rise of the sea"), F.array(F.lit("at dawn"), F.lit("by night"), F.lit("unused"))),
        k=X.clipped(F.lit(""), 4), m=X.clipped(F.lit("harbour"), 4),
    )
    assert (r["a"], r["b"], r["c"], r["d"]) == ([7, 12], [], [], [4, 0, 9])
    assert (r["s1"], r["s2"], r["s3"], r["s4"]) == (2, 1, None, None)
    assert r["t"] == "tide (antonyms: ebb; synonyms: flow, surge); moon" and r["e"] == "rise of the sea at dawn by night"
    assert (r["k"], r["m"]) == (None, "harb")


RAW = [
    '{"word": "tidal", "pos": "adj", "lang_code": "en", "sounds": [{"ipa": "/1/", "tags": ["US"]}, {"ipa": "/2/"}], "senses": [{"glosses": ["of tides"], "examples": [{"text": "a"}, {"text": ""}, {"text": "b"}, {"text": "c"}]}, {"glosses": []}, {"id": "tidal-x", "glosses": ["second"], "tags": ["rare"]}], "synonyms": [{"word": "marine", "_dis1": "0 3"}, {"word": ""}], "antonyms": [{"word": "inland"}]}',
    '{"word": "mer", "pos": "noun", "lang_code": "fr", "senses": [{"glosses": ["g"]}]}',
    '{"word": "hollow", "pos": "noun", "senses": []}',
    '{"word": "", "pos": "noun", "senses": [{"glosses": ["g"]}]}',
    "{broken",
    "",
    '{"word": "inland", "pos": "adj", "lang_code": "", "sounds": [{"ipa": "/3/", "tags": ["UK"]}, {"audio": "f"}], "forms": [{"form": "inlander"}, {"form": ""}], "senses": [{"glosses": ["away from the sea"]}]}',
]


def test_records_become_words_and_senses(spark, tmp_path):
    path = tmp_path / "dump.jsonl"
    path.write_text("\n".join(RAW))
    raw = read_jsonl(spark, str(path), parse.RECORD)
    assert raw.count() == 5
    words = {r["word"]: r for r in parse.words(raw).collect()}
    assert set(words) == {"tidal", "inland"}
    tidal = words["tidal"]
    assert tidal["ipa"] == "/2/" and words["inland"]["ipa"] == "/3/" and words["inland"]["forms"] == ["inlander"]
    assert tidal["sense_ids"] == ["tidal-adj-0", "tidal-x"]
    assert [(r["kind"], r["word"], r["dis1"]) for r in tidal["relations"]] == [("antonyms", "inland", []), ("synonyms", "marine", [0, 3])]
    senses = parse.senses(raw).orderBy("word", "sense_idx").collect()
    assert [(s["word"], s["sense_id"], s["sense_idx"]) for s in senses] == [("inland", "inland-adj-0", 0), ("tidal", "tidal-adj-0", 0), ("tidal", "tidal-x", 2)]
    assert senses[1]["embed_text"] == "of tides a b" and senses[1]["examples"] == ["a", "b", "c"] and senses[2]["tags"] == ["rare"]


def sequential(edges):
    taken, out = set(), []
    for *_, i, j in sorted(edges):
        if i != j and i not in taken and j not in taken:
            taken |= {i, j}
            out.append((i, j))
    return sorted(out)


@pytest.mark.parametrize("tail", [0, 3, 10_000])
def test_rounds_equal_sequential_greedy(spark, tail):
    rng = random.Random(tail)
    edges = [(rng.randrange(4), *sorted((rng.randrange(14), rng.randrange(14)))) for _ in range(45)]
    frame = spark.createDataFrame(edges, "w int, i long, j long")
    found = matching.ordered_matching(frame, [F.col("w")], tail=tail).collect()
    assert sorted((r["i"], r["j"]) for r in found) == sequential(edges)


def test_matching_of_small_cases(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(11, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    pairs = similarity.pairs_above(frame, -1.0, block=4)
    assert pairs.count() == 55
    for least in (0.3, 0.9):
        found = matching.greedy_match(pairs, least).collect()
        want = sequential([(-float(x[i] @ x[j]), i, j) for i in range(11) for j in range(i + 1, 11) if x[i] @ x[j] >= least])
        assert sorted((r["i"], r["j"]) for r in found) == want
    assert matching.greedy_match(pairs, 1.5).count() == 0
    low = spark.createDataFrame([(3, 8, -0.2)], "i long, j long, cos double")
    assert [tuple(r) for r in matching.greedy_match(low, 0.1, same_word=F.lit(True), polysemy_floor=0.15).collect()] == [(3, 8, 0.15)]


def test_tiers_equal_turns_one_by_one(spark):
    """Words take turns in each tier; what an earlier tier took stays taken."""
    rng = random.Random(9)
    rows = [(i, rng.randrange(14), tier, 100 * tier + n) for i in range(14) for n, tier in enumerate(rng.choices(range(1, 7), k=4))]
    found = matching.tiered_match(spark.createDataFrame(rows, "i long, j long, tier int, ord int"), Q_SEEDS).collect()
    taken, want = set(), []
    for tier in range(1, 7):
        for i, j, t, _ in sorted(rows, key=lambda r: (r[0], r[3])):
            if t == tier and i != j and not taken & {i, j}:
                taken |= {i, j}
                want.append((i, j, tier))
    assert want and sorted((r["i"], r["j"], r["tier"]) for r in found) == sorted(want)
    kinds = {t: (kind, Q_SEEDS[seed]) for t, kind, _, seed in matching.TIERS}
    assert all((r["edge_type"], r["q"]) == kinds[r["tier"]] for r in found)


def test_assignment_equals_serial_dictatorship(spark):
    rng = random.Random(4)
    rows = [(p, p, b, rng.randrange(5) / 5) for p in range(9) for b in range(7)]
    found = matching.exclusive_assignment(spark.createDataFrame(rows, "pair long, rank long, bridge long, cos double")).collect()
    used, want = set(), {}
    for p in range(9):
        free = sorted((-c, b) for q, _, b, c in rows if q == p and b not in used)
        if free:
            want[p] = free[0][1]
            used.add(free[0][1])
    assert {r["pair"]: r["bridge"] for r in found} == want


def test_search_and_nearest_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, vector array<double>")
    found = {}
    for r in similarity.search(frame.where("id < 6"), frame, 4, block=7, skip_self=True).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["id"])
    for q in range(6):
        order = [int(i) for i in np.lexsort((np.arange(50), -(x @ x[q]))) if i != q][:4]
        assert found[q] == order
    pairs = {(r["i"], r["j"]) for r in similarity.pairs_above(frame, 0.5, block=9).collect()}
    assert pairs == {(i, j) for i in range(50) for j in range(i + 1, 50) if x[i] @ x[j] >= 0.5}


@pytest.mark.parametrize("first", [1, 2, 50])
def test_triads_take_bridges_once(spark, first):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(24, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist(), 0.5 + i / 100) for i, v in enumerate(x)], "id long, vector array<double>, weight double")
    found = graph.triads(frame.where("id < 18"), frame.where("id >= 18"), 0.0, 13, first=first).collect()
    pairs = sequential([(-float(x[i] @ x[j]), i, j) for i in range(18) for j in range(i + 1, 18) if x[i] @ x[j] >= 0])
    ranked = sorted(pairs, key=lambda p: -float(x[p[0]] @ x[p[1]]))
    used, want = set(), []
    for i, j in ranked:
        mid = (x[i] + x[j]) / np.linalg.norm(x[i] + x[j])
        free = [b for b in range(18, 24) if b not in used]
        if free:
            best = max(free, key=lambda b: float(x[b] @ mid))
            used.add(best)
            want.append((i, j, best))
    assert sorted((r["cm1_id"], r["cm2_id"], r["bridge_id"]) for r in found) == sorted(want)
    for r in found:
        assert np.linalg.norm(r["vector"]) == pytest.approx(1)
        assert r["weight"] == pytest.approx(r["strength"] * (1 + 0.5 / 13))


def test_walks_stop_and_share(spark):
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (9, 9)], "parent_id long, child_id long")
    seeds = spark.createDataFrame([(1,), (9,), (7,)], "id long")
    found = sorted(tuple(r) for r in graph.leaves(links, seeds).collect())
    assert found == [(1, 1, 1), (1, 2, 2), (1, 3, 2), (1, 4, 3), (1, 5, 4), (7, 7, 1), (9, 9, 1)]
    assert max(r["depth"] for r in graph.leaves(links, seeds, max_depth=3).collect()) == 3
    up = graph.ancestors(links.where("parent_id <> child_id AND parent_id <> 3"), spark.createDataFrame([(5,)], "id long"))
    assert sorted((r["id"], r["depth"]) for r in up.collect()) == [(1, 3), (2, 2), (4, 1), (5, 0)]


def test_word_vectors_count_a_parent_once(spark):
    senses = spark.createDataFrame([("a", "n", 1, [1.0, 0.0], 10), ("a", "n", 2, [1.0, 0.0], 10), ("a", "n", 3, [0.0, 1.0], None), ("b", "n", 4, None, None)], "word string, pos string, id long, vector array<double>, parent_id long")
    edges = spark.createDataFrame([(10, [1.0, 0.0])], "id long, vector array<double>")
    found = graph.word_vectors(senses, edges).collect()
    assert [(r["word"], r["vector"]) for r in found] == [("a", pytest.approx([math.sqrt(0.5)] * 2))]


def test_reentry_inherits(spark):
    lonely = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>")
    edges = spark.createDataFrame([(7, [0.8, 0.6], 0.5, [0.0, 1.0]), (8, [0.0, 1.0], 0.9, [0.0, 1.0])], "id long, vector array<double>, q double, type_vector array<double>")
    r = graph.reentry_edges(lonely, edges).first()
    assert (r["cm1_id"], r["cm2_id"], r["q"]) == (1, 7, 0.5)
    raw = np.array([0.9, 0.8])
    assert r["vector"] == pytest.approx(list(raw / np.linalg.norm(raw)))


def test_targets_upserts_samples_and_recall(spark):
    words = spark.createDataFrame([(1, "a", "n", 1, 1), (2, "a", "v", 2, 1), (3, "a", "v", 3, 1), (4, "b", "n", 4, None)], "id long, word string, pos string, seq long, vector int")
    rel = spark.createDataFrame([(9, "v", "a"), (8, "x", "a"), (7, "n", "b"), (1, "n", "a")], "i long, pos string, target string")
    assert sorted((r["i"], r["j"]) for r in graph.resolve_targets(rel, words).collect()) == [(8, 1), (9, 3)]
    assert sorted(tuple(r) for r in upsert(words.select("id", "word"), words.limit(1).selectExpr("1L AS id", "'z' AS word"), ["id"]).collect()) == [(1, "z"), (2, "a"), (3, "a"), (4, "b")]
    assert keep_last(words, ["word"], [F.col("seq")]).count() == 2
    assert graph.seeded_sample(words, ["id"], 0.1).count() == 1 and graph.seeded_sample(words, ["id"], 0.5).count() == 2
    assert tuple(graph.recall(spark.createDataFrame([], "query_id long, hit boolean")).first()) == (0, None, None)
    assert ping(spark)


def test_fake_embedder_is_deterministic(spark):
    frame = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y")], "id long, text string")
    found = {r["id"]: r["vector"] for r in embed.embed_column(frame, "text", embed.fake_embedder(16)).collect()}
    assert found[1] == found[2] != found[4] and found[3] is None
    assert np.linalg.norm(found[1]) == pytest.approx(1, abs=1e-5)
    assert embed.fake_embedder(4)([]).shape == (0, 4)


def test_settings_and_manifest(tmp_path):
    s = Settings().with_env({"EMBED_DIM": "64", "FAKE_EMBED": "Yes", "Q_SEED_SYNONYMS": "0.5", "OTHER": "x"})
    assert (s.embed_dim, s.fake_embed, s.q_seeds["synonyms"], s.q_seeds["extends"]) == (64, True, 0.5, 0.6)
    m = Manifest(tmp_path, ("a", "b", "c"))
    with pytest.raises(StageError):
        m.run("b", lambda: 1)
    assert Manifest(tmp_path / "forced", ("a", "b")).run("b", lambda: 1, force=True) == 1
    assert m.run("a", lambda: 3, dry_run=True) == 3 and not m.is_done("a")
    assert m.run("a", lambda: 3) == 3 and m.load("a").processed == 3
    with pytest.raises(StageError):
        m.run("a", lambda: 3)
    m.run("b", lambda: 1)
    m.run("a", lambda: 4, reset=True)
    assert not m.is_done("b") and m.is_done("a")
    with pytest.raises(StageError):
        m.load("z")


def test_settings_file(tmp_path):
    (tmp_path / "f").write_text('# note\n\nexport EMBED_DIM=32\nEMBED_MODEL="a b"\nQ_MIN_L15 = 0.5\n')
    s = Settings.load(tmp_path / "f", {"EMBED_DIM": "64"})
    assert (s.embed_dim, s.embed_model, s.q_min_l15) == (64, "a b", 0.5)
    assert Settings.load(tmp_path / "none", {}) == Settings()


@pytest.mark.parametrize("tail", [4, 50_000])
def test_assignment_where_all_want_the_same(spark, monkeypatch, tail):
    """All pairs rank the bridges alike: rounds of proposals alone would settle one at a time."""
    monkeypatch.setattr(matching, "TAIL_EDGES", tail)
    monkeypatch.setattr(matching, "PROPOSAL_ROUNDS", 1)
    rows = [(p, p, b, 1.0 - b / 100) for p in range(12) for b in range(15)]
    found = matching.exclusive_assignment(spark.createDataFrame(rows, "pair long, rank long, bridge long, cos double")).collect()
    assert sorted((r["pair"], r["bridge"]) for r in found) == [(p, p) for p in range(12)]


@pytest.mark.parametrize("block", [3, 16_384])
def test_index_finds_what_it_should(spark, block):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(1, 12)) + rng.normal(0, 0.3, size=(60, 12)) for _ in range(20)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)], "id long, vector array<double>")
    index = vector_index.build(frame, 24)
    asked = frame.where("id % 10 = 0")
    exact = similarity.search(asked, frame, 5, skip_self=True)
    near = vector_index.search(index, asked, 5, probes=4, skip_self=True, piece=block * 10)
    assert vector_index.recall(near, exact).first()["recall"] >= 0.9
    every = vector_index.search(index, asked, 5, probes=24, skip_self=True, piece=block * 10)
    assert sorted(map(tuple, every.select("query_id", "rank", "id").collect())) == sorted(map(tuple, exact.select("query_id", "rank", "id").collect()))
    none = frame.where("id = 5000")
    assert vector_index.search(vector_index.build(none), asked, 3).count() == 0 and vector_index.search(index, none, 3).count() == 0


def test_running_ratio_equals_plain_sums(spark):
    values = [(i, float(i % 3 == 0)) for i in range(50)]
    found = graph.running_ratio(spark.createDataFrame(values, "k long, v double").repartition(7), "k", F.col("v")).orderBy("k").collect()
    assert [r["running"] for r in found] == pytest.approx([sum(v for _, v in values[: i + 1]) / (i + 1) for i in range(50)])


def test_streamed_words_keep_the_last_version(spark, tmp_path):
    from filigree.streaming.ingest import current, stream_words

    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text("\n".join(RAW))
    stream_words(spark, folder, out, state).awaitTermination()
    (tmp_path / "in" / "2.jsonl").write_text('{"word": "inland", "pos": "adj", "senses": [{"glosses": ["new"]}, {"glosses": ["more"]}]}')
    stream_words(spark, folder, out, state).awaitTermination()
    found = {r["word"]: r["sense_ids"] for r in current(spark, out).collect()}
    assert found == {"tidal": ["tidal-adj-0", "tidal-x"], "inland": ["inland-adj-0", "inland-adj-1"]}
