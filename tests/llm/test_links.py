"""Jaccard join, components and nearest neighbours against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from filigree.llm import ann, common, ngram_jaccard
from filigree.llm.components import connected_components


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(texts, percent=75):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    new = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \t\n", "one", "ONE", "one two three four", "One two\x0bthree four", "a b c", "ÄRGER a b c d", "ärger a b c d"]
    line = new(30)
    for _ in range(12):
        base = new(rng.choice([6, 12, 40, 90]))
        for _ in range(rng.randrange(1, 9)):
            copy = base[:]
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], ["x"], ["y", "z"]])
            texts.append(" ".join(copy))
    # A line that many texts share, beside much or little of their own.
    texts += [" ".join(line + new(rng.choice([1, 2, 3, 60]))) for _ in range(25)]
    # A chain: each text is a near copy of the one before.
    now = new(60)
    for i in range(10):
        texts.append(" ".join(now))
        now = now[3:] + [f"c{i}a", f"c{i}b", f"c{i}c"]
    return texts + texts[20:30] + ["z" * 100_000]


@pytest.mark.parametrize(("percent", "broadcast", "limit"), [(75, 500_000, 64), (60, 0, 1), (75, 0, 3)])
def test_components_equal_brute_force(spark, monkeypatch, percent, broadcast, limit):
    """With ids broadcast or joined, with few or all keys split, lists sifted in many steps."""
    monkeypatch.setattr(common, "SPLIT_ROWS", limit)
    monkeypatch.setattr(ngram_jaccard, "SIFT_ROWS", 20 * limit)
    texts = corpus()
    rows = [(i, t, "n", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cls string, n int").repartition(3)
    s = ngram_jaccard.Settings(percent=percent, sketch_bits=12, broadcast_rows=broadcast)
    found = {r["doc_id"]: r for r in ngram_jaccard.jaccard_components(docs, settings=s).collect()}
    sizes, parts = components(texts, percent)
    assert [found[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [found[i]["component_id"] for i in range(len(texts))] == parts


def test_rows_without_or_with_equal_ids(spark):
    text = "a b c d e f g h"
    rows = [(5, text), (5, text), (5, "other words that stand here alone now"), (3, text), (None, text), (None, "")]
    found = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in found if r["n_shingles"] == 4) == [(-1, 4, 3), (3, 4, 3), (5, 4, 3), (5, 4, 3)]
    assert [(r["doc_id"], r["component_id"]) for r in found if r["n_shingles"] == 3] == [(5, 5)]
    assert [(r["doc_id"], r["component_id"]) for r in found if r["n_shingles"] == 0] == [(None, None)]


def test_empty_table_has_no_components(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard.jaccard_components(none).count() == 0


def test_shingle_counts_of_odd_batches():
    texts = [None, "", "a", " a  b ", "a b c d e", "A b C d e f", "x" * 5000 + " " + "y" * 70, *["q" * n for n in range(60, 80)]]
    hashes, bounds = ngram_jaccard.shingle_hashes(pa.array(texts).slice(0), 5)
    assert np.diff(bounds).tolist() == [len(shingles(t)) for t in texts]
    part, at = ngram_jaccard.shingle_hashes(pa.array(texts).slice(4, 3), 5)
    assert part[at[0] : at[1]].tolist() == hashes[bounds[4] : bounds[5]].tolist()
    assert set(hashes[bounds[4] : bounds[5]]) < set(hashes[bounds[5] : bounds[6]])


def test_parity_bits_differ_at_most_where_sets_do():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, n, np.uint64) for n in (0, 1, 5, 64, 65, 100, 128, 129, 700)]
    sets += [np.concatenate([s[k:], rng.integers(0, 1 << 63, m, np.uint64)]) for s in sets for k, m in [(0, 1), (1, 1), (3, 40), (20, 2)]]
    bits = ngram_jaccard.parity_bits(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    for a, x in zip(sets, bits, strict=True):
        assert len(x) == (max(64, 1 << (len(a) - 1).bit_length()) // 8 if len(a) else 0)
        for b, y in zip(sets, bits, strict=True):
            if len(a) and len(b):
                assert ngram_jaccard.differing(x, y) <= len(np.setxor1d(a, b))
                assert x is not y or ngram_jaccard.differing(x, y) == 0


@pytest.mark.parametrize("limit", [64, 1])
def test_whole_sets_are_made_of_promising_pairs_only(spark, monkeypatch, limit):
    """Texts that share much less than is needed are not compared set by set; every link still is."""
    monkeypatch.setattr(common, "SPLIT_ROWS", limit)
    rng = random.Random(6)
    new = lambda n: [f"w{rng.randrange(10_000)}" for _ in range(n)]
    line = new(30)
    texts = [" ".join(line + new(rng.choice([90, 200]))) for _ in range(20)]
    texts += [t + " x y" for t in texts[:10]] + ["a b c d e f g h i", "b c d e f g h i j", "one"]
    hashes, at = ngram_jaccard.shingle_hashes(pa.array(texts), 5)
    rows = [(i, int(n), b) for i, (n, b) in enumerate(zip(np.diff(at), ngram_jaccard.parity_bits(hashes, at), strict=True))]
    classes = spark.createDataFrame(rows, "cls long, n int, bits binary")
    sets = [shingles(t) for t in texts]
    every = [(i, j) for j in range(len(texts)) for i in range(j) if 100 * min(len(sets[i]), len(sets[j])) >= 75 * max(len(sets[i]), len(sets[j]))]
    kept = {tuple(r) for r in ngram_jaccard._promising(spark.createDataFrame(every, "a long, b long"), classes, ngram_jaccard.Settings()).collect()}
    linked = {(i, j) for i, j in every if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert len(linked) >= 10 and linked <= kept
    assert len(every) > 100 and len(kept - linked) <= 5


def test_scratch_files_go_when_they_are_done(spark, monkeypatch):
    """Neither lists, entries and pairs nor the shuffles that made them stay for the rest of the job."""
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    spark._jvm.System.gc()
    before = files()
    kept = common.settle(common.brief(spark.range(100).selectExpr("id % 7 AS k").groupBy("k").count()))
    assert kept.count() == 7
    made, settle = [], ngram_jaccard.settle

    def noted(df):
        made.append((settle(df), files()))
        return made[-1][0]

    monkeypatch.setattr(ngram_jaccard, "settle", noted)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = ngram_jaccard.jaccard_components(docs, settings=ngram_jaccard.Settings(sketch_bits=12))
    path = lambda df: spark._jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    left = [df.columns for df, _ in made if (p := path(df)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]
    assert ["token", "grp", "n", "pos"] in [df.columns for df, _ in made]
    # Sizes and ids of all documents, components by class, and up to three small tables of components.
    assert sorted(c[0] for c in left if c[0] != "node") == ["cls", "doc_id"], left
    # The first frames have no hot keys or components beside them: each step's own files are gone behind it.
    assert made[0][1] <= before
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == dict(enumerate(components(texts)[1]))


def test_near_copies_stage_leaves_little_behind(spark, tmp_path, monkeypatch):
    """Beside its result the pipeline's stage keeps what the result is read from, not what led there."""
    pipeline = pytest.importorskip("corpus_pipeline")
    made, checkpoint = [], common.settle
    monkeypatch.setattr(ngram_jaccard, "settle", lambda df: made.append(checkpoint(df)) or made[-1])
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    pipeline.drop_near_copies(spark, docs, "").write.parquet(str(tmp_path / "out"))
    sizes, parts = components(texts)
    want = [i for i in range(len(texts)) if parts[i] == i or not sizes[i]]
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    path = lambda df: spark._jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    left = [df for df in made if (p := path(df)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]
    assert len(made) > 20 and len(left) <= 4, [df.columns for df in left]


def test_connected_components_of_random_graphs(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(-40, 40, (45, 2))] + [(i, i + 1) for i in range(100, 140)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame([*edges, (None, 1), (7, None)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    assert found == {i: find(i) for a, b in edges if a != b for i in (a, b)}


def nearest(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, v), v)
    out = {}
    for q, v in good.items():
        if q % every == 0:
            scored = sorted((-sum(float(a) * float(b) for a, b in zip(v, w)), i) for i, w in good.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_few_rows_are_searched_exactly(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1 + i % 3, 6).astype("f4").tolist()) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(30)] + [(200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (None, rows[0][1]), (60, rows[1][1])]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<float>, score string")
    found = {}
    for r in ann.nearest(docs, query_every=10, settings=ann.Settings(k=8)).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    want = nearest(rows, 10, 8)
    assert set(found) == set(want)
    for q, got in found.items():
        assert [i for i, _ in got] == [i for i, _ in want[q]]
        assert [s for _, s in got] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def test_recall_on_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r[0], list(r[1])) for r in docs.select("vec_id", "embedding").collect()]
    s = ann.Settings(k=5)
    want = nearest(rows, 20, 5)
    found = {}
    for r in ann.nearest(docs, settings=s).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(found[q] & {i for i, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * 5 * len(want)


def test_vectors_that_take_no_part(spark):
    none = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(none).count() == 0
    alone = spark.createDataFrame([(20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(alone).count() == 0


def recall_by_part(spark, x, parts):
    """Share of the true 20 nearest that is found, for each part of the queries."""
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(docs).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    hits = {q: len(found.get(q, set()) & set(np.argsort(-score[q])[:20].tolist())) / 20 for q in range(0, len(x), 20)}
    return {p: float(np.mean([h for q, h in hits.items() if parts[q] == p])) for p in set(parts)}


@pytest.mark.parametrize("case", ["dense third", "one long vector", "uneven norms", "dense third of uneven norms"])
def test_recall_holds_in_each_part(spark, case):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (8000, 64))
    dense = rng.random(len(x)) < 1 / 3 if "dense" in case else np.zeros(len(x), bool)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[dense] = x[0] + rng.normal(0, 0.02, (int(dense.sum()), 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if case == "one long vector":
        x[1] *= 30
    elif "uneven" in case:
        x *= np.exp(rng.normal(0, 0.5, len(x)))[:, None]
    got = recall_by_part(spark, x, ["dense" if d else "rest" for d in dense])
    assert min(got.values()) >= 0.92, got
