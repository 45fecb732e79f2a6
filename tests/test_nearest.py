"""Matching and assignment by lists of the nearest, against plain sequential code."""

import numpy as np
import pytest

from filigree.operators import graph, matching, similarity, vector_index


def unit(rng, n, width, copies=0):
    x = rng.normal(size=(n, width))
    x[n - copies :] = x[0]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def framed(spark, x, ids=None):
    rows = [(int(i), v.tolist()) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)]
    return spark.createDataFrame([*rows, (10_000, None)], "id long, vector array<double>")


def greedy(x, threshold):
    cos = lambda i, j: float((x[i] * x[j]).sum())
    edges = sorted((-cos(i, j), i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if cos(i, j) >= threshold)
    used, out = set(), []
    for _, i, j in edges:
        if not {i, j} & used:
            used |= {i, j}
            out.append((i, j))
    return sorted(out)


@pytest.mark.parametrize("first", [1, 3])
@pytest.mark.parametrize("rows", [0, 40, 1_000_000])
@pytest.mark.parametrize(("copies", "threshold"), [(0, -1.0), (0, 0.5), (15, 0.3)])
def test_nearest_match_equals_sequential_matching(spark, monkeypatch, first, rows, copies, threshold):
    """Whether lists are gone through in rounds or in one task; no pair is listed but for near ones."""
    monkeypatch.setattr(matching, "TAIL_VECTORS", 5)
    monkeypatch.setattr(matching, "LIST_ROWS", rows)
    monkeypatch.setattr(similarity, "pairs_above", None)
    x = unit(np.random.default_rng(first + copies), 41, 3, copies)
    found = matching.nearest_match(framed(spark, x), threshold, first=first).collect()
    assert sorted((r["i"], r["j"]) for r in found) == greedy(x, threshold)
    assert all(r["q"] == pytest.approx(x[r["i"]] @ x[r["j"]]) for r in found)


def test_nearest_match_of_one_task_and_of_nothing(spark):
    x = unit(np.random.default_rng(7), 60, 4, 3)
    assert sorted((r["i"], r["j"]) for r in matching.nearest_match(framed(spark, x), 0.2).collect()) == greedy(x, 0.2)
    assert matching.nearest_match(framed(spark, x[:0]), 0.2).count() == 0
    assert matching.nearest_match(framed(spark, x[:20]), 2.0).count() == 0


@pytest.mark.parametrize("rows", [16, 100, 1_000_000])
@pytest.mark.parametrize("alike", [False, True])
@pytest.mark.parametrize(("pairs", "bridges"), [(30, 12), (12, 30)])
def test_nearest_assignment_equals_serial_dictatorship(spark, monkeypatch, rows, alike, pairs, bridges):
    """More pairs than bridges and the other way; also where all pairs want the same bridges."""
    monkeypatch.setattr(matching, "LIST_ROWS", rows)
    monkeypatch.setattr(matching, "OFFERS", min(rows, 1000))
    rng = np.random.default_rng(pairs)
    x, y = unit(rng, pairs, 3, pairs if alike else 0), unit(rng, bridges, 3)
    order = rng.permutation(pairs).tolist()
    asking = spark.createDataFrame([(p, (0.5, order[p]), x[p].tolist()) for p in range(pairs)], "pair long, rank struct<a:double,b:long>, vector array<double>")
    found = {r["pair"]: r["bridge"] for r in matching.nearest_assignment(asking, framed(spark, y), first=2).collect()}
    want, free = {}, set(range(bridges))
    for p in sorted(range(pairs), key=order.__getitem__):
        if free:
            want[p] = min(free, key=lambda b: (-float((x[p] * y[b]).sum()), b))
            free.remove(want[p])
    assert found == want


def test_barred_search(spark):
    x = unit(np.random.default_rng(1), 30, 4)
    frame = framed(spark, x).selectExpr("id", "vector", "id AS bar")
    found = similarity.search(frame.where("id < 9"), frame, 3, block=8, bar="bar", threshold=0.1).orderBy("query_id", "rank").collect()
    for q in range(9):
        best = sorted((-float((x[q] * x[i]).sum()), i) for i in range(q + 1, 30))[:3]
        assert [r["id"] for r in found if r["query_id"] == q] == [i for c, i in best if -c >= 0.1]


def test_batches_of_a_search_are_bounded(monkeypatch):
    """Products in memory do not grow with the vectors that are held."""
    monkeypatch.setattr(similarity, "PRODUCTS_AT_ONCE", 64)
    seen, whole = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *more, **named: seen.append(a.size) or whole(a, *more, **named))
    x = unit(np.random.default_rng(1), 40, 4)
    out = similarity.best_of((np.arange(40), x), (np.arange(40), x), 2, True)
    assert out.num_rows == 80 and max(seen) <= 64


def test_triads_list_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "pairs_above", None)
    x = unit(np.random.default_rng(3), 20, 4)
    frame = framed(spark, x).selectExpr("id", "vector", "0.5D AS weight")
    assert graph.triads(frame.where("id < 14"), frame.where("id >= 14 AND id < 99"), -1.0, 13).count() == 6


def test_edge_search_lists_no_pairs(spark, small, monkeypatch):
    """Pairs above the threshold grow with the square of the table; they are not made."""
    from filigree import queries

    monkeypatch.setattr(similarity, "pairs_above", None)
    monkeypatch.setattr(matching, "TAIL_VECTORS", 100)
    assert queries.QUERIES["edge_search"](spark, small).count() == 10


def test_index_asks_in_small_batches(spark, monkeypatch):
    """A query is repeated for its probes in slices, whatever the size of the batch that comes in."""
    monkeypatch.setattr(vector_index, "VALUES_OUT", 40)
    x = unit(np.random.default_rng(5), 200, 4)
    frame = framed(spark, x)
    index = vector_index.build(frame, 8)
    exact = similarity.search(frame, frame, 3, skip_self=True)
    found = vector_index.search(index, frame, 3, probes=8, skip_self=True)
    assert sorted(map(tuple, found.select("query_id", "id", "rank").collect())) == sorted(map(tuple, exact.select("query_id", "id", "rank").collect()))
    assert vector_index.recall(found, exact).first()["recall"] == 1


def test_long_lists_come_in_small_batches(spark, monkeypatch):
    """Rows that a kernel gives at once do not grow with k: fewer queries are taken at a time."""
    seen, whole = [], similarity._streamed
    monkeypatch.setattr(similarity, "_streamed", lambda rows, cells, kernel, schema, block: seen.append(block) or whole(rows, cells, kernel, schema, block))
    frame = framed(spark, unit(np.random.default_rng(2), 40, 4))
    for k in (3, 1000, 1_000_000):
        assert similarity.search(frame, frame, k).count() == 40 * min(k, 40)
        assert seen[-1] * min(k, 131_072) <= similarity.ROWS_OUT
