"""An index of vectors by their nearest of some drawn centres, and searches in it.

Centres are a seeded sample of the vectors, in a number that is a parameter.  Every
vector is filed under its nearest centre; a query looks through the cells of the centres
nearest to it.  Which share of the true neighbours it finds is measured by
:func:`recall`, not assumed; with ``probes`` as large as the number of centres the
search is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.operators import similarity
from filigree.sources.tables import settle

#: Components of vectors that a batch of queries, each repeated for its probes, has at most.
VALUES_OUT = 1 << 20


@dataclass(frozen=True)
class Index:
    """rows: id, vector, cell; centres: a matrix of unit vectors, one for each cell."""

    rows: DataFrame
    centres: object
    #: Rows of the fullest cell, by which cells are split among tasks.
    sizes: dict[int, int]


def build(df: DataFrame, centres: int = 64, seed: int = 42) -> Index:
    """File unit vectors (id, vector) under at most ``centres`` centres.

    Rows without a vector are left out.  The driver gathers the centres and one count for
    each, whose number is the parameter's and does not grow with the table.
    """
    import numpy as np

    rows = similarity.known(df)
    drawn = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(centres).select("vector").collect()
    matrix = np.unique(np.array([r[0] for r in drawn], np.float64), axis=0) if drawn else np.zeros((0, 1))
    held = df.sparkSession.sparkContext.broadcast(matrix)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cells = np.zeros(0, np.int32)
            if b.num_rows:
                x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)
                cells = (x @ held.value.T).argmax(axis=1).astype(np.int32)
            yield pa.record_batch([*b.columns, pa.array(cells)], names=["id", "vector", "cell"])

    filed = settle(rows.mapInArrow(similarity.trimmed(run), "id long, vector array<double>, cell int"))
    sizes = {r["cell"]: r["count"] for r in filed.groupBy("cell").count().collect()}
    return Index(filed, matrix, sizes)


def search(index: Index, queries: DataFrame, k: int, *, probes: int = 16, skip_self: bool = False, piece: int = similarity.SUPER) -> DataFrame:
    """The k nearest found for each query (id, vector): query_id, id, cos, rank.

    A query visits the ``probes`` cells whose centres have the largest product with it.
    Cells larger than ``piece`` rows are split, so a full cell is not one task.
    """
    import numpy as np

    first, at = {}, 0
    for cell, n in sorted(index.sizes.items()):
        first[cell] = (at, max(1, -(-n // piece)))
        at += first[cell][1]
    spark = index.rows.sparkSession
    if not at:
        return spark.createDataFrame([], "query_id long, id long, cos double, rank int")
    places = F.broadcast(spark.createDataFrame([(c, b, s) for c, (b, s) in first.items()], "cell int, first int, splits int"))
    held = spark.sparkContext.broadcast(index.centres)

    def ask(batches):
        import pyarrow as pa

        filled = np.array(sorted(first), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)
            step = max(1, VALUES_OUT // (probes * x.shape[1]))
            for a in range(0, len(x), step):
                part = x[a : a + step]
                cells = filled[np.argsort(-(part @ held.value[filled].T), axis=1, kind="stable")[:, :probes]]
                rows = pa.array(a + np.repeat(np.arange(len(part)), cells.shape[1]))
                yield pa.record_batch([b.column(0).take(rows), b.column(1).take(rows), pa.array(cells.ravel().astype(np.int32))], names=["id", "vector", "cell"])

    form = "id long, vector array<double>, cell int"
    c = index.rows.join(places, "cell").select("id", "vector", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("splits")).cast("int")).alias("cell"), F.lit(0).alias("side"))
    q = similarity.known(queries).mapInArrow(similarity.trimmed(ask), form).join(places, "cell")
    q = q.select("id", "vector", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("splits") - 1)).alias("cell"), F.lit(1).alias("side"))
    rows = c.unionByName(q)
    pack = rows.select("cell", "side", "id", "vector").mapInArrow(similarity.trimmed(_pack), "cell int, side int, id long, vector binary")

    def kernel(_, held, streamed):
        return None if streamed is None else similarity.best_of(held, streamed, k, skip_self)

    return similarity.ranked(similarity._streamed(pack, at, kernel, "query_id long, id long, cos double"), k)


def _pack(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        raw = np.asarray(b.column(3).flatten(), np.float64).astype("<f8").tobytes()
        size = len(raw) // b.num_rows if b.num_rows else 0
        yield pa.record_batch([*b.columns[:3], pa.array([raw[i * size : (i + 1) * size] for i in range(b.num_rows)], pa.binary())], names=["cell", "side", "id", "vector"])


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n_wanted, n_found, recall of searches' (query_id, id) rows against exact ones."""
    wanted = exact.select("query_id", "id").distinct()
    got = wanted.join(found.select("query_id", "id").distinct().withColumn("got", F.lit(1)), ["query_id", "id"], "left")
    total = got.agg(F.count("*").alias("n_wanted"), F.coalesce(F.sum("got"), F.lit(0)).alias("n_found"))
    return total.withColumn("recall", F.col("n_found") / F.col("n_wanted"))
