"""Similarity joins on unit vectors by a grid of matrix products.

Vectors are drawn into super-blocks, and every pair of super-blocks is one task: it
holds one side and streams the other past it, block by block, in an Arrow kernel that
applies the threshold or keeps the best of each row before anything leaves the worker.
A vector is shipped once for each super-block of the other side, so nothing has to fit
a broadcast and a task's memory is one super-block and one block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors that a task holds on average, and vectors that it multiplies at once.
SUPER = 16_384
BLOCK = 2048
#: In a search, short vectors are held up to so many bytes and so many of them.
HELD_BYTES = 32 << 20
MOST_HELD = 65_536
#: Products, of streamed vectors with all held ones, that are in memory.
PRODUCTS_AT_ONCE = 1 << 20
#: Rows that a kernel's batch has at most, in a search.
ROWS_OUT = 1 << 17
#: Tasks that a search is cut into where the vectors are few.
LEAST_TASKS = 12
#: Tasks of a grid; more cells take turns in them.
MOST_TASKS = 100_000

_FORM = "cell int, side int, id long, vector binary"


def trimmed(run):
    """A function for ``mapInArrow`` that gives memory back at its end; its worker lives on."""

    def done(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not this C library
            pass

    return done


def known(df: DataFrame, *more: str) -> DataFrame:
    """id (long), vector (doubles) and more columns of the rows that have a vector."""
    return df.where("vector IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), *more)


def _packed(df: DataFrame, bar: str | None = None) -> DataFrame:
    """Vectors as little-endian doubles; the column ``bar`` (long) follows as one more."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            flat, n = np.asarray(b.column(1).flatten(), np.float64), b.num_rows
            if bar and n:
                flat = np.column_stack([flat.reshape(n, -1), b.column(2).to_numpy().astype(np.float64)])
            raw = flat.astype("<f8").tobytes()
            size = len(raw) // n if n else 0
            yield pa.record_batch([b.column(0), pa.array([raw[i * size : (i + 1) * size] for i in range(n)], pa.binary())], names=["id", "vector"])

    return known(df, *([bar] if bar else [])).mapInArrow(trimmed(run), "id long, vector binary")


def _supers(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))


def _draw(n: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def _streamed(rows: DataFrame, cells: int, kernel, schema: str, block: int = BLOCK) -> DataFrame:
    """Rows (cell, side, id, vector) through a kernel (cell, held, streamed) -> batch.

    Held rows (side 0) come first; streamed is None for the held ones among themselves,
    else at most ``block`` rows.
    """
    tasks = min(cells, MOST_TASKS)

    def run(batches):
        import numpy as np

        now, parts, held, wait, waiting = -1, [], None, [], 0

        def matrix(parts):
            ids = np.concatenate([p[0] for p in parts])
            order = np.argsort(ids, kind="stable")
            return ids[order], np.concatenate([p[1] for p in parts])[order]

        def flush():
            nonlocal held, parts, wait, waiting
            if held is None and parts:
                held, parts = matrix(parts), []
                out = kernel(now, held, None)
                if out is not None and out.num_rows:
                    yield out
            if wait and held is not None:
                ids, x = matrix(wait)
                for a in range(0, len(ids), block):
                    out = kernel(now, held, (ids[a : a + block], x[a : a + block]))
                    if out is not None and out.num_rows:
                        yield out
            wait, waiting = [], 0

        for batch in batches:
            cell, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(cell)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                if cell[a] != now:
                    yield from flush()
                    now, parts, held = int(cell[a]), [], None
                part = batch.slice(a, b - a)
                ids = part.column(2).to_numpy()
                x = np.frombuffer(b"".join(part.column(3).to_pylist()), "<f8").reshape(len(ids), -1)
                if side[a] == 0:
                    parts.append((ids, x))
                else:
                    wait.append((ids, x))
                    waiting += len(ids)
                    if waiting >= BLOCK:
                        yield from flush()
        yield from flush()

    dealt = rows.repartitionById(tasks, F.pmod("cell", F.lit(tasks))).sortWithinPartitions("cell", "side")
    return dealt.mapInArrow(trimmed(run), schema)


def pairs_above(df: DataFrame, threshold: float, *, block: int = SUPER) -> DataFrame:
    """All pairs i < j whose dot product reaches the threshold: i, j, cos.

    df: id (long, distinct), vector (unit length); rows without a vector take no part.
    block: vectors that a task holds on average.  An empty table gives no pair.
    """
    rows = _packed(df)
    g = _supers(df.where("vector IS NOT NULL").count(), block)
    # Super-block s is held where it is the row of a grid cell, and streams where it is
    # the column; the grid is a triangle.
    other = F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    dealt = rows.select("id", "vector", _draw(g).alias("s")).select("id", "vector", "s", other.alias("t"))
    dealt = dealt.select(
        (F.least("s", "t") * g + F.greatest("s", "t")).cast("int").alias("cell"), F.when(F.col("s") <= F.col("t"), 0).otherwise(1).alias("side"), "id", "vector",
    )

    def kernel(cell, held, streamed):
        import numpy as np
        import pyarrow as pa

        if streamed is None and cell // g != cell % g:
            return None
        out = ([], [], [])
        for a in range(0, len(held[0]), BLOCK):
            x = held[0][a : a + BLOCK], held[1][a : a + BLOCK]
            y = streamed if streamed is not None else (held[0][a:], held[1][a:])
            at, to = np.nonzero(x[1] @ y[1].T >= threshold - 1e-9)
            # The sum in one order decides, whatever the block.
            cos = (x[1][at] * y[1][to]).sum(axis=1)
            i, j = x[0][at], y[0][to]
            keep = (cos >= threshold) & ((i < j) if streamed is None else (i != j))
            for o, v in zip(out, (np.minimum(i, j)[keep], np.maximum(i, j)[keep], cos[keep]), strict=True):
                o.append(v)
        return pa.record_batch([pa.array(np.concatenate(o)) for o in out], names=["i", "j", "cos"])

    return _streamed(dealt, g * g, kernel, "i long, j long, cos double")


def top_pairs(df: DataFrame, k: int, threshold: float = -1.0) -> DataFrame:
    """The k most similar pairs, ties by i, j."""
    return pairs_above(df, threshold).orderBy(F.desc("cos"), "i", "j").limit(k)


def best_of(held, streamed, k: int, skip_self: bool, threshold: float | None = None, barred: bool = False):
    """Arrow batch of the k held rows with the largest product for each streamed row.

    Products have to reach the threshold, if there is one.  barred: the last component is
    no part of a vector; only held rows in which it is larger than in the streamed row count.
    """
    import numpy as np
    import pyarrow as pa

    width = held[1].shape[1] - barred
    y = held[1][:, :width]
    out = ([], [], [])
    step = max(1, PRODUCTS_AT_ONCE // len(held[0]))
    for a in range(0, len(streamed[0]), step):
        owns, x = streamed[0][a : a + step], streamed[1][a : a + step, :width]
        near = x @ y.T
        if barred:
            near[held[1][:, width] <= streamed[1][a : a + step, width:]] = -np.inf
        n = min(len(held[0]), k + 1)
        least = np.partition(near, -n, axis=1)[:, -n] - 1e-9
        floor = -np.finfo(np.float64).max if threshold is None else threshold - 1e-9
        for row, own in enumerate(owns):
            at = np.flatnonzero(near[row] >= max(least[row], floor))
            cos = (y[at] * x[row]).sum(axis=1)
            if skip_self:
                at, cos = at[held[0][at] != own], cos[held[0][at] != own]
            if threshold is not None:
                at, cos = at[cos >= threshold], cos[cos >= threshold]
            best = np.lexsort((held[0][at], -cos))[:k]
            out[0].append(np.full(len(best), own))
            out[1].append(held[0][at][best])
            out[2].append(cos[best])
    return pa.record_batch([pa.array(np.concatenate(o)) for o in out], names=["query_id", "id", "cos"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties to the smaller id."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cos"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def measured(df: DataFrame) -> tuple[int, int]:
    """How many vectors there are, and how many components they have at most."""
    return tuple(df.where("vector IS NOT NULL").agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first())


def search(queries: DataFrame, corpus: DataFrame, k: int, *, block: int | None = None, skip_self: bool = False, threshold: float | None = None, bar: str | None = None, counts: tuple[int, int, int] | None = None) -> DataFrame:
    """The k corpus rows with the largest dot product for each query, by an exact scan.

    queries, corpus: id (long, distinct), vector; rows without a vector take no part.
    Returns query_id, id, cos, rank (from 1); ties go to the smaller id.  Without
    queries or corpus there is no row.  threshold: what products have to reach.  bar: a
    column (long, under 2^53) of both; only corpus rows in which it is larger than in the
    query count.  block: corpus rows that a task holds on average.  counts: rows of the
    corpus, their components and rows of the queries, where these are known.
    """
    n, width, asked = counts or (*measured(corpus), queries.where("vector IS NOT NULL").count())
    if block is None:
        block = max(SUPER, min(MOST_HELD, HELD_BYTES // (8 * max(1, width))))
    gc = _supers(n, block)
    gq = max(_supers(asked, 8 * block), min(_supers(asked, BLOCK), _supers(LEAST_TASKS, gc)))
    # The corpus is held, super-block by super-block; queries stream past all of it.
    c = _packed(corpus, bar).withColumn("y", _draw(gc)).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(gq - 1)))).withColumn("side", F.lit(0))
    q = _packed(queries, bar).withColumn("x", _draw(gq)).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(gc - 1)))).withColumn("side", F.lit(1))
    rows = c.unionByName(q).select((F.col("x") * gc + F.col("y")).cast("int").alias("cell"), "side", "id", "vector")

    def kernel(cell, held, streamed):
        return None if streamed is None else best_of(held, streamed, k, skip_self, threshold, bar is not None)

    found = _streamed(rows, gc * gq, kernel, "query_id long, id long, cos double", max(1, min(BLOCK, ROWS_OUT // max(1, k))))
    return ranked(found, k)


def knn_pairs(df: DataFrame, k: int = 20, min_score: float = -1.0) -> DataFrame:
    """Pairs i < j of which one is among the other's k nearest: i, j, cos."""
    near = search(df, df, k, skip_self=True).where(F.col("cos") >= min_score)
    return near.groupBy(F.least("query_id", "id").alias("i"), F.greatest("query_id", "id").alias("j")).agg(F.max("cos").alias("cos"))


def nearest(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """The most similar corpus row of each query, without a threshold."""
    return search(queries, corpus, 1).drop("rank")
