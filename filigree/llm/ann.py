"""Nearest neighbours by inner product, with multiprobe p-stable hashing.

In each of several tables a vector's cell is made of a few Gaussian projections of its
direction, each shifted at random and cut into steps of a width.  A query visits its
own cell and perturbed ones, in the order of the estimated chance that a row of the
cell is a wanted neighbour, until the chances add up to a target and the cells hold
some forty rows for each one wanted.  Given the query's
projection p, that of a neighbour with cosine c is normal around c p with variance
1 - c^2, and that of any row is standard normal: the chance of a row grows with the
product of the ratios of both over the projections.  Only cells that hold rows count.
A cell much fuller than random directions would fill it holds a cluster, whose rows are
judged by how many there are.

Vectors are searched in bands of norms, each with tables of its own.  Every query
estimates the product s that its k-th neighbour reaches from a sample of all
vectors; to reach it, a vector of a band with the largest norm M needs at least the
cosine s / M.  So neither other queries nor single long vectors change what a query
visits.  A query whose cells would hold as many rows as one table visits that table as
a whole, and one that finds too few does so in a second pass.

Cells are dealt out in pieces of bounded size; a full cell is split.  A query goes to
the pieces that hold cells it visits.  A task holds one piece at a time, past which its
queries stream; they rank the rows of their cells by the exact product in double
precision, and the pieces' best are merged.

Equal vectors are one entry that keeps as many of its smallest ids as a result can
hold, which loses no result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filigree.llm.common import FLUSH_BYTES, pick, settle, tidily


@dataclass(frozen=True)
class Settings:
    k: int = 20
    tables: int = 2
    projections: int = 7
    #: Step of a projection of a vector of norm 1; steps beyond +-reach are one.
    width: float = 1.0
    reach: int = 2
    #: Chance in each table that a visited cell holds a neighbour, as estimated.
    target: float = 0.82
    #: Rows that a query's cells in a table hold at least, for each of the k wanted.
    least: int = 40
    #: Distance of wanted neighbours, in parts of the largest norm; None: estimated
    #: for each query from a sample of at most sample_rows vectors.
    distance: float | None = None
    sample_rows: int = 4096
    #: Vectors of a piece.
    piece: int = 8192
    seed: int = 11


#: Tasks that rank pieces; more pieces take turns in them.
MOST_TASKS = 20_000


def _phi(x):
    import numpy as np

    # Abramowitz and Stegun 7.1.26, whose error is below 1.5e-7.
    t = 1 / (1 + 0.3275911 * np.abs(x) / math.sqrt(2))
    y = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x / 2)
    return 0.5 * (1 + np.sign(x) * y)


#: Norms of a band differ by the root of 2 at most; the last of so many has all shorter vectors.
BANDS = 24


class Hasher:
    """Projections of all tables; cells as numbers in base ``steps``."""

    def __init__(self, dim: int, top: float, bands: dict[int, float], sample, rank: int, s: Settings):
        import numpy as np

        rng = np.random.default_rng(s.seed)
        self.s, self.top = s, top
        #: Bands that hold vectors, and the largest norm of each.
        self.bands = bands
        #: Vectors by which a query estimates the product of its k-th neighbour, the
        #: one of this rank (from 0) among them.
        self.sample, self.rank = sample, rank
        self.steps = 2 * s.reach
        m = s.tables * s.projections
        self.a = rng.normal(0, 1, (dim, m))
        self.b = rng.uniform(0, s.width, m)
        self.edges = np.arange(-s.reach + 1, s.reach) * s.width

    def project(self, x):
        """Directions of the rows of x on all projections."""
        return _directions(x) @ self.a

    def products(self, x):
        """Product that the k-th neighbour of each row's direction reaches, as estimated."""
        import numpy as np

        if self.s.distance is not None:
            return np.full(len(x), (1 - self.s.distance**2 / 2) * self.top)
        out = np.full(len(x), -np.inf)
        if self.rank + 1 >= len(self.sample):
            return out
        place = {v.tobytes(): i for i, v in enumerate(self.sample + 0.0)}
        for a in range(0, len(x), 256):
            part = x[a : a + 256]
            near = _directions(part) @ self.sample.T
            for i, v in enumerate(part + 0.0):
                # The query itself may be in the sample.
                if (own := place.get(v.tobytes())) is not None:
                    near[i, own] = -np.inf
            out[a : a + 256] = -np.partition(-near, self.rank, axis=1)[:, self.rank]
        return out

    def cells(self, projected):
        """Cell numbers in each table: rows x tables."""
        import numpy as np

        s = self.s
        step = np.floor((projected + self.b) / s.width).astype(np.int64) + s.reach
        step = np.clip(step, 0, self.steps - 1).reshape(len(projected), s.tables, s.projections)
        number = np.zeros(step.shape[:2], np.int64)
        for j in range(s.projections):
            number = number * self.steps + step[:, :, j]
        return number

    def fill(self, counts: dict[int, tuple]) -> None:
        """Take note of the cells that hold rows: sorted numbers and counts by table.

        Cells next to each other share a piece; ``place`` is a cell's first piece and
        its place among the piece's cells, ``splits`` in how many pieces it is.
        """
        import numpy as np

        s = self.s
        self.counts, self.place, self.splits, self.digits, self.usual = counts, {}, {}, {}, {}
        #: Of each piece: its table, and the first and last of its cells there.
        self.pieces: list[tuple[int, int, int]] = []
        spread = self._shares(np.zeros((s.tables * s.projections, 1)), 1.0)
        for tab, (cells, n) in sorted(counts.items()):
            first = np.zeros(len(cells), np.int64)
            splits = np.maximum(1, -(-n // s.piece))
            begin, held = 0, 0
            for i in range(len(cells)):
                if i > begin and (held + n[i] > s.piece or splits[i] > 1):
                    self.pieces.append((tab, begin, i))
                    begin, held = i, 0
                first[i] = len(self.pieces)
                held += int(n[i])
                if splits[i] > 1:
                    self.pieces += [(tab, i, i + 1)] * int(splits[i])
                    begin, held = i + 1, 0
            if begin < len(cells):
                self.pieces.append((tab, begin, len(cells)))
            self.place[tab], self.splits[tab] = first, splits
            digits = cells[:, None] // self.steps ** np.arange(s.projections - 1, -1, -1)[None, :] % self.steps
            self.digits[tab] = digits.astype(np.int8)
            own = spread[tab % s.tables * s.projections :][: s.projections]
            self.usual[tab] = sum(own[j][digits[:, j]] for j in range(s.projections))

    def _shares(self, middle, spread: float):
        """Logarithms of the chances of a projection's steps, for normal ones around middle."""
        import numpy as np

        low = _phi((self.edges[None, :] - self.b[:, None] - middle) / spread)
        low = np.concatenate([np.zeros((len(low), 1)), low, np.ones((len(low), 1))], axis=1)
        return np.log(np.maximum(np.diff(low, axis=1), 1e-30))

    def visits(self, projected, near: float, band: int):
        """Which of each table's cells one query visits: a list of (table, boolean array).

        projected: the query's projections in one row; near: cosine of wanted neighbours.
        """
        import numpy as np

        s = self.s
        chance = self._shares(near * projected[:, None], math.sqrt(max(1e-9, 1 - near * near)))
        out = []
        for t in range(s.tables):
            tab = band * s.tables + t
            cells, n = self.counts[tab]
            digits = self.digits[tab]
            p = sum(chance[t * s.projections + j][digits[:, j]] for j in range(s.projections))
            total = n.sum()
            dense = np.log(np.maximum(n - 2 * np.sqrt(n), 1e-12) / total)
            row = p - np.maximum(self.usual[tab], dense)
            weight = np.exp(row - row.max()) * n
            order = np.argsort(-row, kind="stable")
            sums = np.cumsum(weight[order])
            enough = int(np.searchsorted(sums, s.target * sums[-1])) + 1
            enough = max(enough, int(np.searchsorted(np.cumsum(n[order]), s.least * s.k)) + 1)
            seen = np.zeros(len(cells), bool)
            seen[order[:enough]] = True
            out.append((tab, seen))
        return out

    def asked(self, projected, product: float):
        """(table, visited cells) of one query in each band; None stands for all cells.

        Where the cells of all tables hold as many rows as there are, or where vectors
        of any direction may be wanted, one table is visited as a whole.
        """
        for band, norm in self.bands.items():
            near = min(product / max(norm, 1e-300), 1 - 1e-6)
            total = int(self.counts[band * self.s.tables][1].sum())
            found = self.visits(projected, near, band) if near > 0 else []
            if not found or sum(int(self.counts[tab][1][seen].sum()) for tab, seen in found) >= total:
                yield band * self.s.tables, None
            else:
                yield from found


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vec (array of double) of vectors that take part."""
    v = pick(df, vec_id=id_col, vec=vector_col).where("vec_id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    v = v.select("vec_id", F.col("vec").cast("array<double>").alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(~F.coalesce(odd, F.lit(True))).where(F.exists("vec", lambda x: x != 0.0))


def nearest(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, query_every: int = 20, settings: Settings = Settings()
) -> DataFrame:
    """The ``k`` nearest found for each row whose id is divisible by ``query_every``.

    Candidates are all rows but those with the query's own id.  Returns query_id,
    rank (from 1), vec_id, score (inner product in double precision), nearest
    first, ties to the smaller id.  A query with at most ``k`` candidates gets all.

    Null ids, and vectors that are null, empty, zero, or hold null or non-finite
    components, take no part; vectors of another length than the most common one
    take no part either.  Rows that repeat an id count once, with the smallest
    vector.  An empty table gives no rows.
    """
    s = settings
    rows = _valid(df, id_col, vector_col)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    stats = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("top")).orderBy(F.desc("n"), "dim").limit(1).collect()
    spark = df.sparkSession
    if not stats:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total, top = stats[0]
    rows = rows.where(F.size("vec") == dim).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    rows = settle(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "vec"))
    queries = rows.where(F.col("vec_id") % query_every == 0)
    # Equal vectors: the ids that can appear in any result.  The limit on the rank is
    # applied before the shuffle too, so a frequent vector's rows stay where they are.
    order = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))
    entries = settle(
        rows.withColumn("at", order).where(F.col("at") <= s.k + 1).drop("at")
        .groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    band = F.floor((F.log2(F.lit(top)) - F.log2(size)) * 2)
    band = F.least(F.greatest(F.coalesce(band, F.lit(BANDS - 1)), F.lit(0)), F.lit(BANDS - 1)).cast("int")
    # At most BANDS rows.
    kinds = entries.select(band.alias("band"), size.alias("size")).groupBy("band").agg(F.max("size").alias("top"), F.count("*").alias("n")).collect()
    sample, rank_of_k = _sample(entries, sum(r["n"] for r in kinds), dim, s)
    hasher = Hasher(dim, top, {r["band"]: r["top"] for r in kinds}, sample, rank_of_k, s)
    banded = entries.select("vec", "ids", band.alias("band"))
    hasher.fill(_filled(banded, hasher, dim))
    shape = spark.sparkContext.broadcast(hasher)

    def deal(batches):
        import numpy as np
        import pyarrow as pa

        h = shape.value
        for batch in batches:
            x, vec = _matrix(batch.column(0), dim), _packed(batch.column(0), dim)
            bands, ids, spread = batch.column(2).to_numpy(), batch.column(1), batch.column(3).to_numpy()
            numbers = h.cells(h.project(x))
            for t in range(h.s.tables):
                piece, place = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
                for b in np.unique(bands):
                    tab, own = int(b) * h.s.tables + t, bands == b
                    at = np.searchsorted(h.counts[tab][0], numbers[own, t])
                    piece[own] = h.place[tab][at] + spread[own] % h.splits[tab][at]
                    place[own] = at
                begin = np.array([h.pieces[p][1] for p in piece.tolist()], np.int64)
                yield pa.record_batch([
                    pa.array(piece.astype(np.int32)), pa.array((place - begin).astype(np.int32)), pa.nulls(len(x), pa.int64()), vec, ids, pa.nulls(len(x), pa.binary()),
                ], names=ROW)

    def ask(every: bool):
        def run(batches):
            import numpy as np
            import pyarrow as pa

            h = shape.value
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            of = {}
            for p, (tab, begin, end) in enumerate(h.pieces):
                of.setdefault(tab, []).append((p, begin, end))
            for batch in batches:
                ids, x, vec = batch.column(0).to_pylist(), _matrix(batch.column(1), dim), _packed(batch.column(1), dim).to_pylist()
                projected, product = h.project(x), np.full(len(x), -np.inf) if every else h.products(x)
                out, held = [], 0
                for i, doc in enumerate(ids):
                    for tab, seen in h.asked(projected[i], float(product[i])):
                        for p, begin, end in of[tab]:
                            if seen is None or seen[begin:end].any():
                                bits = b"" if seen is None else np.packbits(seen[begin:end]).tobytes()
                                out.append((p, -1, doc, vec[i], None, bits))
                                held += len(vec[i]) + len(bits)
                    if held >= FLUSH_BYTES or i + 1 == len(ids):
                        if out:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=ROW)
                        out, held = [], 0

        return run

    # Entries come before the queries of their piece.
    form = "piece int, place int, query_id long, vec binary, ids array<long>, cells binary"
    dealt = banded.withColumn("spread", F.xxhash64("vec").bitwiseAND(F.lit(0x7FFFFFFF))).mapInArrow(tidily(deal), form)
    tasks = min(len(hasher.pieces), MOST_TASKS)

    def found(asking: DataFrame, every: bool) -> DataFrame:
        rows = dealt.unionByName(asking.select("vec_id", "vec").mapInArrow(tidily(ask(every)), form))
        rows = rows.repartitionById(tasks, F.pmod("piece", F.lit(tasks))).sortWithinPartitions("piece", F.col("query_id").asc_nulls_first())
        return rows.mapInArrow(tidily(_ranker(shape, dim)), "query_id long, vec_id long, score double")

    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def top_k(pairs: DataFrame) -> DataFrame:
        # Tables report the same pair with the same score.
        pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")

    first = settle(top_k(found(queries, False)))
    enough = min(s.k, rows.count() - 1)
    n = first.groupBy("query_id").agg(F.count("*").alias("n"))
    short = settle(queries.join(n, queries["vec_id"] == n["query_id"], "left").where(F.coalesce("n", F.lit(0)) < enough).select("vec_id", "vec"))
    if short.isEmpty():
        return first
    again = top_k(found(short, True))
    return first.join(short, first["query_id"] == short["vec_id"], "left_anti").unionByName(again)


ROW = ["piece", "place", "query_id", "vec", "ids", "cells"]


def _filled(banded: DataFrame, hasher: Hasher, dim: int) -> dict[int, tuple]:
    """Cells that hold entries, by table: at most BANDS * tables * steps**projections."""
    import numpy as np

    shape = banded.sparkSession.sparkContext.broadcast(hasher)

    def run(batches):
        import pyarrow as pa

        h = shape.value
        every = h.steps**h.s.projections
        for batch in batches:
            numbers = h.cells(h.project(_matrix(batch.column(0), dim)))
            tab = batch.column(1).to_numpy().astype(np.int64)[:, None] * h.s.tables + np.arange(h.s.tables)[None, :]
            key, n = np.unique(tab * every + numbers, return_counts=True)
            yield pa.record_batch([pa.array(key), pa.array(n)], names=["key", "n"])

    rows = banded.select("vec", "band").mapInArrow(tidily(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = rows["key"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(key)
    every = hasher.steps**hasher.s.projections
    tab, cell, n = key[order] // every, key[order] % every, n[order]
    return {int(t): (cell[tab == t], n[tab == t]) for t in np.unique(tab)}


def _ranker(shape, dim: int):
    """Rank streamed queries against the piece before them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        h = shape.value
        k = h.s.k
        now, parts, piece = -1, [], None

        def gathered():
            """The piece's entries by cell: places, vectors, ids."""
            place = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)
            order = np.argsort(place, kind="stable")
            x = np.concatenate([p[1] for p in parts])[order] if parts else np.zeros((0, dim))
            ids = [i for p in parts for i in p[2]]
            return place[order], x, [ids[i] for i in order]

        for batch in batches:
            number = batch.column(0).to_numpy()
            asks = np.asarray(batch.column(2).is_valid())
            turn = (number[1:] != number[:-1]) | (asks[1:] != asks[:-1])
            cut = [0, *(np.flatnonzero(turn) + 1).tolist(), len(number)]
            out = ([], [], [])
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                if number[a] != now:
                    now, parts, piece = int(number[a]), [], None
                run_of = batch.slice(a, b - a)
                x = np.frombuffer(b"".join(run_of.column(3).to_pylist()), "<f8").reshape(-1, dim)
                if not asks[a]:
                    parts.append((run_of.column(1).to_numpy(), x, run_of.column(4).to_pylist()))
                    continue
                if piece is None:
                    piece, parts = gathered(), []
                place, rows, ids = piece
                _, begin, end = h.pieces[now]
                for q, own, bits in zip(x, run_of.column(2).to_pylist(), run_of.column(5).to_pylist(), strict=True):
                    at = np.arange(len(rows)) if not bits else np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=end - begin)[place])
                    if not len(at):
                        continue
                    near = rows[at] @ q
                    # One entry may be the query itself, so one more is needed.
                    least = np.partition(near, -min(k + 1, len(at)))[-min(k + 1, len(at))]
                    at = at[near >= least - 1e-9 * max(1.0, abs(least))]
                    exact = (rows[at] * q).sum(axis=1)
                    good = sorted(((-float(e), v) for e, r in zip(exact, at, strict=True) for v in ids[r] if v != own))[:k]
                    out[0].extend([own] * len(good))
                    out[1].extend(v for _, v in good)
                    out[2].extend(-e for e, _ in good)
            if out[0]:
                yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def _packed(column, dim: int):
    """A batch's vectors as binary values."""
    import pyarrow as pa

    raw = _matrix(column, dim).astype("<f8").tobytes()
    return pa.array([raw[i : i + 8 * dim] for i in range(0, len(raw), 8 * dim)], pa.binary())


def _matrix(column, dim: int):
    import numpy as np

    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _directions(x):
    import numpy as np

    # Scaled first, so that squares neither vanish nor overflow.
    x = x / np.abs(x).max(axis=1, initial=0)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _sample(entries: DataFrame, total: int, dim: int, s: Settings):
    """A bounded sample of the entries, and the rank in it that stands for rank k.

    In a sample of n of N entries the neighbour of rank k n / N stands for rank k of N.
    How many of the nearest k are drawn varies by the root of that, so the rank is
    taken as much farther: a query with a few near copies must not take one of them
    for its k-th neighbour.
    """
    import numpy as np

    found = entries.orderBy(F.xxhash64("vec")).limit(s.sample_rows).select("vec").collect()
    x = np.array([r[0] for r in found], np.float64).reshape(-1, dim)
    mean = s.k * len(x) / max(1, total)
    return x, math.ceil(mean + math.sqrt(mean))
