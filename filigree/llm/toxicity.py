"""Toxicity scores from subword-bag embeddings and a linear softmax.

A word is the bag of itself and its character n-grams, hashed into rows of an
embedding table; a document is the mean of its words, each the mean of its
subwords; a softmax over two classes sits on top.  Embeddings and softmax are
trained jointly with numpy in one task, on a bounded sample of labelled rows.
A misspelling that was never seen shares most of its n-gram rows with the word.

After training, a word's contribution to the difference of both logits is one
number, so that scoring is a mean of numbers over the words of whole texts.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigree.llm.common import kept, pick, tidily

WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]", re.UNICODE)


@dataclass(frozen=True)
class Settings:
    """Parameters; max_rows and max_bytes bound what training gathers."""

    max_rows: int = 6_000
    max_bytes: int = 96 << 20
    buckets: int = 1 << 17
    dim: int = 8
    shortest: int = 3
    longest: int = 5
    epochs: int = 6
    batch: int = 64
    rate: float = 3.0
    #: Words whose numbers a worker remembers, and their longest.
    memo: int = 500_000
    memo_word: int = 40
    seed: int = 7


#: Characters of a text up to which its words are listed; those of longer texts come one by one.
LISTED = 1 << 20


def words(text: str) -> Iterable[str]:
    text = text.lower()
    return WORD.findall(text) if len(text) <= LISTED else (m.group() for m in WORD.finditer(text))


def subwords(word: str, s: Settings) -> list[int]:
    """Rows of a word: itself and its n-grams with word ends, distinct."""
    w = f"<{word}>"
    if len(w) > VECTORED and w.isascii():
        return _long_subwords(w, s)
    grams = {w[i : i + n] for n in range(s.shortest, s.longest + 1) for i in range(len(w) - n + 1)}
    grams.add(w)
    return sorted({zlib.crc32(g.encode("utf-8", "surrogatepass")) % s.buckets for g in grams})


#: Characters from which an ASCII word's n-grams are hashed all at once; the rows are the same.
VECTORED = 40


@lru_cache(maxsize=1)
def _crc_steps():
    """CRC-32 of each byte, by the polynomial."""
    import numpy as np

    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> np.uint32(1) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


def _long_subwords(w: str, s: Settings) -> list[int]:
    import numpy as np

    raw, step = np.frombuffer(w.encode(), np.uint8).astype(np.uint32), _crc_steps()
    rows = [np.array([zlib.crc32(w.encode()) % s.buckets], np.uint32)]
    for n in range(s.shortest, s.longest + 1):
        crc = np.full(len(raw) - n + 1, 0xFFFFFFFF, np.uint32)
        for k in range(n):
            crc = step[(crc ^ raw[k : len(raw) - n + 1 + k]) & np.uint32(255)] ^ (crc >> np.uint32(8))
        rows.append((crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(s.buckets))
    return np.unique(np.concatenate(rows)).tolist()


class Model:
    """Weights after training: a number for each subword row, and a bias."""

    def __init__(self, weights, bias: float, settings: Settings):
        self.weights, self.bias, self.settings = weights, bias, settings
        self.memo: dict[str, float] = {}

    def word(self, w: str) -> float:
        rows = subwords(w, self.settings)
        x = float(self.weights[rows].mean())
        if len(w) <= self.settings.memo_word:
            if len(self.memo) >= self.settings.memo:
                self.memo.clear()
            self.memo[w] = x
        return x

    def score(self, text: str) -> float:
        import math

        memo = self.memo
        total, n = 0.0, 0
        for w in words(text):
            x = memo.get(w)
            total += self.word(w) if x is None else x
            n += 1
        z = self.bias + (total / n if n else 0.0)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def train(texts: list[str], labels: list[int], s: Settings) -> Model:
    """Fit embeddings and softmax together by Adagrad on mini-batches."""
    import numpy as np

    rng = np.random.default_rng(s.seed)
    vocab: dict[str, int] = {}
    ids, counts, bounds = [], [], [0]
    for text in texts:
        found: dict[int, int] = {}
        for w in words(text):
            i = vocab.setdefault(w, len(vocab))
            found[i] = found.get(i, 0) + 1
        ids.append(np.fromiter(found.keys(), np.int64, len(found)))
        counts.append(np.fromiter(found.values(), np.float32, len(found)))
        bounds.append(bounds[-1] + len(found))
    y = np.array(labels, np.int64)
    seen = np.zeros(len(vocab), np.int64)
    for i in ids:
        seen[i] += 1
    rows = [np.array(subwords(w, s), np.int64) for w in vocab]
    size = np.array([len(r) for r in rows], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    del rows, vocab
    table = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    top = np.zeros((s.dim, 2), np.float32)
    top[:, 1] = rng.normal(0, 1, s.dim)
    bias = np.zeros(2, np.float32)
    sums = [np.full(s.buckets, 1e-6, np.float32), np.full(top.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)]
    g_table = np.zeros_like(table)
    for _ in range(s.epochs):
        order = rng.permutation(len(y))
        for b in range(0, len(order), s.batch):
            docs = [d for d in order[b : b + s.batch] if len(ids[d])]
            if not docs:
                continue
            own = np.concatenate([ids[d] for d in docs])
            share = np.concatenate([counts[d] / counts[d].sum() for d in docs])
            doc = np.repeat(np.arange(len(docs)), [len(ids[d]) for d in docs])
            used, place = np.unique(own, return_inverse=True)
            n = size[used]
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            sub = flat[np.repeat(at[used] - first, n) + np.arange(n.sum())]
            word = np.add.reduceat(table[sub], first, axis=0) / n[:, None]
            hidden = np.zeros((len(docs), s.dim), np.float32)
            begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            hidden[:] = np.add.reduceat(word[place] * share[:, None], begin, axis=0)
            z = hidden @ top + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(docs)), y[docs]] -= 1
            g_hidden = p @ top.T
            for w, g, k in ((top, hidden.T @ p / len(docs), 1), (bias, p.mean(axis=0), 2)):
                sums[k] += g * g
                w -= 0.2 * s.rate * g / np.sqrt(sums[k])
            g_word = np.zeros((len(used), s.dim), np.float32)
            for k in range(s.dim):
                g_word[:, k] = np.bincount(place, share * g_hidden[doc, k], len(used))
            g_word /= n[:, None]
            back = np.repeat(np.arange(len(used)), n)
            for k in range(s.dim):
                g_table[:, k] = np.bincount(sub, g_word[back, k], s.buckets)
            sums[0] += np.einsum("ij,ij->i", g_table, g_table) / s.dim
            table -= s.rate * g_table / np.sqrt(sums[0])[:, None]
    side = top[:, 1] - top[:, 0]
    return Model((table @ side).astype(np.float32), float(bias[1] - bias[0]), s)


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Rows of the fold that no training sees; a null id belongs to it."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(True))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    settings: Settings = Settings(),
) -> Model:
    """Train on at most ``max_rows`` labelled rows outside the held-out fold.

    The sample is the rows whose id hashes lowest, the same whatever the table's
    order, as far as their texts keep below ``max_bytes``.  Rows without id,
    label or text take no part.  Without any row, or with one class alone, all
    scores are the (smoothed) share of label 1.
    """
    import math

    s = settings
    rank = F.xxhash64(F.col("doc_id"), F.lit(s.seed))
    known = (
        pick(labels, doc_id=id_col, label=label_col)
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .select("doc_id", "label", rank.alias("rank"))
        .orderBy("rank", "doc_id").limit(s.max_rows)
    )
    found = known.collect()
    chosen = known.sparkSession.createDataFrame([(r[0], int(r[1])) for r in found], "doc_id long, label int")
    texts = pick(docs, doc_id=id_col, text=text_col).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    sizes = texts.select("doc_id", F.octet_length("text").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))
    order = {r[0]: i for i, r in enumerate(found)}
    room, take = s.max_bytes, []
    for doc, n in sorted(((r[0], r[1]) for r in sizes.collect()), key=lambda r: order[r[0]]):
        if n <= room:
            room -= n
            take.append(doc)
    label = {r[0]: int(r[1]) for r in found}
    y = [label[d] for d in take]
    if len(set(y)) < 2:
        import numpy as np

        share = (sum(y) + 1) / (len(y) + 2)
        return Model(np.zeros(s.buckets, np.float32), math.log(share / (1 - share)), s)
    keep = known.sparkSession.createDataFrame([(d, label[d], order[d]) for d in take], "doc_id long, label int, at int")
    rows = (
        pick(docs, doc_id=id_col, text=text_col).where(F.col("text").isNotNull()).join(F.broadcast(keep), "doc_id")
        .groupBy("doc_id").agg(F.max("text").alias("text"), F.first("label").alias("label"), F.first("at").alias("at"))
        .repartition(1).sortWithinPartitions("at").select("text", "label")
    )
    return _trained(rows, s)


def _trained(rows: DataFrame, s: Settings) -> Model:
    """Train on an executor, in one task over the bounded sample; the driver gets the weights."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        texts, labels = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
        if texts:
            model = train(texts, labels, s)
            yield pa.record_batch([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["weights", "bias"])

    made = rows.mapInArrow(tidily(run), "weights binary, bias double").first()
    return Model(np.frombuffer(made["weights"], np.float32), made["bias"], s)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score (0 to 1) for whole texts, and the columns in ``keep`` as they are.

    Null and empty texts get the score of the bias alone.  Repeated rows and null
    ids are kept; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.settings))

    def run(batches):
        import pyarrow as pa

        own = _loaded(held)
        for batch in batches:
            scores = [own.score(t.as_py() or "") for t in batch.column(1)]
            rest = [batch.column(2 + i) for i in range(len(keep))]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), *rest], names=["doc_id", "score", *keep])

    rows = pick(docs, doc_id=id_col, __text=text_col, **{k: k for k in keep})
    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()), *(rows.schema[k] for k in keep)])
    return rows.mapInArrow(tidily(run, "toxicity"), schema)


_MODELS: dict[tuple, Model] = {}
kept("toxicity", _MODELS.clear)


def _loaded(held) -> Model:
    """A worker's model, kept over tasks with what it remembers of words."""
    weights, bias, settings = held.value
    key = hashlib.sha256(weights.tobytes()).digest(), bias, settings
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(*held.value)
    return _MODELS[key]
