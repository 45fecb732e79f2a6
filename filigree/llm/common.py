"""Shared helpers: tables, checkpoints and the byte-level vocabulary."""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of payload after which a Python stage hands a batch to the JVM.
FLUSH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to a Python worker, where the session says nothing else.
ARROW_BYTES = 4 << 20


def lean(spark: SparkSession) -> None:
    """Hand Python workers small batches, unless the session has a size of its own.

    The default of 64 MB is for short rows; with whole texts each running task would hold
    several times that outside the heap, and the allocators keep it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(ARROW_BYTES))


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the wanted columns under new names, so extra columns cannot clash.

    Every operator begins with it, so it also sees to the size of batches (:func:`lean`).

    A name is looked up without regard to case, as Spark does; where the frame
    holds several such columns, the exact spelling is taken.
    """
    lean(df.sparkSession)
    out = []
    for new, old in names.items():
        at = [i for i, c in enumerate(df.columns) if c == old] or [
            i for i, c in enumerate(df.columns) if c.lower() == old.lower()
        ]
        if not at:
            raise ValueError(f"no column {old!r} among {df.columns}")
        out.append((new, at[0]))
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*[F.col(f"`{df.columns[i]}`").alias(new) for new, i in out])
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{i}").alias(new) for new, i in out])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; a local one only where all executors are this process.

    Raises where a cluster's session names no folder.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="filigree-checkpoint-"))


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared checkpoint folder; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def brief(df: DataFrame) -> DataFrame:
    """The same rows as a frame for one action, at whose end the shuffle files it made are removed.

    They would stay until the driver happens to collect its garbage.
    """
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return df.select("*")
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def release(*settled: DataFrame) -> None:
    """Remove the files of frames given by :func:`settle` that nothing reads any more."""
    for df in settled:
        spark = df.sparkSession
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a key up to which it is never split.
SPLIT_ROWS = 64


def hot_keys(many: DataFrame, key: list[str], total: int) -> DataFrame | None:
    """Keys that have more rows than a task should get, with ``copies`` to split them into.

    total: rows of ``many``.  There are at most ``4 * partitions`` such keys, which is
    the bound of what is gathered; None if there is none.
    """
    spark = many.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = max(SPLIT_ROWS, total // (4 * parts))
    copies = F.ceil(F.col("count") / limit).cast("int").alias("copies")
    rows = many.groupBy(*key).count().where(F.col("count") > limit).select(*key, copies)
    found = rows.collect()
    return spark.createDataFrame(found, rows.schema) if found else None


def spread_join(many: DataFrame, one: DataFrame, key: list[str], by: Column, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Join on ``key`` in which rows of a hot key go to several tasks.

    Rows of ``many`` are dealt by a hash of ``by``, and the rows of ``one`` for a hot
    key are repeated for each share.  hot: see :func:`hot_keys`, counted on ``many`` or
    on what it was made of.
    """
    if hot is None:
        return many.join(one, key, how)
    hot = F.broadcast(hot)
    share = F.pmod(F.xxhash64(by), F.coalesce("copies", F.lit(1))).cast("int")
    left = many.join(hot, key, "left").withColumn("__share", share).drop("copies")
    right = one.join(hot, key, "left").withColumn("__share", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    return left.join(right, [*key, "__share"], how).drop("__share")


def tidy() -> None:
    """Give memory that a Python stage has freed back to the system.

    Workers live on after their tasks; what their allocators keep would add up over
    the stages that run in one executor.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


#: What workers keep over tasks, by owner, and how it is dropped.
_KEPT: dict[str, Callable[[], None]] = {}


def kept(owner: str, drop: Callable[[], None]) -> None:
    """Have what an operator's module keeps over tasks dropped when another one's tasks begin."""
    _KEPT[owner] = drop


def begin(owner: str) -> None:
    """Drop what operators other than ``owner`` keep in this worker."""
    for name, drop in _KEPT.items():
        if name != owner:
            drop()


def tidily(run, owner: str = ""):
    """A function for ``mapInArrow`` that begins without other operators' caches and ends tidily."""

    def done(batches):
        # A function of the module, so that it finds the worker's own caches.
        begin(owner)
        yield from run(batches)
        tidy()

    return done


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Items of a block in :func:`scan`, and code points of a piece in :func:`pieces`.
SCAN_BLOCK = 256
PIECE_CHARS = 512


def let(c: Column, f) -> Column:
    """f of a value that is computed once, also where f uses it in a lambda."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def scan(items: Column, state: Column, step, out_type: str) -> Column:
    """Array of what ``step`` gives for each item, with a state handed from one to the next.

    step: (state, item) to (state, output).  An aggregate copies its state in each step,
    so one that gathers outputs in it takes the square of the items.  Here one pass over
    blocks of items notes the state at the begin of each, and a second one gathers a
    block's outputs from there.
    """
    none = F.array().cast(f"array<{out_type}>")

    def later(acc: Column, block: Column) -> Column:
        end = F.aggregate(block, acc["state"], lambda s, x: step(s, x)[0])
        return F.struct(end.alias("state"), F.concat(acc["starts"], F.array(acc["state"])).alias("starts"))

    def add(acc: Column, x: Column) -> Column:
        now, out = step(acc["state"], x)
        return F.struct(now.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    def outputs(b: Column) -> Column:
        return F.aggregate(b["block"], F.struct(b["start"].alias("state"), none.alias("out")), add, lambda acc: acc["out"])

    def over(blocks: Column) -> Column:
        first = F.struct(state.alias("state"), F.slice(F.array(state), 1, 0).alias("starts"))
        starts = F.aggregate(blocks, first, later, lambda acc: acc["starts"])
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), starts.alias("start")), outputs))

    return let(blocked(items), lambda b: F.when(F.size(b) > 0, over(b)).otherwise(none))


def blocked(items: Column) -> Column:
    """An array in blocks of ``SCAN_BLOCK`` items; a slice of an array reads all of it, one of blocks few."""
    size = F.lit(SCAN_BLOCK)

    def blocks(it: Column) -> Column:
        last = F.greatest(F.floor((F.size(it) - 1) / size).cast("int"), F.lit(0))
        return F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(it, i * size + 1, size)), lambda b: F.size(b) > 0)

    return let(items, blocks)


def part_of(blocks: Column, start: Column, n: Column) -> Column:
    """n items from place ``start`` (from 0) of an array given by :func:`blocked`."""
    size = F.lit(SCAN_BLOCK)
    first = F.floor(start / size).cast("int")
    last = F.floor((start + F.greatest(n, F.lit(1)) - 1) / size).cast("int")
    return F.slice(F.flatten(F.slice(blocks, first + 1, last - first + 1)), start - first * size + 1, n)


def pieces(text: Column) -> Column:
    """The text in pieces of ``PIECE_CHARS`` code points, for :func:`cut`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Code points from start to end of a text given as :func:`pieces`.

    A substring of a whole text is found by counting from its begin; this counts from
    the begin of a piece.  Places beyond either end are left out.
    """
    n = F.lit(PIECE_CHARS)
    start = F.greatest(start, F.lit(0))

    def taken(i: Column, j: Column) -> Column:
        first = F.substr(F.coalesce(F.get(parts, i), F.lit("")), start - i * n + 1, F.when(i == j, end - start).otherwise(n))
        middle = F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        last = F.substr(F.coalesce(F.get(parts, j), F.lit("")), F.lit(1), end - j * n)
        return F.when(i == j, first).otherwise(F.concat(first, middle, last))

    whole = taken(F.floor(start / n).cast("int"), F.floor((end - 1) / n).cast("int"))
    return F.when(end > start, whole).otherwise(F.lit(""))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Texts made of these characters alone are split by an explicit-class pattern or
#: by the rank-file library; all others go through the reference tokenizer, so
#: that no two libraries' Unicode tables can disagree.
PLAIN = "\\t\\n\\r\\x20-\\x7e¡«»¿À-ÖØ-öø-ÿ–—‘’“”…"
NOT_PLAIN = re.compile(f"[^{PLAIN}]")


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the rest, in order, take the
    code points from 256 on.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class ByteLevelEncoder:
    """Ids of a byte-level BPE file, exactly as the tokenizers library gives them.

    Plain texts are encoded by the rank-based library from the same file's
    vocabulary; a text with other characters, or with an added token's string,
    goes to the tokenizers library itself.  ``lengths[id]`` is a token's length
    in UTF-8 bytes, so running sums of it are the token offsets.
    """

    def __init__(self, path: str):
        import numpy as np
        import tiktoken

        self.path = path
        self._exact = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {s: b for b, s in enumerate(byte_symbols())}
        vocab = spec["model"]["vocab"]
        ranks = {bytes(back[c] for c in s): i for s, i in vocab.items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        top = max([*vocab.values(), *self.added.values()]) + 1
        self.lengths = np.zeros(top, np.int64)
        for s, i in ranks.items():
            self.lengths[i] = len(s)
        for s, i in self.added.items():
            self.lengths[i] = len(s.encode())
        letters, digits = "A-Za-zÀ-ÖØ-öø-ÿ", "0-9"
        pattern = (
            rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+"
            rf"| ?[^\s{letters}{digits}]+|\s+(?!\S)|\s+"
        )
        self.fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @property
    def exact(self):
        """The library's tokenizer, which is loaded when the first text needs it."""
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.path)
        return self._exact

    def __call__(self, text: str):
        import numpy as np

        if not text:
            return np.zeros(0, np.uint32)
        if NOT_PLAIN.search(text) or any(s in text for s in self.added):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text).astype(np.uint32, copy=False)


@lru_cache(maxsize=1)
def byte_level(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)


kept("bytes", byte_level.cache_clear)
