"""Tables, sinks, checkpoints and keyed upserts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    A session that names none gets a local folder, if all its executors are this process;
    on a cluster that is an error, since no other executor could read it.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="filigree-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage into the cluster's shared checkpoint folder."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: str) -> tuple[DataFrame, int]:
    """Rows with ``turn``, their place from 0 by a column of distinct values; how many there are.

    Ranges of the column are numbered each in its own task; one count for each is gathered.
    """
    at = F.monotonically_increasing_id()
    ranged = settle(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", at))
    part = F.shiftright("__at", 33)
    counts = sorted(ranged.groupBy(part.alias("part")).count().collect())
    first, starts = 0, []
    for r in counts:
        starts.append((r["part"], first))
        first += r["count"]
    starts = F.broadcast(df.sparkSession.createDataFrame(starts, "__part long, __first long"))
    turn = (F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias("turn")
    return ranged.join(starts, part == F.col("__part")).select(*df.columns, turn), first


def ping(spark: SparkSession) -> bool:
    """Whether the session runs a job."""
    return spark.range(1).count() == 1


def keep_last(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in ``order``: a keyed upsert of a batch."""
    last = W.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return df.withColumn("__at", F.row_number().over(last)).where("__at = 1").drop("__at")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it does not have."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def write_table(df: DataFrame, path: str, *, by: list[str] | None = None) -> None:
    """Replace a table by one committed job."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """Typed JSON lines; malformed ones are left out.

    ``line`` grows with a line's place in its file; numbers leave gaps, and over several
    files they follow the order in which Spark reads them.
    """
    raw = spark.read.text(path).select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("line"))
    parsed = raw.select("line", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").alias("j"))
    return parsed.where("j IS NOT NULL AND r IS NOT NULL").select("line", "r.*")


def lines_of_words(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """``value``: lines of JSON records whose word is one of these, byte for byte."""
    return spark.read.text(path).where(F.get_json_object("value", "$.word").isin(*words))
