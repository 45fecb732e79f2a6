"""A corpus from raw documents: filter, deduplicate, mask, pack.

Every stage takes (spark, docs, sf_dir) and gives a frame that is written and read
again as the next stage's docs.  All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm import ngram_jaccard, packing, pii, toxicity
from filigree.llm.common import ensure_checkpoint_dir, table, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Score from which a document is rejected.
REJECT = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the limit; the score is of the whole text."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS[1:]).where(F.col("score") < REJECT).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the smallest id, then the smallest hash of its text.

    Rows, not ids, are what is kept: one with another's id and another text is judged by
    its own text, and rows without id stand behind those with one.  Equal rows are one.
    Texts without a word link with nothing and stay, each row of them.
    """
    rows = docs.select(*COLUMNS).withColumn("__hash", F.xxhash64("text"))
    blank = F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", "") == ""
    found = ngram_jaccard.jaccard_components(rows.where(~blank), keep=("__hash",))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", F.col("__hash").alias("hash"))).alias("first")
    key = lambda i, h: F.xxhash64(F.coalesce(i, F.lit(0)), i.isNull(), h).alias("__key")
    kept = found.groupBy("component").agg(first).select(key(F.col("first.doc_id"), F.col("first.hash")))
    named = rows.where(~blank).withColumn("__key", key(F.col("doc_id"), F.col("__hash"))).join(kept, "__key", "left_semi")
    named = named.dropDuplicates(["__key", "doc_id", "__hash"])
    return named.select(*COLUMNS).unionByName(rows.where(blank).select(*COLUMNS))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the spans found replaced by their kind."""
    found = pii.find_pii(docs, keep=("lang", "source"))
    text = pii.masked(F.col("text"), F.col("spans"))
    return found.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids."""
    return packing.pack_documents(docs, tokenizer=tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_copies), ("pii", mask_pii), ("packing", pack)]

#: Scores of a trained model and packed sequences have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared checkpoint folder.

    A stage's result goes when the next one's is there; the last one's stays for the
    frame that is returned.
    """
    import uuid

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if i:
            _remove(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
