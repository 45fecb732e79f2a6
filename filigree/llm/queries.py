"""Registered queries of the operators, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm import ann, bpe, chat, media, ngram_jaccard, packing, pii, token_counts, toxicity, url_filters
from filigree.llm.common import table, tokenizer_path


def op1_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document, by the section of their first byte."""
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, tokenizer=tokenizer_path("byte_bpe_50k.json"), rule="start")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filters.judge_urls(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda c: c["strict"] == 1)
    found = found.select("doc_id", "spans", base.alias("base"))
    counts = [F.size(pii.of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path("word_bpe_49k.json"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: A conversation of control strings, which every run formats as well.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], rows.schema)
    read = chat.read_back(chat.format_conversations(rows.unionByName(extra)))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts(table(spark, sf_dir, "documents"))
    stored = stored.select("*", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    read = media.sniff_media(stored, keep=("n_bytes", "media_bytes", "media_sha256"))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_token_attribution, op2_url_filters, op3_ngram_jaccard, op4_packing, op5_pii, op6_nearest_neighbours, op7_toxicity,
        op8_bpe_round_trip, op9_chat_windows, op10_media,
    )
    return {f.__name__: f for f in own}


URL_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), named AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path
  FROM cut
), ruled AS (
  SELECT page_id, host, path,
         CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
              WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
              WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
              WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule,
         regexp_matches(host || path, '(?s)^([^/]*[.-])?spam[.-]|^([^/]*\.)?([^./]*-)?farm\.|^([^/]*\.)?ads[.-]|^([^/]*\.)?doubleclick\.|^[^/]*/(.*/)?wp-login\.php(/|$)|^[^/]*/(.*/)?cgi-bin/|^[^/]*/(.*/)?adult(/|$)|^([^/]*\.)?casino[.-]') AS bad
  FROM named
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
            WHEN rule IS NOT NULL OR bad THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""


# Turns, the windows' cuts one by one, and what each window repeats.
CHAT_SQL = r"""
WITH RECURSIVE listed AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place,
         4 + len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^ \t\n\x0B\f\r\p{L}\p{M}\p{N}]')) AS n,
         31 + length(role) + length(text) + len(regexp_extract_all(role || text, '[\\<#"]')) AS chars
  FROM listed
), digests AS (
  SELECT conv_id, c, count(*) AS n_turns, sum(chars) AS chars,
         max(CASE WHEN place = 0 AND role = 'system' THEN 1 ELSE 0 END) AS own,
         max(CASE WHEN place = 0 AND role = 'system' THEN n ELSE 0 END) AS lead_n,
         max(CASE WHEN place = 0 AND role = 'system' THEN chars ELSE 0 END) AS lead_chars,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss
  FROM placed GROUP BY conv_id, c
), room AS (
  SELECT c, own, greatest(512 - lead_n, 1) AS room FROM digests
), turns AS (
  SELECT p.c, p.place - r.own AS i, r.room, greatest(0, least(128, r.room - p.n)) AS spare, p.n,
         sum(p.n) OVER w - p.n AS upto, sum(p.chars) OVER w - p.chars AS chars_before
  FROM placed p JOIN room r USING (c) WHERE p.place >= r.own WINDOW w AS (PARTITION BY p.c ORDER BY p.place)
), backs AS (
  SELECT t.c, t.i, any_value(t.room) AS room, any_value(t.upto + t.n) AS through,
         min(h.upto) AS back_before, any_value(t.chars_before) - min(h.chars_before) AS history_chars
  FROM turns t JOIN turns h ON h.c = t.c AND h.i <= t.i AND h.upto >= t.upto - t.spare GROUP BY t.c, t.i
), cuts AS (
  SELECT c, i, back_before AS base, FALSE AS cut, CAST(0 AS HUGEINT) AS history_chars FROM backs WHERE i = 0
  UNION ALL
  SELECT b.c, b.i, CASE WHEN b.through - u.base > b.room THEN b.back_before ELSE u.base END, b.through - u.base > b.room,
         CASE WHEN b.through - u.base > b.room THEN b.history_chars ELSE 0 END
  FROM cuts u JOIN backs b ON b.c = u.c AND b.i = u.i + 1
), repeated AS (
  SELECT c, count(*) FILTER (cut) AS more, sum(history_chars) AS chars FROM cuts GROUP BY c
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(d.chars + coalesce(r.more * d.lead_chars + r.chars, 0) AS BIGINT) AS formatted_chars
FROM digests d LEFT JOIN repeated r USING (c)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": URL_SQL, "op3_ngram_jaccard": JACCARD_SQL, "op9_chat_windows": CHAT_SQL}
