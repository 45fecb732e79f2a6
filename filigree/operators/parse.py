"""Words and senses of nested dictionary records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigree.functions.text import embed_text, parse_dis1, present, texts

# Relation kinds in the order in which a record's relations are listed.
KINDS = ("antonyms", "meronyms", "holonyms", "hypernyms", "hyponyms", "derived", "related", "coordinate_terms", "synonyms")

_STRINGS = T.ArrayType(T.StringType())
_RELATIONS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("_dis1", T.StringType())]))
_BY_KIND = [T.StructField(k, _RELATIONS) for k in KINDS]


def _list_of(**fields) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


RECORD = T.StructType([
    T.StructField("word", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("lang_code", T.StringType()),
    T.StructField("sounds", _list_of(ipa=T.StringType(), tags=_STRINGS)),
    T.StructField("forms", _list_of(form=T.StringType(), tags=_STRINGS)),
    T.StructField("etymology_text", T.StringType()),
    T.StructField("senses", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("glosses", _STRINGS), T.StructField("examples", _list_of(text=T.StringType())),
        T.StructField("tags", _STRINGS), T.StructField("topics", _STRINGS), T.StructField("wikidata", _STRINGS), *_BY_KIND,
    ]))),
    *_BY_KIND,
])


def relations(source) -> Column:
    """(kind, word, dis1) of a record's or sense's relations, by kind, then list order.

    source: a function from a field's name to its column.
    """

    def one(kind: str) -> Column:
        items = F.filter(source(kind), lambda r: F.length(r["word"]) > 0)
        made = F.transform(items, lambda r: F.struct(F.lit(kind).alias("kind"), r["word"].alias("word"), parse_dis1(r["_dis1"]).alias("dis1")))
        return F.coalesce(made, F.array().cast("array<struct<kind:string,word:string,dis1:array<int>>>"))

    return F.concat(*[one(k) for k in KINDS])


def ipa(sounds: Column) -> Column:
    """The first pronunciation without tags, else the first one, else null."""
    named = F.filter(sounds, lambda s: F.length(s["ipa"]) > 0)
    plain = F.filter(named, lambda s: F.coalesce(F.size(s["tags"]), F.lit(0)) <= 0)
    return F.coalesce(F.get(plain, F.lit(0))["ipa"], F.get(named, F.lit(0))["ipa"])


def _gloss(sense: Column) -> Column:
    return present(F.get(sense["glosses"], F.lit(0)))


def entries(raw: DataFrame, lang: str = "en") -> DataFrame:
    """Records of one language that have a word, a class and a sense with a gloss.

    A missing language counts as English.
    """
    code = F.coalesce(present(F.col("lang_code")), F.lit("en"))
    kept = raw.where((F.length("word") > 0) & (F.length("pos") > 0) & (code == lang))
    return kept.where(F.exists("senses", lambda s: F.length(F.get(s["glosses"], F.lit(0))) > 0)).withColumn("lang_code", code)


def _sense_id(word: Column, pos: Column, sense: Column, at: Column) -> Column:
    return F.coalesce(present(sense["id"]), F.concat_ws("-", word, pos, at.cast("string")))


def words(raw: DataFrame) -> DataFrame:
    """word, pos, lang_code, ipa, forms, etymology, sense_ids, relations; and ``line``."""
    kept = entries(raw)
    numbered = F.transform("senses", lambda s, i: F.struct(_gloss(s).alias("gloss"), _sense_id(F.col("word"), F.col("pos"), s, i).alias("id")))
    ids = F.transform(F.filter(numbered, lambda s: s["gloss"].isNotNull()), lambda s: s["id"])
    return kept.select(
        *(["line"] if "line" in raw.columns else []), "word", "pos", "lang_code", ipa(F.col("sounds")).alias("ipa"), texts(F.col("forms"), "form").alias("forms"),
        F.coalesce("etymology_text", F.lit("")).alias("etymology"), ids.alias("sense_ids"), relations(F.col).alias("relations"),
    )


def senses(raw: DataFrame) -> DataFrame:
    """A row per sense with a gloss; sense_idx is its place in the record."""
    kept = entries(raw)
    flat = kept.select(*(["line"] if "line" in raw.columns else []), "word", "pos", F.posexplode("senses").alias("sense_idx", "s"))
    s = F.col("s")
    empty = F.array().cast("array<string>")
    return (
        flat.withColumn("gloss", _gloss(s)).where("gloss IS NOT NULL")
        .withColumn("examples", texts(s["examples"], "text"))
        .select(
            *(["line"] if "line" in raw.columns else []), "word", "pos", _sense_id(F.col("word"), F.col("pos"), s, F.col("sense_idx")).alias("sense_id"),
            "sense_idx", "gloss", "examples", *[F.coalesce(s[c], empty).alias(c) for c in ("tags", "topics", "wikidata")],
            relations(lambda k: s[k]).alias("relations"), embed_text(F.col("gloss"), F.col("examples")).alias("embed_text"),
        )
    )


def label_word() -> Column:
    return F.format_string("%s (%s)", "word", "pos")


def label_sense() -> Column:
    return F.format_string("%s (%s) [%d]", "word", "pos", "sense_idx")
