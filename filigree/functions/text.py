"""Scalar functions on strings and relation lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filigree.settings import Settings


def present(c: Column) -> Column:
    """The string, or null if it is empty."""
    return F.when(F.length(c) > 0, c)


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def texts(items: Column, field: str) -> Column:
    """Non-empty strings of one field of an array of structs, in order."""
    return F.coalesce(F.filter(F.transform(items, lambda x: x[field]), lambda t: F.length(t) > 0), F.array().cast("array<string>"))


def parse_dis1(c: Column) -> Column:
    """Integers of a list that white space separates; a bad item is 0, null is empty."""
    parts = F.filter(F.split(c, r"\s+"), lambda t: t != "")
    return F.coalesce(F.transform(parts, lambda t: F.coalesce(t.try_cast("int"), F.lit(0))), F.array().cast("array<int>"))


def first_argmax(a: Column) -> Column:
    """Index from 0 of the first largest item; null for an empty array."""
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)).cast("int") - 1)


def assign_sense(weights: Column, cosines: Column, threshold: float = Settings.disambig_threshold) -> Column:
    """Sense index: the largest weight if one is positive, else the nearest sense.

    cosines: similarity to each sense, null where no word is given.  The nearest
    sense has to reach the threshold; otherwise null.
    """
    by_weight = F.when(F.exists(weights, lambda x: x > 0), first_argmax(weights))
    near = F.when((F.size(cosines) > 0) & (F.array_max(cosines) >= threshold), first_argmax(cosines))
    return F.coalesce(by_weight, near)


def neighbourhood(word: Column, antonyms: Column, synonyms: Column) -> Column:
    """``word (antonyms: a, b; synonyms: c)``, or the bare word without any."""

    def part(name: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"{name}: "), F.array_join(items, ", ")))

    inner = F.concat_ws("; ", part("antonyms", antonyms), part("synonyms", synonyms))
    return F.when(inner != "", F.concat(word, F.lit(" ("), inner, F.lit(")"))).otherwise(word)


def type_text(word_a: Column, ant_a: Column, syn_a: Column, word_b: Column, ant_b: Column, syn_b: Column) -> Column:
    return F.concat(neighbourhood(word_a, ant_a, syn_a), F.lit("; "), neighbourhood(word_b, ant_b, syn_b))


def embed_text(gloss: Column, examples: Column) -> Column:
    """Gloss and the first two examples."""
    return stripped(F.concat_ws(" ", gloss, F.array_join(F.slice(examples, 1, 2), " ")))


def is_object_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{24}$"), F.lit(False))


def clipped(c: Column, n: int) -> Column:
    """The first n characters, or null if there are none."""
    return present(F.substring(c, 1, n))
