"""Personal data by weak supervision, with column expressions alone.

Labelers vote on candidate spans: strict patterns with their validators, a
gazetteer of domains, area codes and issuers, cue words before the span, and what
stands right beside it.  Votes are counted over all documents by pattern of votes,
a table of bounded size, on which expectation-maximisation estimates each
labeler's reliability and the share of true spans of a kind.  The estimates are
soft labels for a logistic classifier on the span's own features and votes, which
decides on spans that the strict patterns leave out.  Strict spans always stay.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import cut, let, pick, pieces, scan

#: Kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")

# Strict patterns.  Each is the contract's expression with possessive parts, and with
# starts only where a run of its first class begins or the last match ended: a run that
# fails from its begin fails from everywhere in it, so matches are the same while long
# runs take linear time.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Loose patterns: what else may be personal data of a kind.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,63}+){1,4}+",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
# A text without one of these has no match of the pattern; a cheap scan.
HINT = {"email": "@", "phone": "+"}
HINT_PATTERN = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}"}
LOOSE_HINT = {"email": r"(?:\(at\)|\[at\]| at )[^@]{0,80}(?:\(dot\)|\[dot\]| dot )", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}[._/][0-9]{4}", "phone": r"[0-9]{3}[ .-][0-9]{4}"}
# Gazetteer: domains' last labels, issuers' first digits, areas, and first parts of addresses.
GAZETTEER = {
    "email": r"(?i)[. ](?:com|org|net|edu|gov|info|biz|io|co|uk|de|fr|es|it|nl|eu|us|ca|au)$",
    "ip": r"^(?!0\.|127\.|2[4-9][0-9]\.)[0-9]{1,3}\.|^(?i)(?:2[0-9a-f]{3}|fd[0-9a-f]{2}|fe80):",
    "card": r"^(?:4|5[1-5]|3[47]|6011|65|2[2-7])",
    "phone": r"^\+(?:1|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])(?![0-9]{12})|^\(?[2-9][0-9]{2}",
}
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|kontakt|correo|courriel|write|an|to|from)\W*$",
    "ip": r"(?i)(?:ip|host|server|address|adresse|client|login|from)\W*$",
    "card": r"(?i)(?:card|karte|carte|tarjeta|visa|mastercard|credit|payment|no|nr)\W*$",
    "phone": r"(?i)(?:phone|tel|telefon|t[ée]l[ée]phone|tel[ée]fono|call|fax|mobile|handy)\W*$",
}
#: Characters before a span in which a cue is looked for.
CONTEXT = 24
ABSTAIN = -1


@dataclass(frozen=True)
class Settings:
    rounds: int = 40
    steps: int = 300
    threshold: float = 0.9
    prior: float = 0.5
    #: Weight, in spans, of the belief that a labeler is right four times in five.
    smoothing: float = 4.0


def _located(text: Column, pattern: str) -> Column:
    """(start, end, match) of a pattern's matches, in code points.

    The pieces between matches and the matches take turns, so that running sums
    of their lengths are the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), found.alias("match"))

    def add(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + x["gap"]
        end = begin + F.length(x["match"])
        return end, F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("match"))

    return scan(F.filter(steps, lambda x: x["match"].isNotNull()), F.lit(0), add, "struct<start:int,end:int,match:string>")


_NONE = "array<struct<start:int,end:int,match:string>>"


def _luhn(digits: Column) -> Column:
    at = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2))
    return F.aggregate(at, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    """The validator of a strict match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(10, 15)


def base_spans(text: Column, kind: str) -> Column:
    """Strict spans of a kind: array of (start, end, match)."""
    hint = F.contains(text, F.lit(HINT[kind])) if kind in HINT else text.rlike(HINT_PATTERN[kind])
    found = F.filter(_located(text, STRICT[kind]), lambda x: _holds(kind, x["match"]))
    return F.when(hint, found).otherwise(F.array().cast(_NONE))


def loose_spans(text: Column, kind: str) -> Column:
    return F.when(text.rlike(LOOSE_HINT[kind]), _located(text, LOOSE[kind])).otherwise(F.array().cast(_NONE))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(ABSTAIN)


#: Labelers, in the order of a vote pattern.
LABELERS = ("strict", "gazetteer", "context", "beside")
FEATURES = ("separated", "digits", "long", "obfuscated")


def _judged(parts: Column, kind: str, span: Column, strict: bool) -> Column:
    """A candidate with its votes and features; parts: the text's pieces."""
    before = cut(parts, span["start"] - CONTEXT, span["start"])
    beside = before.rlike(r"[\p{L}\p{N}]$") | cut(parts, span["end"], span["end"] + 1).rlike(r"[\p{L}\p{N}]")
    m = span["match"]
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("place"), span["start"].alias("start"), span["end"].alias("end"),
        F.lit(1 if strict else 0).alias("strict"),
        _vote(m.rlike(GAZETTEER[kind]), F.lit(True)).alias("gazetteer"),
        _vote(before.rlike(CUES[kind]), F.lit(False)).alias("context"),
        _vote(F.lit(False), beside).alias("beside"),
        m.rlike(r"[ ()./_-]").cast("int").alias("separated"),
        m.rlike(r"(?:[^0-9]*[0-9]){10}").cast("int").alias("digits"),
        (F.length(m) >= 16).cast("int").alias("long"),
        m.rlike(r"(?i)[\[( ](?:at|dot)[\]) ]").cast("int").alias("obfuscated"),
    )


def candidates(text: Column) -> Column:
    """All candidates of a text: strict spans and loose ones, with their votes."""

    spans = [(k, base_spans(text, k), True) for k in KINDS] + [(k, loose_spans(text, k), False) for k in KINDS]
    found = F.struct(*[x.alias(f"s{i}") for i, (_, x, _) in enumerate(spans)])
    any_found = lambda f: functools.reduce(lambda a, b: a | b, [F.size(f[f"s{i}"]) > 0 for i in range(len(spans))])

    def judged(f: Column, parts: Column) -> Column:
        def of(i: int) -> Column:
            kind, _, strict = spans[i]
            return F.transform(f[f"s{i}"], lambda x: _judged(parts, kind, x, strict))

        return F.concat(*[of(i) for i in range(len(spans))])

    none = F.array().cast("array<string>")
    return let(found, lambda f: let(F.when(any_found(f), pieces(text)).otherwise(none), lambda parts: judged(f, parts)))


@dataclass(frozen=True)
class Fitted:
    """What training found: P(vote | class) by labeler, shares by kind, the classifier."""

    reliability: dict[str, dict[int, dict[int, float]]]
    share: dict[str, float]
    weights: dict[str, float]

    def score(self, c: Callable[[str], Column]) -> Column:
        """The classifier as an expression on a candidate's fields."""
        z: Column = F.lit(self.weights["bias"])
        for name, w in self.weights.items():
            if "=" in name:
                field, _, value = name.partition("=")
                z = z + F.when(c(field) == (value if field == "kind" else int(value)), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _names(row: dict) -> list[str]:
    out = ["bias", f"kind={row['kind']}"]
    out += [f"{x}={row[x]}" for x in LABELERS[1:] if row[x] != ABSTAIN]
    return out + [f"{f}=1" for f in FEATURES if row[f]]


def fit(patterns: list[dict], s: Settings) -> Fitted:
    """patterns: kind, votes, features and ``n``, the count of spans with them.

    Candidates' classes are hidden; votes are independent given the class.
    """
    table = {x: {y: {v: 0.0 for v in (ABSTAIN, 0, 1)} for y in (0, 1)} for x in LABELERS}
    for x in LABELERS:
        for y in (0, 1):
            table[x][y] = {ABSTAIN: 0.3, y: 0.56, 1 - y: 0.14}
    share = {k: s.prior for k in KINDS}
    belief = [0.5] * len(patterns)
    for _ in range(s.rounds):
        for i, r in enumerate(patterns):
            p = [1 - share[r["kind"]], share[r["kind"]]]
            for x in LABELERS:
                for y in (0, 1):
                    p[y] *= table[x][y][r[x]]
            belief[i] = p[1] / (p[0] + p[1])
        for k in KINDS:
            own = [(r["n"], b) for r, b in zip(patterns, belief, strict=True) if r["kind"] == k]
            share[k] = (sum(n * b for n, b in own) + s.prior) / (sum(n for n, _ in own) + 1)
        for x in LABELERS:
            for y in (0, 1):
                total = {ABSTAIN: 0.3 * s.smoothing, y: 0.56 * s.smoothing, 1 - y: 0.14 * s.smoothing}
                for r, b in zip(patterns, belief, strict=True):
                    total[r[x]] += r["n"] * (b if y else 1 - b)
                table[x][y] = {v: c / sum(total.values()) for v, c in total.items()}
    # The classifier sees votes and features, not whether the span is strict.
    weights: dict[str, float] = {"bias": 0.0}
    squares: dict[str, float] = {}
    whole = sum(r["n"] for r in patterns) or 1
    for _ in range(s.steps):
        slope: dict[str, float] = {}
        for r, b in zip(patterns, belief, strict=True):
            names = _names(r)
            z = sum(weights.get(n, 0.0) for n in names)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            for n in names:
                slope[n] = slope.get(n, 0.0) + (p - b) * r["n"] / whole
        for n, g in slope.items():
            g += 1e-3 * weights.get(n, 0.0)
            squares[n] = squares.get(n, 1e-12) + g * g
            weights[n] = weights.get(n, 0.0) - 0.3 * g / math.sqrt(squares[n])
    return Fitted(table, share, weights)


def train(docs: DataFrame, s: Settings) -> Fitted:
    """Count vote and feature patterns over all documents; gather only the counts.

    There are at most 4 kinds x 3^4 votes x 2^4 features of them.
    """
    fields = ["kind", *LABELERS, *FEATURES]
    rows = (
        docs.select(F.explode(candidates(F.col("text"))).alias("c")).select("c.*")
        .groupBy(*fields).agg(F.count("*").alias("n")).orderBy(*fields).collect()
    )
    return fit([r.asDict() for r in rows], s)


def find_pii(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, settings: Settings = Settings(), keep: tuple[str, ...] = ()
) -> DataFrame:
    """Spans of personal data in whole texts.

    Returns doc_id, text, spans (array of start, place, kind, end, strict, score:
    by start, then kind; code points, end exclusive) and the columns in ``keep``.
    Strict spans have score 1; those of different kinds may overlap.  Added spans reach
    the threshold and meet no strict span and no added one before them.

    Null and empty texts have no spans; a null text stays null.  Repeated rows and
    null ids are kept; an empty table gives no rows.
    """
    docs = pick(df, doc_id=id_col, text=text_col, **{k: k for k in keep})
    fitted = train(docs.select("text"), settings)
    found = docs.withColumn("all", candidates(F.coalesce("text", F.lit(""))))

    def span(c: Column) -> Column:
        score = F.when(c["strict"] == 1, F.lit(1.0)).otherwise(fitted.score(lambda f: c[f]))
        return F.struct(c["start"].alias("start"), c["place"].alias("place"), c["kind"].alias("kind"), c["end"].alias("end"), c["strict"].alias("strict"), score.alias("score"))

    scored = F.filter(F.transform("all", span), lambda c: (c["strict"] == 1) | (c["score"] >= settings.threshold))
    return found.select("doc_id", "text", _apart(F.array_sort(scored)).alias("spans"), *keep)


_SPAN = "struct<start:int,place:int,kind:string,end:int,strict:int,score:double>"


def _apart(spans: Column) -> Column:
    """Sorted spans without added ones that meet a strict span, or a kept added one before.

    One way back notes the strict span that begins next, one way forth the end of what
    is kept so far; nothing is compared with everything.
    """
    far = F.lit(2147483647)

    def back(ahead: Column, c: Column) -> tuple[Column, Column]:
        return F.when(c["strict"] == 1, c["start"]).otherwise(ahead), F.struct(c.alias("c"), ahead.alias("ahead"))

    def forth(ends: Column, x: Column) -> tuple[Column, Column]:
        c = x["c"]
        strict = c["strict"] == 1
        kept = strict | ((c["start"] >= ends) & (c["end"] <= x["ahead"]))
        # A strict span at the same start sorts by kind, so it may stand before or behind.
        return F.when(kept, F.greatest(ends, c["end"])).otherwise(ends), F.struct(c.alias("c"), kept.alias("kept"))

    noted = F.reverse(scan(F.reverse(spans), far, back, f"struct<c:{_SPAN},ahead:int>"))
    judged = scan(noted, F.lit(0), forth, f"struct<c:{_SPAN},kept:boolean>")
    only = F.transform(F.filter(judged, lambda x: x["kept"]), lambda x: x["c"])
    return F.when(F.exists(spans, lambda c: c["strict"] == 0), only).otherwise(spans)


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda c: c["kind"] == kind)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, as its first kind's name in brackets."""

    def made(parts: Column) -> Column:
        def add(at: Column, c: Column) -> tuple[Column, Column]:
            tag = F.concat(F.lit("["), F.upper(c["kind"]), F.lit("]"))
            shown = F.concat(cut(parts, at, c["start"]), tag)
            return F.greatest(at, c["end"]), F.when(c["start"] >= at, shown).otherwise(F.lit(""))

        last = F.aggregate(spans, F.lit(0), lambda at, c: F.greatest(at, c["end"]))
        return F.concat(F.array_join(scan(spans, F.lit(0), add, "string"), ""), cut(parts, last, F.length(text)))

    return F.when(F.size(spans) > 0, let(pieces(text), made)).otherwise(text)
