"""URL filters with an index of rarest literal tokens.

A rule is a regular expression on host and path together with literal tokens that
every match holds.  Each rule is indexed by the one of its tokens that the
fewest URLs have; a URL's tokens fetch candidate rules, and only those run their
expressions.  Everything is column expressions.  A short list of rules is part of the
plan, and the only shuffle is the count of the rules' own tokens.  A long list is a
table that is joined on the tokens of the distinct URLs.  Both give the same rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import hot_keys, lower_ascii, pick, settle, spread_join

#: Rules up to this number are part of the plan; more are a table.
INLINE_RULES = 200
#: Bytes of rules up to which that table is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block; pattern: on host + path; tokens: lower-case
    alphanumeric runs that every match holds as whole runs; base: the host and path
    of a rule that decides by length before all patterns, else None."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    base: str | None = None
    name: str = ""


def host_rule(verdict: str, prefix: str) -> Rule:
    """A rule for a host with all its subdomains and paths that start with a path.

    prefix: like ``example.net/en/``.
    """
    host = prefix.partition("/")[0]
    if not host or "/" not in prefix:
        raise ValueError(f"{prefix!r} is not a host and a path")
    escaped = re.sub(r"([^A-Za-z0-9/])", r"\\\1", prefix)
    path = prefix[len(host) :]
    # A path's last run may go on in a longer URL, so it is no whole token.
    whole = re.findall(r"[a-z0-9]+", host) + re.findall(r"[a-z0-9]+(?=[^A-Za-z0-9])", path.lower())
    return Rule(verdict, rf"^(?:[^/]*\.)?{escaped}", tuple(whole), prefix, prefix)


#: The production rules of the registered query.
BASE_RULES = (
    host_rule("block", "net/"),
    host_rule("allow", "example.net/en/"),
    host_rule("block", "example.com/de/"),
    host_rule("allow", "org/fr/"),
)
PATTERN_RULES = (
    Rule("block", r"^(?:[^/]*[.-])?spam[.-]", ("spam",), name="spam host"),
    Rule("block", r"^(?:[^/]*\.)?(?:[^./]*-)?farm\.", ("farm",), name="link farm"),
    Rule("block", r"^(?:[^/]*\.)?ads[.-]", ("ads",), name="ad host"),
    Rule("block", r"^(?:[^/]*\.)?doubleclick\.", ("doubleclick",), name="ad network"),
    Rule("block", r"^[^/]*/(?:[\s\S]*/)?wp-login\.php(?:/|(?![\s\S]))", ("wp", "login", "php"), name="login page"),
    Rule("block", r"^[^/]*/(?:[\s\S]*/)?cgi-bin/", ("cgi", "bin"), name="script folder"),
    Rule("block", r"^[^/]*/(?:[\s\S]*/)?adult(?:/|(?![\s\S]))", ("adult",), name="adult section"),
    Rule("block", r"^(?:[^/]*\.)?casino[.-]", ("casino",), name="gambling host"),
)


def host(url: Column) -> Column:
    """Host as the contract has it; empty for null and where ``://`` is missing."""
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    rest = _rest(url)
    tail = F.substr(rest, F.length(F.regexp_extract(rest, "^[^/?#]*", 0)) + 1)
    return F.coalesce(F.regexp_extract(tail, "^[^?#]*", 0), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def token_index(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[int]]:
    """Rule numbers by their rarest token, counted over all URLs (column ``norm``).

    Gathers one count for each of the rules' own tokens, of which there are no more
    than the driver was given with the rules.
    """
    own = sorted({t for r in rules for t in r.tokens})
    if any(not r.tokens for r in rules):
        raise ValueError("every rule needs a literal token")
    if len(rules) <= INLINE_RULES:
        known = urls.select(F.explode(F.array_intersect(_tokens(F.col("norm")), F.array(*map(F.lit, own)))).alias("token"))
    else:
        kept = urls.sparkSession.createDataFrame([(t,) for t in own], "token string")
        kept = F.broadcast(kept) if sum(map(len, own)) <= BROADCAST_BYTES else kept
        known = urls.select(F.explode(_tokens(F.col("norm"))).alias("token")).join(kept, "token", "left_semi")
    counted = known.groupBy("token").count().collect()
    count = {r["token"]: r["count"] for r in counted}
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (count.get(t, 0), t)), []).append(i)
    return index


def judge_urls(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", *,
    rules: tuple[Rule, ...] = BASE_RULES + PATTERN_RULES, default: str = "allow",
) -> DataFrame:
    """Verdict on each URL.

    Returns page_id, host, path, rule (the longest fitting base rule, on equal
    length the first by name; else null), verdict, pattern_rules (names of fitting
    patterns, sorted), n_candidates (rules that ran).  A base rule decides; else
    one blocking pattern blocks, else one allowing allows, else ``default`` holds.

    A null URL, or one without ``://``, has an empty host and path and the default
    verdict.  Repeated rows and null ids are judged each; an empty table gives no
    rows.
    """
    urls = pick(df, page_id=id_col, url=url_col).select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    urls = urls.withColumn("norm", F.concat("host", "path"))
    if not rules:
        empty = F.array().cast("array<string>")
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), empty.alias("pattern_rules"), F.lit(0).alias("n_candidates"))
    if len(rules) > INLINE_RULES:
        norms = settle(urls.groupBy("norm").agg(F.count("*").alias("count")))
        ran = _from_table(norms, token_index(norms, rules), rules)
        total = norms.agg(F.sum("count")).first()[0] or 0
        limit = max(64, total // (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        many = norms.where(F.col("count") > limit).select("norm", F.ceil(F.col("count") / limit).cast("int").alias("copies"))
        judged = settle(ran)
        ran = spread_join(urls, judged, ["norm"], F.monotonically_increasing_id(), None if many.isEmpty() else many)
        return _judged(ran, default)
    index = token_index(urls, rules)
    held = F.create_map(*[c for t, at in sorted(index.items()) for c in (F.lit(t), F.array(*[_inline(rules[i]) for i in at]))])
    known = F.array(*[F.lit(t) for t in sorted(index)])
    fetched = F.flatten(F.transform(F.array_intersect(_tokens(F.col("norm")), known), lambda t: F.element_at(held, t)))
    ran = urls.withColumn("candidates", fetched)
    fits = F.filter("candidates", lambda r: F.regexp_like(F.col("norm"), r["pattern"]))
    return _judged(ran.select("page_id", "host", "path", F.size("candidates").alias("n_candidates"), fits.alias("fits")), default)


_RULE = "struct<pattern:string,verdict:string,base:string,order:int,name:string>"


def _values(r: Rule) -> tuple:
    return r.pattern, r.verdict, r.base, -len(r.base or ""), r.name or r.pattern


def _inline(r: Rule) -> Column:
    names = ("pattern", "verdict", "base", "order", "name")
    return F.struct(*[F.lit(v).cast("int" if n == "order" else "string").alias(n) for n, v in zip(names, _values(r), strict=True)])


def _from_table(norms: DataFrame, index: dict[str, list[int]], rules: tuple[Rule, ...]) -> DataFrame:
    """norm, n_candidates and fits of distinct URLs (norm), with the rules as a table."""
    rows = [(t, *_values(rules[i])) for t, at in sorted(index.items()) for i in at]
    listed = norms.sparkSession.createDataFrame(rows, "token string, pattern string, verdict string, base string, order int, name string")
    tokens = norms.select("norm", F.explode(_tokens(F.col("norm"))).alias("token"))
    if sum(len(r.pattern) + len(r.name) + len(r.base or "") + 40 for r in rules) <= BROADCAST_BYTES:
        met = tokens.join(F.broadcast(listed), "token")
    else:
        # Tokens that many URLs have are no rule's rarest as a rule, but some may be.
        kept = settle(tokens.join(listed.select("token").distinct(), "token", "left_semi"))
        met = spread_join(kept, listed, ["token"], F.col("norm"), hot_keys(kept, ["token"], kept.count()))
    one = F.struct("pattern", "verdict", "base", "order", "name").cast(_RULE)
    # A URL's fitting rules are one row; counts and lists combine before the shuffle.
    fit = F.when(F.regexp_like(F.col("norm"), F.col("pattern")), one)
    found = met.groupBy("norm").agg(F.count("*").cast("int").alias("n_candidates"), F.collect_list(fit).alias("fits"))
    none = F.array().cast(f"array<{_RULE}>")
    return norms.select("norm").join(found, "norm", "left").select("norm", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("fits", none).alias("fits"))


def _judged(ran: DataFrame, default: str) -> DataFrame:
    """The verdict by the rules that fit a URL (fits)."""
    base = F.array_sort(
        F.transform(F.filter("fits", lambda r: r["base"].isNotNull()), lambda r: F.struct(r["order"].alias("order"), r["base"].alias("base"), r["verdict"].alias("verdict")))
    )
    best = F.get(base, F.lit(0))
    pattern = F.filter("fits", lambda r: r["base"].isNull())
    blocked = F.exists(pattern, lambda r: r["verdict"] == "block")
    allowed = F.exists(pattern, lambda r: r["verdict"] == "allow")
    verdict = F.coalesce(best["verdict"], F.when(blocked, F.lit("block")).when(allowed, F.lit("allow")), F.lit(default))
    return ran.select(
        "page_id", "host", "path", best["base"].alias("rule"), verdict.alias("verdict"),
        F.array_sort(F.transform(pattern, lambda r: r["name"])).alias("pattern_rules"), "n_candidates",
    )
