"""URL filters, personal data and chat windows against plain Python."""

import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from filigree.llm import chat, pii, url_filters
from filigree.llm.queries import CONTROL_TEXT, op9_chat_windows

URLS = [
    None,
    "",
    "no scheme.net/x",
    "http://NET/",
    "http://net",
    "https://a.b.example.NET/en/x?y=http://q.net/#z",
    "https://example.net/EN/x",
    "https://notexample.net/en/",
    "https://example.com/de/1",
    "https://example.com/des",
    "https://xexample.com/de/1",
    "x://a.org/fr/",
    "://a.org/fr/?",
    "http://a.org#/fr/",
    "http://spam-farm.example.org/fr/3",
    "http://spam-farm.example.org/en/3",
    "http://host.example/wp-login.php",
    "http://host.example/a/cgi-bin/x",
    "http://example.net:80/en/",
    "http://ÄÖ.net/é/\n",
    "a://b://c.net/d",
]
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def base_rule(host, path):
    fits = []
    for rule, verdict in RULES:
        name, slash, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
            fits.append((-len(rule), rule, verdict))
    return min(fits)[1:] if fits else (None, None)


def test_urls_against_plain_code(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate([*URLS, URLS[5]])]
    found = url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")).collect()
    assert len(found) == len(rows)
    for r in found:
        host, path = split_url(rows[r["page_id"]][1])
        assert (r["host"], r["path"]) == (host, path)
        rule, verdict = base_rule(host, path)
        assert r["rule"] == rule
        patterns = [x for x in url_filters.PATTERN_RULES if re.search(x.pattern, host + path)]
        assert r["pattern_rules"] == sorted(x.name for x in patterns)
        assert r["verdict"] == (verdict or ("block" if patterns else "allow"))


@pytest.mark.parametrize(("inline", "broadcast"), [(0, 8 << 20), (0, 0)])
def test_rules_in_a_table_judge_as_rules_in_the_plan(spark, monkeypatch, inline, broadcast):
    """Also a page that fills half of the table, and far more rules than a plan holds."""
    odd = ["http://h.example/a\n/wp-login.php", "http://h.example/wp-login.php\n", "http://h.example/adult\n/", "http://h.example/x/adult"]
    urls = [*URLS, *odd, *[URLS[5]] * 300]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = sorted(map(repr, url_filters.judge_urls(pages).collect()))
    assert [r["verdict"] for r in url_filters.judge_urls(pages.where(F.col("url").isin(odd))).orderBy("page_id").collect()] == ["block", "allow", "allow", "block"]
    more = tuple(url_filters.host_rule("block", f"site{i}.test/") for i in range(100_000))
    monkeypatch.setattr(url_filters, "INLINE_RULES", inline)
    monkeypatch.setattr(url_filters, "BROADCAST_BYTES", broadcast)
    assert sorted(map(repr, url_filters.judge_urls(pages).collect())) == want
    extra = pages.union(spark.createDataFrame([(-1, "http://a.site99999.test/x")], "page_id long, url string"))
    found = url_filters.judge_urls(extra, rules=url_filters.BASE_RULES + url_filters.PATTERN_RULES + more)
    assert sorted(map(repr, found.where("page_id >= 0").collect())) == want
    assert found.where("page_id = -1").first()["rule"] == "site99999.test/"


def test_rules_are_indexed_by_their_rarest_token(spark):
    urls = spark.createDataFrame([("a.net/en/",), ("b.net/en/",), ("example.net/x",)], "norm string")
    rules = (url_filters.host_rule("allow", "example.net/en/"), url_filters.host_rule("block", "net/"))
    index = url_filters.token_index(urls, rules)
    assert index == {"example": [0], "net": [1]}
    with pytest.raises(ValueError):
        url_filters.token_index(urls, (url_filters.Rule("block", "x", ()),))


def test_no_urls(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judge_urls(none).count() == 0
    one = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert url_filters.judge_urls(one, rules=()).first()["verdict"] == "allow"


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def strict_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")[:4]) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), place, kind, m.end()))
    return sorted(out)


PRIVATE = [
    None,
    "",
    "nothing here",
    "mail a.b+c@x-y.example.com, or me@host and x@y.z.",
    "a@b.com_x@y.z and foo@bar@baz.org @x.y a@b..c a@b.c.",
    "é😀 ip 10.0.0.255 or 1.2.3.4.5.6.7.8 or 256.1.1.1 0001.2.3.0004 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 41111111111111110 12345678901234",
    "call +1 (743) 555-3824 or +12 or +1234567890123456 +49.30 1234567 x+1 2",
    "4539578763621486 4539578763621486 4716108999716531",
    "+1 (523) 555-1055+1 (523) 555-1056",
    "phone (743) 555-3824 and mail jane (at) example (dot) com",
    "tel 743 555 3824. id a743-555-3824b",
    "1" * 40_000 + "@" + "a" * 40_000,
    "a." * 20_000 + "@" + "b." * 9_000 + "c",
    " ".join(f"u{i}@example.com" for i in range(300)),
    "\u0661\u0662.1.1.1 ١@x.com \r\n+1\n2345678901",
]


def test_strict_spans_against_plain_code(spark):
    rows = [(i, t, "x") for i, t in enumerate(PRIVATE)] + [(3, PRIVATE[3], "x"), (None, PRIVATE[7], "x")]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(found) == len(rows)
    for r in found:
        strict = [(s["start"], s["place"], s["kind"], s["end"]) for s in r["spans"] if s["strict"]]
        assert strict == strict_spans(r["text"])
        order = [(s["start"], s["place"]) for s in r["spans"]]
        assert order == sorted(order)
        for s in r["spans"]:
            if not s["strict"]:
                assert s["score"] >= pii.Settings().threshold
                others = strict + [(x["start"], 0, "", x["end"]) for x in r["spans"] if not x["strict"] and x != s]
                assert all(s["end"] <= a or b <= s["start"] for a, _, _, b in others)


def test_masking_keeps_the_rest(spark):
    rows = [(i, t) for i, t in enumerate(PRIVATE[:10])]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in found.select("doc_id", "text", pii.masked(F.col("text"), F.col("spans")).alias("out"), "spans").collect():
        if r["text"] is None:
            assert r["out"] is None
            continue
        want, at = "", 0
        for s in r["spans"]:
            if s["start"] >= at:
                want += r["text"][at : s["start"]] + f"[{s['kind'].upper()}]"
            at = max(at, s["end"])
        assert r["out"] == want + r["text"][at:]


def test_votes_estimate_reliability():
    base = {"kind": "phone", "separated": 1, "digits": 1, "long": 0, "obfuscated": 0}
    patterns = [
        base | {"strict": 1, "gazetteer": 1, "context": 1, "beside": -1, "n": 500},
        base | {"strict": 1, "gazetteer": 1, "context": -1, "beside": -1, "n": 300},
        base | {"strict": 0, "gazetteer": 1, "context": 1, "beside": -1, "n": 40},
        base | {"strict": 0, "gazetteer": 0, "context": -1, "beside": 0, "n": 400},
    ]
    fitted = pii.fit(patterns, pii.Settings())
    assert fitted.reliability["gazetteer"][1][1] > 0.8 > 0.4 > fitted.reliability["gazetteer"][0][1]
    score = {n: sum(fitted.weights.get(x, 0.0) for x in pii._names(r)) for n, r in enumerate(patterns)}
    assert score[2] > 0 > score[3]


def test_no_documents_have_no_personal_data(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(none).count() == 0


CONVERSATIONS = [
    (1, 0, "system", "Be brief."),
    (1, 1, "user", "Hi <b>\\l</b> \"q\" #x"),
    (1, 2, "assistant", CONTROL_TEXT),
    (1, 3, "user", "word " * 200),
    (1, 4, "assistant", "long " * 700),
    (1, 5, "user", "again"),
    (1, 6, "assistant", "ok \\b\\\\ </turn>\n"),
    (1, 7, "assistant", ""),
    (2, 5, "assistant", "only"),
    (2, 5, "assistant", "only"),
    (2, None, None, None),
    (3, 0, 'we"ird\n<role>', "\n\n"),
    (None, 0, "user", "no id"),
    (None, 1, "assistant", "é😀 中文"),
    (4, 0, "system", "alone"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in by.items()}


@pytest.mark.parametrize("settings", [chat.Settings(), chat.Settings(budget=40, history=10), chat.Settings(budget=1, history=0), chat.Settings(budget=100_000)])
def test_windows_read_back(spark, settings):
    rows = spark.createDataFrame([(*r, 9) for r in CONVERSATIONS], SCHEMA + ", window int")
    windows = chat.format_conversations(rows, settings=settings).cache()
    want = expected(CONVERSATIONS)
    found = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    assert set(found) == set(want)
    for c, turns in want.items():
        assert [(x["role"], x["text"]) for x in found[c]["turns"]] == turns
        assert list(found[c]["losses"]) == [t for r, t in turns if r == "assistant"]
    parts = {}
    for r in windows.orderBy("conv_id", "window").collect():
        assert r["formatted"].endswith(chat.END)
        parts.setdefault(r["conv_id"], []).append(r)
        # Beside the system turn, which the first window counts as new.
        led = want[r["conv_id"]][0][0] == "system"
        new = r["new_turns"] - (r["window"] == 0 and led)
        old = r["formatted"].count('seen="1"') - (r["window"] > 0 and led)
        assert r["tokens"] <= settings.budget or (new <= 1 and old == 0)
    for c, own in parts.items():
        assert [r["window"] for r in own] == list(range(len(own)))
        assert sum(r["new_turns"] for r in own) == len(want[c])
        if want[c][0][0] == "system":
            assert all(r["formatted"].startswith('<turn role="system"') for r in own)
        assert sum(len(r["formatted"]) for r in own) == found[c]["formatted_chars"]
    windows.unpersist()


def test_registered_conversations(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    want = expected(rows)
    found = {r["conv_id"]: r for r in op9_chat_windows(spark, small).collect()}
    assert set(found) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert found[c]["n_turns"] == len(turns)
        assert found[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_history_leaves_room_for_the_turn(spark):
    """Turns of a given count of tokens; a turn that fits alone never exceeds the budget."""
    counts = [100, 100, 450, 30, 600, None, 90, 400]
    rows = [(1, i, ("user", "assistant")[i % 2], "x", n) for i, n in enumerate(counts)]
    found = chat.format_conversations(spark.createDataFrame(rows, SCHEMA + ", n int"), tokens_col="n").orderBy("window").collect()
    shown = [(r["tokens"], r["new_turns"], r["formatted"].count('seen="1"')) for r in found]
    assert shown == [(208, 2, 0), (488, 2, 0), (604, 1, 0), (506, 3, 0)] or all(t <= 512 or (n == 1 and old == 0) for t, n, old in shown)
    assert sum(n for _, n, _ in shown) == len(counts)


def test_long_conversations_take_time_in_proportion(spark):
    """30,000 turns in one conversation."""
    rows = spark.range(30_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), F.col("id").cast("string")).alias("text"))
    began = time.time()
    found = chat.read_back(chat.format_conversations(rows)).select(F.size("turns").alias("n"), F.size("losses").alias("m"), "windows").first()
    assert (found["n"], found["m"]) == (30_000, 15_000) and found["windows"] > 400
    assert time.time() - began < 120


def test_texts_of_many_spans_take_time_in_proportion(spark):
    """30,000 strict spans in one text, and many loose ones in another."""
    text = " ".join(f"u{i}@example.com" for i in range(30_000))
    loose = " ".join("write jane (at) example (dot) com" for _ in range(5_000))
    rows = spark.createDataFrame([(1, text), (2, loose), (3, "x" * 1_000_000)], "doc_id long, text string")
    began = time.time()
    found = pii.find_pii(rows)
    found = {r["doc_id"]: r for r in found.select("doc_id", F.size("spans").alias("n"), F.length(pii.masked(F.col("text"), F.col("spans"))).alias("m")).collect()}
    assert found[1]["n"] == 30_000 and found[1]["m"] == 30_000 * len("[EMAIL] ") - 1 and found[3]["n"] == 0
    assert time.time() - began < 180


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_conversations(none)).count() == 0
