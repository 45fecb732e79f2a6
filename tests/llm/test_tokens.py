"""Token counts, packing and BPE against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from filigree.llm import bpe, packing, token_counts
from filigree.llm.common import byte_level, tokenizer_path

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
TEXTS = [
    None,
    "",
    " ",
    "\n\n \t x",
    "Hello world, it's 2024!  Two  spaces.\n\nNew\r\nline '",
    "déjà vu ÀÉ ñandú Straße don't we'll I'M",
    "中文字符 и кириллица ΣΑΣ İstanbul ﬁne ½ ² ª µ     ́á",
    "<|endoftext|> a<|startoftext|>b <|endoftext",
    "emoji 👩‍👩‍👧 and \x1c\x85 controls \u0000 end",
    "x" * 5000,
    "ab" * 700 + " " * 300 + "1234567890" * 30,
    "word " * 3000,
]


def frame(spark, texts=TEXTS):
    rows = [(i, t, "extra", 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start double")


def ids_of(text, path=BYTES):
    tok = Tokenizer.from_file(path)
    return tok.encode(text or "", add_special_tokens=False).ids


def test_fast_encoder_equals_the_library(spark, small):
    texts = [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").limit(60).collect()]
    encode = byte_level(BYTES)
    for t in TEXTS + texts:
        ids = encode(t or "")
        assert ids.tolist() == ids_of(t)
        assert encode.lengths[ids].sum() == len((t or "").encode())


def test_bpe_round_trip_equals_the_library(spark, small):
    docs = frame(spark)
    more = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "'' as ids", "1.0d as start").limit(60)
    rows = docs.unionByName(more)
    tok = Tokenizer.from_file(WORDS)
    found = {r["doc_id"]: r for r in bpe.bpe_round_trip(rows, tokenizer=WORDS).collect()}
    for r in rows.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        got = found[r["doc_id"]]
        assert np.frombuffer(got["ids"], "<u4").tolist() == ids
        assert got["n_tokens"] == len(ids)
        assert got["decoded"] == tok.decode(ids, skip_special_tokens=False)


def test_merge_takes_the_leftmost_lowest_rank():
    # 1 1 1 -> (1 1) 1, then pair (2, 1)
    ranks = {1 << 32 | 1: (0, 2), 2 << 32 | 1: (1, 3)}
    assert bpe.merge([1, 1, 1], ranks) == [3]
    assert bpe.merge([1, 1, 1, 1], ranks) == [2, 2]
    rng = np.random.default_rng(0)
    for _ in range(300):
        table, new = {}, 10
        for a, b in rng.integers(0, 6, (12, 2)):
            if int(a) << 32 | int(b) not in table:
                table[int(a) << 32 | int(b)] = (len(table), new if rng.random() < 0.5 else int(rng.integers(0, 6)))
                new += 1
        symbols = rng.integers(0, 6, int(rng.integers(1, 30))).tolist()
        want = symbols[:]
        while True:
            best = min(((table[a << 32 | b][0], i) for i, (a, b) in enumerate(zip(want, want[1:])) if a << 32 | b in table), default=None)
            if best is None:
                break
            i = best[1]
            want[i : i + 2] = [table[want[i] << 32 | want[i + 1]][1]]
        assert bpe.merge(symbols, table) == want


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_equals_brute_force(spark, rule):
    docs = frame(spark, [*TEXTS, "a\nb\n", "in\nterna\ntional\nisation", "中\n文字\n符"])
    found = {}
    for r in token_counts.token_counts(docs, tokenizer=BYTES, rule=rule, separator="\n").orderBy("doc_id", "section").collect():
        found.setdefault(r["doc_id"], []).append(r)
    encode = byte_level(BYTES)
    for r in docs.collect():
        text = r["text"] or ""
        pieces = text.splitlines(keepends=True) if "\r" not in text and "\x1c" not in text and "\x85" not in text else None
        got = found[r["doc_id"]]
        ids = ids_of(text)
        assert sum(x["n_tokens"] for x in got) == len(ids)
        assert sum(x["n_chars"] for x in got) == len(text)
        if pieces is None:
            continue
        bounds = np.cumsum([0, *(len(p.encode()) for p in pieces or [""])])
        want, at = [0] * (len(bounds) - 1), 0
        for i in ids:
            size = int(encode.lengths[i])
            share = [min(at + size, b) - max(at, a) for a, b in zip(bounds[:-1], bounds[1:])]
            k = next(j for j, x in enumerate(share) if x > 0) if rule == "start" else share.index(max(share))
            want[k] += 1
            at += size
        assert [x["n_tokens"] for x in got] == want


def test_attribution_refuses_unknown_rules(spark):
    with pytest.raises(ValueError):
        token_counts.token_counts(frame(spark), tokenizer=BYTES, rule="half")


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 64), packing.Limits(128, 100, 50), packing.Limits(1, 1, 1)])
def test_packing_is_exact(spark, small, limits):
    texts = TEXTS[:9] + ["word " * 200, "word " * 200] if limits.tokens < 64 else TEXTS
    docs = frame(spark, texts)
    rows = packing.pack_documents(docs, tokenizer=BYTES, limits=limits, block_items=7).collect()
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
        assert r["length"] * 4 == len(r["ids"]) and r["length"] > 0
    for i, t in enumerate(texts):
        want = np.array([*ids_of(t), 0], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want)
            assert r["ids"] == want[at : at + r["length"]].tobytes()
            at += r["length"]
        assert at == len(want)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits.tokens and len(own) <= limits.segments
        loss = sum(r["length"] - (r["start"] + r["length"] == r["doc_tokens"]) for r in own)
        assert loss <= limits.loss
        assert {r["sequence_tokens"] for r in own} == {at}
        assert {r["padded_to"] for r in own} == {at if at & (at - 1) == 0 else limits.tokens}


def test_packing_pads_little(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").coalesce(1)
    rows = packing.pack_documents(docs, tokenizer=BYTES).select("sequence_id", "sequence_tokens", "padded_to").distinct().collect()
    used, whole = sum(r[1] for r in rows), sum(r[2] for r in rows)
    assert whole - used < 1024 + 0.01 * whole


@pytest.mark.parametrize(("tiny", "long"), [(1900, 148), (500, 1500), (64, 3)])
def test_tiny_examples_leave_room_to_long_ones(tiny, long):
    """Where the segments run out, the last one is cut to fill the sequence."""
    rng = random.Random(tiny)
    demand = [(5, 4)] * tiny + [(rng.randrange(300, 1024), 290) for _ in range(long)]
    limits = packing.Limits()
    used, segments, seen = {}, {}, {}
    for item, start, n, sequence in packing.place(np.array(demand, np.int64), limits):
        assert n > 0 and start == seen.get(item, 0)
        seen[item] = start + n
        used[sequence] = used.get(sequence, 0) + n
        segments[sequence] = segments.get(sequence, 0) + 1
    assert seen == {i: n for i, (n, _) in enumerate(demand)}
    assert max(used.values()) <= limits.tokens and max(segments.values()) <= limits.segments
    padded = sum(limits.tokens - n for n in used.values() if n & (n - 1))
    # What is left when all long ones are used up has no more than the limit of tiny ones.
    rest = sum(n == 5 * limits.segments for n in used.values())
    assert padded <= limits.tokens * (1 + rest) + 0.01 * sum(used.values())
    assert rest <= max(0, tiny // limits.segments - sum(n for n, _ in demand[tiny:]) // (limits.tokens - 5 * limits.segments) + 1)


def test_empty_tables_and_repeated_rows(spark):
    none = frame(spark, []).limit(0)
    assert packing.pack_documents(none, tokenizer=BYTES).count() == 0
    assert bpe.bpe_round_trip(none, tokenizer=WORDS).count() == 0
    assert token_counts.token_counts(none, tokenizer=BYTES).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert bpe.bpe_round_trip(twice, tokenizer=WORDS).count() == 3
    assert sum(r["length"] for r in packing.pack_documents(twice, tokenizer=BYTES).collect()) == 8
    assert token_counts.token_counts(twice, tokenizer=BYTES).count() == 3


def test_registered_digests(spark, small):
    from filigree.llm.queries import op4_packing, op8_bpe_round_trip

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    tok = Tokenizer.from_file(WORDS)
    for r in op8_bpe_round_trip(spark, small).limit(40).collect():
        ids = tok.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in op4_packing(spark, small).limit(40).collect():
        ids = np.array([*ids_of(docs[r["doc_id"]]), 0], "<u4")[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
