"""Toxicity, media and the pipeline."""

import gzip
import hashlib
import random
import struct
import time
import zipfile
import zlib
from io import BytesIO

import pytest

from filigree.llm import media, toxicity
from filigree.llm.queries import op7_toxicity, op10_media


def png():
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04cdxyz\xff\xd9"
PDF = b"%PDF-1.4\nstartxref\n0\n%%EOF"
BMP = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + b"\0" * 40


def zipped():
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "text")
    return out.getvalue()


def test_formats_are_confirmed():
    for blob, kind in ((png(), "image/png"), (GIF, "image/gif"), (JPEG, "image/jpeg"), (PDF, "application/pdf"), (BMP, "image/bmp"), (zipped(), "application/zip"), (gzip.compress(b"abc"), "application/gzip"), (media.wav(b"abc"), "audio/wav"), (media.wav(b""), "audio/wav")):
        assert media.sniff(blob)[0] == (0, len(blob), kind)
        assert all(at for at, _, _ in media.sniff(b"junk" + blob + b"tail"))
        assert (4, kind) in [(at, k) for at, _, k in media.sniff(b"junk" + blob)]
        cut = [x for x in media.sniff(blob[: len(blob) // 2]) if x[0] == 0]
        assert not cut


def test_random_bytes_do_not_fail():
    rng = random.Random(1)
    magics = list(media.MAGIC)
    for _ in range(400):
        blob = rng.choice(magics) + rng.randbytes(rng.randrange(60))
        for at, size, _ in media.sniff(blob):
            assert 0 < size <= len(blob) - at


def test_many_magics_take_time_in_proportion():
    """A blob of nothing but one format's magic, with and without an end that fits; both are quick."""
    began = time.time()
    for magic, kind in media.MAGIC.items():
        assert media.sniff(magic * (4_000_000 // len(magic))) == []
    whole = b"%PDF-" * 800_000 + b"startxref\n0\n%%EOF"
    assert media.sniff(whole) == [(0, len(whole), "application/pdf")]
    assert media.sniff(b"x" + zipped() + b"%PDF-" * 5 + PDF)[0] == (1, len(zipped()), "application/zip")
    assert time.time() - began < 120


def test_embedded_media_are_carved_and_types_corrected(spark):
    rows = [(1, "image/png", b"xx" + GIF + b"yy" + png(), "k"), (2, "IMAGE/GIF; q=1", GIF, "k"), (3, None, None, "k"), (4, "audio/wav", png(), "k"), (None, "text/plain", b"", "k"), (2, "IMAGE/GIF; q=1", GIF, "k")]
    frame = spark.createDataFrame(rows, "doc_id long, declared string, media binary, type string")
    found = media.sniff_media(frame.select("doc_id", "declared", "media"), keep=()).collect()
    assert len(found) == len(rows)
    one = next(r for r in found if r["doc_id"] == 1)
    assert one["type"] is None and not one["corrected"] and [(e["type"], bytes(e["media"])) for e in one["embedded"]] == [("image/gif", GIF), ("image/png", png())]
    two = [r for r in found if r["doc_id"] == 2]
    assert [(r["type"], r["corrected"], bytes(r["payload"])) for r in two] == [("image/gif", False, GIF)] * 2
    three = next(r for r in found if r["doc_id"] == 3)
    assert bytes(three["payload"]) == b"" and three["type"] is None
    four = next(r for r in found if r["doc_id"] == 4)
    assert four["type"] == "image/png" and four["corrected"]
    assert media.sniff_media(frame.limit(0).select("doc_id", "declared", "media")).count() == 0


def test_texts_survive_storage(spark):
    texts = [None, "", "a" * 63, "a" * 64, "a" * 65, "é" * 40, "RIFF" + "x" * 90, "BM%PDF-GIF89aPK\x03\x04", "long " * 40_000]
    rows = [(i, t, "m") for i, t in enumerate(texts)]
    stored = media.store_texts(spark.createDataFrame(rows, "doc_id long, text string, media string"))
    found = {r["doc_id"]: r for r in media.sniff_media(stored, keep=("n_bytes",)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert found[i]["n_bytes"] == len(raw)
        assert bytes(found[i]["payload"]) == raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert found[i]["type"] == "audio/wav" and found[i]["corrected"]
    assert media.store_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registered_media_digests(spark, small):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    found = op10_media(spark, small).collect()
    assert len(found) == len(docs)
    for r in found:
        raw = docs[r["doc_id"]].encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(media.wav(payload)).hexdigest()
        assert r["media_bytes"] == len(media.wav(payload))


SMALL = toxicity.Settings(buckets=1 << 12, epochs=8, max_rows=400, dim=4)


def invented(n, seed=0):
    rng = random.Random(seed)
    clean = ["river", "stone", "walking", "garden", "morning", "window", "letter", "music", "table", "paper"]
    bad = ["worthless", "disgusting", "pathetic", "moronic"]
    out = []
    for i in range(n):
        toxic = int(rng.random() < 0.4)
        w = [rng.choice(clean) for _ in range(rng.randrange(4, 30))]
        for _ in range(toxic * (1 + len(w) // 8)):
            w[rng.randrange(len(w))] = rng.choice(bad)
        out.append((i, " ".join(w), toxic))
    return out


def test_misspellings_are_caught():
    rows = invented(300)
    model = toxicity.train([r[1] for r in rows], [r[2] for r in rows], SMALL)
    good = sum((model.score(t) >= 0.5) == bool(y) for _, t, y in invented(200, 9))
    assert good >= 190
    assert model.score("such a wortthless and disgustinng garden") > 0.5 > model.score("such a musical garden wall")


def test_scores_of_odd_rows(spark):
    rows = invented(300)
    docs = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows] + [(1000, None, 0.0), (1001, "", 0.0), (None, "x", 0.0), (5, rows[5][1], 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y, "t") for i, _, y in rows] + [(None, 1, "t"), (4000, 1, "t"), (7, None, "t"), (8, 3, "t")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels, settings=SMALL)
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(rows) + 4
    assert all(0 <= r["score"] <= 1 for r in found)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert by[1000] == by[1001]
    assert by[5][0] == by[5][1]
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0), settings=SMALL)
    assert none.score("anything") == pytest.approx(0.5)


def test_training_is_bounded_and_keeps_the_fold_out(spark):
    rows = [(i, "the same", int(zlib.crc32(str(i).encode()) % 5 == 0)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("doc_id", "text")
    labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("doc_id", "toxic")
    # Only the held-out fold has label 1, so training sees one class.
    model = toxicity.fit(docs, labels, settings=SMALL)
    assert model.score("x") < 0.05 and not model.weights.any()
    few = toxicity.fit(docs, labels, settings=toxicity.Settings(max_rows=3))
    assert few.score("x") == pytest.approx(1 / 5)
    tight = toxicity.fit(docs, labels, settings=toxicity.Settings(max_bytes=20))
    assert tight.score("x") == pytest.approx(1 / 4)


def test_registered_scores(spark, small):
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "toxic").collect()}
    found = op7_toxicity(spark, small).collect()
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5)
    known = [(labels[r["doc_id"]], r["score"]) for r in found if r["doc_id"] in labels]
    pairs = [(a > b) + 0.5 * (a == b) for y, a in known if y for z, b in known if not z]
    assert sum(pairs) / len(pairs) > 0.8


def test_pipeline_stage_decisions(spark, small, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_links import components

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    now = pipeline.drop_toxic(spark, docs, small).cache()
    assert now.columns == columns and 0.7 * len(rows) < now.count() < len(rows)
    kept = now.toPandas()
    ids = sorted(kept.doc_id)
    texts = [rows[i] for i in ids]
    unique = pipeline.drop_near_copies(spark, now, small).cache()
    sets, parts = components(texts)
    assert sorted(r[0] for r in unique.select("doc_id").collect()) == [ids[i] for i, p in enumerate(parts) if p == i]
    assert sets and unique.columns == columns
    clean = pipeline.mask_pii(spark, unique, small).cache()
    assert clean.columns == columns and clean.count() == unique.count()
    for r in clean.collect():
        assert r["n_chars"] == len(r["text"]) and "@mail" not in r["text"]
    pieces = pipeline.pack(spark, clean, small)
    total = {r["doc_id"]: r["n"] for r in pieces.groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()}
    assert set(total) == {r[0] for r in clean.select("doc_id").collect()}
    for f in (now, unique, clean):
        f.unpersist()


def test_near_copies_are_judged_by_row(spark, small):
    """Repeated and null ids, blank texts, columns of other names, and no rows."""
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = ("a b c d e f g h i j k", "one two three four five six seven", "some other words that nobody else has here")
    rows = [(5, a), (5, b), (3, a.upper()), (None, a), (None, c), (None, c), (5, b), (9, ""), (9, ""), (9, None), (None, " \t")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 7, 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component long, n int")
    kept = pipeline.drop_near_copies(spark, docs, small)
    assert kept.columns == list(pipeline.COLUMNS)
    want = [(3, a.upper()), (5, b), (None, c), (9, ""), (9, ""), (9, None), (None, " \t")]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(repr, want))
    for stage in (pipeline.drop_near_copies, pipeline.mask_pii, pipeline.pack):
        assert stage(spark, docs.limit(0), small).count() == 0
