"""Signature sniffing of media columns.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass
over a blob.  A hit counts only if the format's validator confirms its structure
and the lengths it states; the outermost valid hit at offset 0 gives the true
type, valid hits inside it are embedded media, which are carved out.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from filigree.llm.common import FLUSH_BYTES, pick, tidily

#: Samples a second of the stored form.
RATE = 8000
PAD = 64

# Magic bytes at the start of each format.
MAGIC = {
    b"RIFF": "audio/wav",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
    b"\x1f\x8b\x08": "application/gzip",
    b"OggS": "audio/ogg",
    b"fLaC": "audio/flac",
    b"BM": "image/bmp",
}


class Blob:
    """A blob, and what the validators of all hits in it share: each is looked up once."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self._once: dict = {}
        #: Ends that a walk from a place reached before, by format.
        self.walked: dict[tuple[str, int], int] = {}

    def once(self, name: str, find):
        if name not in self._once:
            self._once[name] = find()
        return self._once[name]

    def after(self, mark: bytes, at: int) -> int:
        """First place of a mark from ``at`` on, or -1; all places are searched once."""

        def places() -> list[int]:
            out, i = [], self.raw.find(mark)
            while i >= 0:
                out.append(i)
                i = self.raw.find(mark, i + 1)
            return out

        found = self.once(f"all {mark!r}", places)
        i = bisect_left(found, at)
        return found[i] if i < len(found) else -1

    def walk(self, kind: str, at: int, step) -> int:
        """Follow ``step`` from place to place: the end of the structure, or -1.

        step: a place's next one, or (end,) where the structure ends; -1 is invalid.
        Walks that meet share the rest of their way.
        """
        way = []
        while (kind, at) not in self.walked:
            way.append(at)
            at = step(at)
            if isinstance(at, tuple):
                self.walked[kind, way[-1]] = at[0]
                at = way[-1]
                break
            if at < 0 or at > len(self.raw):
                self.walked[kind, way[-1]] = -1
                at = way[-1]
                break
        end = self.walked[kind, at]
        for i in way:
            self.walked[kind, i] = end
        return end


def _wav(c: Blob, at: int) -> int:
    b = c.raw
    if len(b) - at < 44 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    i, seen = at + 12, set()
    while i + 8 <= end:
        name, size = b[i : i + 4], struct.unpack_from("<I", b, i + 4)[0]
        seen.add(name)
        i += 8 + size + (size & 1)
    return end - at if i == end and {b"fmt ", b"data"} <= seen else 0


def _png(c: Blob, at: int) -> int:
    b, view = c.raw, memoryview(c.raw)
    if b[at + 8 : at + 16] != b"\0\0\0\rIHDR":
        return 0

    def step(i: int):
        if i + 12 > len(b):
            return -1
        size, name = struct.unpack_from(">I", b, i)[0], b[i + 4 : i + 8]
        end = i + 12 + size
        if end > len(b) or name == b"IHDR" or zlib.crc32(view[i + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return -1
        return (end,) if name == b"IEND" else end

    if at + 33 > len(b) or zlib.crc32(view[at + 12 : at + 29]) != struct.unpack_from(">I", b, at + 29)[0]:
        return 0
    return max(0, c.walk("png", at + 33, step) - at)


def _gif(c: Blob, at: int) -> int:
    b = c.raw
    if len(b) - at < 14:
        return 0

    def blocks(i: int) -> int:
        while i < len(b) and b[i]:
            i += b[i] + 1
        return i + 1

    def step(i: int):
        if i >= len(b):
            return -1
        if b[i] == 0x3B:
            return (i + 1,)
        if b[i] == 0x21:
            return blocks(i + 2)
        if b[i] == 0x2C and i + 10 <= len(b):
            flags = b[i + 9]
            return blocks(i + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
        return -1

    return max(0, c.walk("gif", at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0), step) - at)


def _jpeg(c: Blob, at: int) -> int:
    b = c.raw

    def step(i: int):
        if i + 4 > len(b) or b[i] != 0xFF:
            return -1
        kind, size = b[i + 1], struct.unpack_from(">H", b, i + 2)[0]
        if size < 2:
            return -1
        if kind != 0xDA:
            return i + 2 + size
        end = c.after(b"\xff\xd9", i + 2 + size)
        return (end + 2,) if end >= 0 else -1

    return max(0, c.walk("jpeg", at + 2, step) - at)


def _pdf(c: Blob, at: int) -> int:
    end = c.once("pdf end", lambda: c.raw.rfind(b"%%EOF"))
    table = c.once("pdf table", lambda: c.raw.rfind(b"startxref", 0, max(end, 0)))
    return end + 5 - at if end > at and table >= at else 0


def _zip(c: Blob, at: int) -> int:
    b = c.raw
    end = c.once("zip end", lambda: b.rfind(b"PK\x05\x06"))
    if end < at or end + 22 > len(b):
        return 0
    size, first, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note - at if at + first + size == end and end + 22 + note <= len(b) and b[at + first : at + first + 4] == b"PK\x01\x02" else 0


def _gzip(c: Blob, at: int) -> int:
    view, step = memoryview(c.raw), 1 << 16
    if c.raw[at + 3 : at + 4] > b"\x1f":
        return 0
    try:
        d = zlib.decompressobj(31)
        for i in range(at, len(c.raw), step):
            rest = view[i : i + step]
            while len(rest) and not d.eof:
                d.decompress(rest, 1 << 16)
                rest = d.unconsumed_tail
            if d.eof:
                return min(i + step, len(c.raw)) - len(d.unused_data) - at
    except zlib.error:
        pass
    return 0


def _ogg(c: Blob, at: int) -> int:
    b = c.raw

    def step(i: int):
        if i + 27 > len(b) or b[i : i + 5] != b"OggS\0":
            return -1
        n = b[i + 26]
        end = i + 27 + n + sum(b[i + 27 : i + 27 + n])
        if end > len(b):
            return -1
        return (end,) if b[i + 5] & 4 else end

    return max(0, c.walk("ogg", at, step) - at)


def _flac(c: Blob, at: int) -> int:
    b = c.raw
    if at + 8 > len(b) or b[at + 4] & 0x7F or b[at + 5 : at + 8] != b"\0\0\x22":
        return 0

    def step(i: int):
        if i + 4 > len(b):
            return -1
        end = i + 4 + int.from_bytes(b[i + 1 : i + 4], "big")
        if not b[i] & 0x80:
            return end
        return (len(b),) if end + 2 <= len(b) and b[end] == 0xFF and b[end + 1] & 0xFC == 0xF8 else -1

    return max(0, c.walk("flac", at + 4, step) - at)


def _bmp(c: Blob, at: int) -> int:
    if len(c.raw) - at < 54:
        return 0
    size, spare, first, head = struct.unpack_from("<IIII", c.raw, at + 2)
    return size if spare == 0 and 54 <= first <= size <= len(c.raw) - at and head in (40, 108, 124) else 0


VALID = {
    "audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "application/pdf": _pdf, "application/zip": _zip,
    "application/gzip": _gzip, "audio/ogg": _ogg, "audio/flac": _flac, "image/bmp": _bmp,
}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def sniff(blob: bytes) -> list[tuple[int, int, str]]:
    """Valid media in a blob as (offset, length, type), by offset.

    Of media of different types that hold each other all are listed; at one offset the
    longest.  What looks like a medium inside one of its own type is part of that.
    Every hit is judged on the blob in place, and what hits have in common is looked
    up once, so the time is in proportion to the blob and its hits.
    """
    best: dict[int, tuple[int, str]] = {}
    inside: dict[str, int] = {}
    shared = Blob(blob)
    # A hit begins where its magic does; magics are found by their ends.
    for end, (n, kind) in automaton().iter(blob.decode("latin-1")):
        at = end + 1 - n
        if at < inside.get(kind, 0):
            continue
        try:
            size = VALID[kind](shared, at)
        except (struct.error, IndexError):
            size = 0
        if size > best.get(at, (0, ""))[0]:
            best[at] = size, kind
            inside[kind] = at + size
    return [(at, size, kind) for at, (size, kind) in sorted(best.items())]


def wav(payload: bytes) -> bytes:
    """Bytes as unsigned 8-bit mono samples."""
    odd = len(payload) & 1
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8) + struct.pack("<4sI", b"data", len(payload))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(payload) + odd, b"WAVE") + head + payload + b"\0" * odd


def samples(blob: bytes) -> bytes:
    """The data chunk of a wav blob."""
    at = 12
    while at + 8 <= len(blob):
        name, size = blob[at : at + 4], struct.unpack_from("<I", blob, at + 4)[0]
        if name == b"data":
            return blob[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as a media column: doc_id, n_bytes, declared (type), media (binary).

    The UTF-8 bytes, a null text's none, are filled with zero bytes to a positive
    multiple of 64 and stored as the samples of a wav file.  The type is declared
    as the raw bytes it came from, which sniffing corrects.
    """

    def run(batches):
        import pyarrow as pa

        cols, held = ([], [], []), 0

        def flush():
            out = pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(["application/octet-stream"] * len(cols[0])), pa.array(cols[2], pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])
            for c in cols:
                c.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                size = max(PAD, -(-len(raw) // PAD) * PAD)
                for c, x in zip(cols, (doc, len(raw), wav(raw.ljust(size, b"\0"))), strict=True):
                    c.append(x)
                held += size
                if held >= FLUSH_BYTES:
                    yield flush()
                    held = 0
        if cols[0]:
            yield flush()

    return pick(df, doc_id=id_col, text=text_col).mapInArrow(tidily(run), "doc_id long, n_bytes long, declared string, media binary")


def sniff_media(
    df: DataFrame, id_col: str = "doc_id", media_col: str = "media", declared_col: str = "declared", *, keep: tuple[str, ...] = ()
) -> DataFrame:
    """True types and embedded media of a binary column.

    Returns a row per blob: id, declared, type (null where no format is
    confirmed at offset 0), corrected (the declared type, of any case and without
    parameters, was not the true one), payload (the samples of a wav blob, else
    the blob as far as its format reaches, else all of it), embedded (array of
    offset, length, type, media of all valid media behind offset 0), feature, and
    the columns named in ``keep`` as they are.

    A null blob counts as empty: no type, empty payload.  Repeated rows and null
    ids are kept; an empty table gives no rows.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        inner = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("media", pa.binary())]))
        schema = pa.schema([("doc_id", pa.int64()), ("declared", pa.string()), ("type", pa.string()), ("corrected", pa.bool_()), ("payload", pa.binary()), ("embedded", inner), ("feature", pa.string())])
        rows, held = [], 0

        def flush(batch, upto, first):
            nonlocal rows, held
            own = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
            rest = [batch.column(3 + i).slice(first, upto - first) for i in range(len(keep))]
            rows, held = [], 0
            return pa.record_batch(own + rest, names=[*schema.names, *keep])

        for batch in batches:
            first = 0
            for i, (doc, declared, blob) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), strict=True)):
                blob = blob.as_py() or b""
                found = sniff(blob)
                own = next((x for x in found if x[0] == 0), None)
                kind = own and own[2]
                payload = samples(blob) if kind == "audio/wav" else blob[: own[1]] if own else blob
                inside = [{"offset": at, "length": n, "type": k, "media": blob[at : at + n]} for at, n, k in found if at]
                said = (declared or "").split(";")[0].strip().lower()
                x = np.frombuffer(payload, np.uint8)
                mean = f"{x.mean():.6f}" if len(x) else "-"
                turns = int(np.count_nonzero(np.diff(x >= 128))) if len(x) else 0
                feature = f"{kind or '-'};mean={mean};crossings={turns};distinct={len(np.unique(x)) if len(x) < 512 else int(np.count_nonzero(np.bincount(x, minlength=256)))};embedded={','.join(e['type'] for e in inside)}"
                rows.append((doc, declared, kind, bool(kind) and kind != said, payload, inside, feature))
                held += len(payload) + sum(e["length"] for e in inside)
                if held >= FLUSH_BYTES:
                    yield flush(batch, i + 1, first)
                    first = i + 1
            if rows:
                yield flush(batch, batch.num_rows, first)

    rows_in = pick(df, doc_id=id_col, declared=declared_col, media=media_col, **{k: k for k in keep})
    out = T._parse_datatype_string(
        "doc_id long, declared string, type string, corrected boolean, payload binary, "
        "embedded array<struct<offset: long, length: long, type: string, media: binary>>, feature string"
    )
    return rows_in.mapInArrow(tidily(run), T.StructType(out.fields + [rows_in.schema[k] for k in keep]))
