"""Vector bin packing of token sequences.

Every example is a vector: its tokens, the segments it adds and the tokens that
bear loss.  A sequence holds at most ``Limits`` of each.  Sequences are filled
one after another; the next example is the fitting one with the largest dot
product between its demand and the room that is left, each measured as a part
of its limit.  An example longer than a sequence is first cut into full ones
and a rest; where nothing fits whole, and for the last segment that a sequence may
have, the example with the largest dot product is cut to fill the room.  So only the
last sequences of a block are padded, which nothing longer is left for.

Placement is local to an input partition and, inside it, to blocks of
``BLOCK_ITEMS`` rests.  No token moves over the network, memory holds one block,
and a task that runs again on its split places everything as before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from filigree.llm.common import FLUSH_BYTES, byte_level, pick, tidily

#: Rests that are placed together.
BLOCK_ITEMS = 2048
#: Bits of a sequence id that count within a partition.
LOCAL_BITS = 40


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


def place(demand, limits: Limits) -> Iterator[tuple[int, int, int, int]]:
    """Yield (item, start, length, sequence) for rests given as rows (tokens, loss).

    The loss-bearing tokens of a cut example count in proportion, rounded up, for
    the first part; the second part keeps the remainder.
    """
    import numpy as np

    most = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
    need = np.ones((len(demand), 3), np.float64)
    need[:, 0], need[:, 2] = demand[:, 0], demand[:, 1]
    # Examples with equal demands are interchangeable: the heuristic looks at each
    # distinct demand once, whatever the number of examples behind it.
    kinds: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i in np.flatnonzero(need[:, 0] > 0)[::-1]:
        kinds.setdefault((int(need[i, 0]), int(need[i, 2])), []).append((int(i), 0))
    keys = sorted(kinds, reverse=True)
    have = np.array([(a, 1, b) for a, b in keys], np.float64).reshape(-1, 3)
    live = np.ones(len(keys), bool)
    at = {k: j for j, k in enumerate(keys)}
    sequence = 0
    while live.any():
        room = most.copy()
        while room[0] >= 1 and room[1] >= 1:
            fits = live & (have <= room).all(axis=1)
            whole = fits.any()
            may = fits if whole else live
            if room[1] == 1 and (longer := live & (have[:, 0] > room[0])).any():
                # The last segment a sequence may have is cut from one that fills it.
                whole, may = False, longer
            if not may.any():
                break
            score = np.where(may, (have / most) @ (room / most), -1.0)
            j = int(score.argmax())
            tokens, loss = keys[j]
            item, start = kinds[keys[j]].pop()
            live[j] = bool(kinds[keys[j]])
            if whole:
                room -= (tokens, 1, loss)
                yield item, start, tokens, sequence
                continue
            part = int(min(room[0], room[2] * tokens // loss if loss else tokens, tokens - 1))
            if part < 1:
                kinds[keys[j]].append((item, start))
                live[j] = True
                break
            spent = min(-(-loss * part // tokens), int(room[2]))
            rest = (tokens - part, max(loss - spent, 0))
            yield item, start, part, sequence
            room = np.zeros(3)
            if rest not in at:
                at[rest] = len(keys)
                keys.append(rest)
                kinds[rest] = []
                have = np.vstack([have, [rest[0], 1, rest[1]]])
                live = np.append(live, False)
            kinds[rest].append((item, start + part))
            live[at[rest]] = True
        sequence += 1


def pack_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    tokenizer: str,
    limits: Limits = Limits(),
    end_id: int = 0,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Tokenise texts, append ``end_id`` and pack the ids.

    Returns a row per piece: doc_id, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset, sequence_tokens, padded_to.  Text
    tokens bear loss, the end id does not.

    A null or empty text is the end id alone.  Rows with the same id, also null,
    are separate documents.  An empty table gives no rows.  Every id lies in one
    piece; offsets in a sequence are gapless from 0.  A sequence counts as padded
    to ``limits.tokens`` unless its length is a power of two.
    """
    if limits.tokens < 1 or limits.segments < 1 or limits.loss < 1:
        raise ValueError("limits must be positive")
    run = _packer(tokenizer, limits, end_id, block_items)
    return pick(df, doc_id=id_col, text=text_col).mapInArrow(
        tidily(run, "bytes"),
        "doc_id long, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long, sequence_tokens long, padded_to long",
    )


def _packer(tokenizer: str, limits: Limits, end_id: int, block_items: int) -> Callable:
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([
            ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
            ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64()), ("padded_to", pa.int64()),
        ])
        encode = byte_level(tokenizer)
        base = TaskContext.get().partitionId() << LOCAL_BITS
        count, rows, held = 0, [], 0
        end = np.array([end_id], np.uint32)
        # A sequence that one document fills alone: as many tokens as all limits allow.
        full = min(limits.tokens, limits.loss)

        def close(pieces):
            """Rows of one finished sequence."""
            nonlocal count, held
            used = sum(p[2] for p in pieces)
            padded = used if used & (used - 1) == 0 else limits.tokens
            at = 0
            for doc, start, length, ids, doc_tokens in pieces:
                rows.append((doc, start, length, ids.tobytes(), doc_tokens, base + count, at, used, padded))
                at += length
                held += 4 * length
            count += 1

        def flush():
            nonlocal rows, held
            out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows, held = [], 0
            return out

        def pack(block):
            demand = np.array([(len(ids), len(ids) - last) for _, _, ids, _, last in block], np.int64).reshape(-1, 2)
            pieces, now = [], 0
            for i, start, length, sequence in place(demand, limits):
                if sequence != now:
                    close(pieces)
                    pieces, now = [], sequence
                doc, first, ids, total, _ = block[i]
                pieces.append((doc, first + start, length, ids[start : start + length], total))
            if pieces:
                close(pieces)

        block = []
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for doc, text in zip(ids_of, texts, strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                total = len(ids)
                cut = total // full * full
                for s in range(0, cut, full):
                    close([(doc, s, full, ids[s : s + full], total)])
                if cut < total:
                    block.append((doc, cut, ids[cut:].copy(), total, 1))
                if len(block) >= block_items:
                    pack(block)
                    block = []
                if held >= FLUSH_BYTES:
                    yield flush()
        pack(block)
        if rows:
            yield flush()

    return run
