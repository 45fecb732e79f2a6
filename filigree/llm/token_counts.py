"""Offset-mapped token attribution.

A document is encoded once, whole.  Its tokens are character intervals that
follow one another, sections are intervals too, and an interval join assigns
each token to a section.  A token that crosses a boundary goes by ``rule``:

``start``
    to the section that holds its first byte;
``largest``
    to the section that holds most of its bytes, the earlier one on a tie.

Both intervals are sorted, so the join is a binary search of section bounds in
token offsets.  Offsets are byte positions, which fall on the same boundaries
as character positions wherever a section begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from filigree.llm.common import byte_level, pick, tidily

RULES = ("start", "largest")
#: Section rows after which a batch is handed on.
FLUSH_ROWS = 20_000


def attribute(offsets, bounds, rule: str):
    """Tokens of each section and tokens that cross into the next ones.

    offsets: token boundaries, first 0 and last the text's length, strictly
    rising; bounds: section boundaries over the same range, rising.  Returns two
    arrays as long as the sections.  Empty sections get no token.
    """
    import numpy as np

    starts, ends = offsets[:-1], offsets[1:]
    n = len(bounds) - 1
    # The last section whose start is at or before a position holds that position.
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    owner = first.copy()
    crossing = np.flatnonzero(last > first)
    if rule == "largest":
        for t in crossing:
            k = np.arange(first[t], last[t] + 1)
            share = np.minimum(ends[t], bounds[k + 1]) - np.maximum(starts[t], bounds[k])
            owner[t] = k[int(share.argmax())]
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def token_counts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    tokenizer: str,
    separator: str = "\n",
    rule: str = "start",
) -> DataFrame:
    """Token counts of a text's sections, which end behind each ``separator``.

    Returns a row per section: doc_id, section (from 0), n_chars, n_bytes,
    n_tokens, n_crossing (those of its tokens that reach into a later section).
    Counts of a document add up to the length of its one encoding.

    A null or empty text is one empty section without tokens.  A text that ends
    in a separator has no empty section behind it.  Repeated rows are counted
    each; null ids are kept; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if not separator:
        raise ValueError("separator must not be empty")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encode = byte_level(tokenizer)
        schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("section", "n_chars", "n_bytes", "n_tokens", "n_crossing"))])
        docs, parts, held = [], [], 0

        def flush():
            nonlocal docs, parts, held
            sizes = [p.shape[1] for p in parts]
            own = pa.array(docs, pa.int64()).take(pa.array(np.repeat(np.arange(len(docs)), sizes)))
            out = pa.record_batch([own, *(pa.array(c) for c in np.concatenate(parts, axis=1))], schema=schema)
            docs, parts, held = [], [], 0
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                pieces = text.split(separator)
                pieces = [p + separator for p in pieces[:-1]] + ([pieces[-1]] if pieces[-1] or len(pieces) == 1 else [])
                chars = np.array([len(p) for p in pieces], np.int64)
                # Byte lengths equal character lengths in ASCII texts.
                size = chars if text.isascii() else np.array([len(p.encode()) for p in pieces], np.int64)
                bounds = np.concatenate([[0], np.cumsum(size)])
                ids = encode(text)
                offsets = np.concatenate([[0], np.cumsum(encode.lengths[ids])])
                tokens, crossing = attribute(offsets, bounds, rule)
                docs.append(doc)
                parts.append(np.stack([np.arange(len(pieces)), chars, size, tokens, crossing]).astype(np.int64))
                held += len(pieces)
                if held >= FLUSH_ROWS:
                    yield flush()
        if parts:
            yield flush()

    return pick(df, doc_id=id_col, text=text_col).mapInArrow(
        tidily(run, "bytes"), "doc_id long, section long, n_chars long, n_bytes long, n_tokens long, n_crossing long"
    )
