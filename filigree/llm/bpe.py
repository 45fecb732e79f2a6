"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token's symbols are the leaves' left neighbours: leaf i holds the rank of
the pair that begins at symbol i, or infinity.  A node holds the minimum of its
children, and a leaf's key carries its place behind the rank, so that the root
yields the leftmost pair of the lowest rank.  A merge changes at most three
leaves, each updated on its way to the root.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from filigree.llm.common import FLUSH_BYTES, NOT_PLAIN, byte_symbols, pick, tidily

#: Pre-tokens whose ids a worker remembers; the memory is emptied beyond that.
MEMO = 400_000
#: Longer pre-tokens are not remembered.
MEMO_LENGTH = 64
_NEVER = 1 << 62


def merge(symbols: list[int], ranks: dict[int, tuple[int, int]]) -> list[int]:
    """Apply merges until no pair has a rank.

    ranks: (left << 32 | right) -> (rank, merged symbol).
    """
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()
    tree = [_NEVER] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        found = get(symbols[i] << 32 | symbols[i + 1])
        if found is not None:
            tree[size + i] = found[0] * n + i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    if tree[1] == _NEVER:
        return symbols
    symbols = symbols[:]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def update(i: int, key: int) -> None:
        node = size + i
        tree[node] = key
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    def key_at(i: int, j: int) -> int:
        found = get(symbols[i] << 32 | symbols[j])
        return _NEVER if found is None else found[0] * n + i

    while (root := tree[1]) != _NEVER:
        i = root % n
        j = after[i]
        symbols[i] = get(symbols[i] << 32 | symbols[j])[1]
        k = after[i] = after[j]
        if j < n - 1:
            update(j, _NEVER)
        if k < n:
            before[k] = i
            update(i, key_at(i, k))
        else:
            update(i, _NEVER)
        if (h := before[i]) >= 0:
            update(h, key_at(h, i))
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


class WordBPE:
    """Encoder and decoder of a tokenizer file with word ends and no decoder.

    Plain texts are normalised and split here; others by the file's own
    normaliser and splitter, taken from the tokenizers library.  Merging is
    :func:`merge` in both cases.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.vocab = vocab
        self.names = {i: s for s, i in vocab.items()}
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added = added
        self.names.update({i: s for s, i in added.items()})
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.byte_of = {s: b for b, s in enumerate(byte_symbols())}
        self.memo: dict[str, tuple[bytes, str]] = {}
        letters = "a-zß-öø-ÿ"
        self.words = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{letters}]+|[0-9]|[^\s{letters}0-9]+").findall

    def piece(self, word: str) -> tuple[bytes, str]:
        """Ids as little-endian bytes, and the decoded form, of one pre-token."""
        symbols = byte_symbols()
        chars = [symbols[b] for b in word.encode()]
        chars[-1] += self.suffix
        ids = merge([self.vocab[c] for c in chars if c in self.vocab], self.ranks)
        found = (b"".join(i.to_bytes(4, "little") for i in ids), " ".join(self.names[i] for i in ids))
        if len(word) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens."""
        if NOT_PLAIN.search(text) is None:
            return self.words(text.lower())
        back = self.byte_of
        return [bytes(back[c] for c in s).decode("utf-8", "surrogatepass") for s, _ in self.split(self.normalise(text))]

    def encode_decode(self, text: str) -> tuple[bytes, str]:
        """Ids of a text as little-endian 32-bit bytes, and their decoded text."""
        memo, out = self.memo, []
        at = 0
        for m in self.added_pattern.finditer(text) if self.added_pattern and any(s in text for s in self.added) else ():
            out += [memo.get(w) or self.piece(w) for w in self.pieces(text[at : m.start()])]
            out.append((self.added[m[0]].to_bytes(4, "little"), m[0]))
            at = m.end()
        out += [memo.get(w) or self.piece(w) for w in self.pieces(text[at:] if at else text)]
        if not out:
            return b"", ""
        return b"".join([a for a, _ in out]), " ".join([b for _, b in out if b])

    def decode(self, ids) -> str:
        return " ".join(self.names[i] for i in ids)


@lru_cache(maxsize=1)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


def bpe_round_trip(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str
) -> DataFrame:
    """Encode whole texts and decode the ids.

    Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit, binary) and
    decoded (string).  Null and empty texts have no ids and decode to an empty
    string.  Repeated rows and null ids are kept as they come; an empty table
    gives no rows.  Work is done row by row, so no group of rows can be hot.
    """

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n_tokens", "ids", "decoded"]
        bpe = word_bpe(tokenizer)
        cols, held = ([], [], [], []), 0

        def flush():
            out = pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.string())], names=names)
            for c in cols:
                c.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, decoded = bpe.encode_decode(text.as_py() or "")
                for c, x in zip(cols, (doc, len(ids) // 4, ids, decoded), strict=True):
                    c.append(x)
                held += len(ids) + len(decoded)
                if held >= FLUSH_BYTES:
                    yield flush()
                    held = 0
        if cols[0]:
            yield flush()

    return pick(df, doc_id=id_col, text=text_col).mapInArrow(tidily(run), "doc_id long, n_tokens long, ids binary, decoded string")
