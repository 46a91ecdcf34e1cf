"""Encoding of texts by a public byte-pair vocabulary, by dynamic programming over prefixes.

Every prefix of a piece of text has exactly one last token: the one whose predecessor prefix ends in a
token that the merges would leave beside it. Storing that token per prefix encodes in one pass, lets
text be appended exactly, and lets an edit be re-encoded from the edited place on.

Cases: null and empty text -> empty list; special tokens' strings are ordinary text; very long pieces
cost time in proportion to their length; repeated rows give repeated rows; an empty table gives none.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.session import ship

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that cuts text into pieces; fixed value of the vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHE_PIECES = 200_000
_CACHE_BYTES = 64


class PrefixEncoder:
    """The vocabulary as a trie over bytes, with the test whether two tokens may stand side by side."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.trie: dict = {}
        for b, i in self.ranks.items():
            node = self.trie
            for x in b:
                node = node.setdefault(x, {})
            node[-1] = i
        self._beside: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        import regex

        self.cut = regex.compile(PIECES).findall

    def _merge(self, piece: bytes) -> list[int]:
        """Plain byte-pair merging; only used on a pair of tokens to see whether both survive."""
        parts = [bytes([x]) for x in piece]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def beside(self, a: int, b: int) -> bool:
        hit = self._beside.get((a, b))
        if hit is None:
            if len(self._beside) > 2_000_000:
                self._beside.clear()
            hit = self._beside[a, b] = self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return hit

    def last_tokens(self, piece: bytes, last: list[int] | None = None, start: int = 0) -> list[int]:
        """last[i]: the last token of the prefix of length i (0 has -1). With last and start, entries up to
        start are taken over and only what follows is computed."""
        n = len(piece)
        last = (last or [-1])[: start + 1] + [-2] * (n - start)
        # tokens that begin before `start` may end after it: begin far enough back
        for i in range(max(0, start - self.longest), n):
            prev = last[i]
            if prev == -2:
                continue
            node = self.trie
            for j in range(i, n):
                node = node.get(piece[j])
                if node is None:
                    break
                t = node.get(-1)
                if t is not None and j + 1 > start and last[j + 1] == -2 and (prev == -1 or self.beside(prev, t)):
                    last[j + 1] = t
        return last

    def read(self, last: list[int]) -> list[int]:
        """The encoding: follow the last tokens back from the end."""
        out, i = [], len(last) - 1
        while i:
            out.append(last[i])
            i -= len(self.bytes_of[last[i]])
        return out[::-1]

    def piece(self, s: str) -> tuple[int, ...]:
        ids = self._pieces.get(s)
        if ids is None:
            b = s.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(b)
            ids = (whole,) if whole is not None and self._merge(b) == [whole] else tuple(self.read(self.last_tokens(b)))
            if len(b) <= _CACHE_BYTES:
                if len(self._pieces) >= _CACHE_PIECES:
                    self._pieces.clear()
                self._pieces[s] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for s in self.cut(text or ""):
            out += self.piece(s)
        return out


class EncodedText:
    """A text with its stored prefix tokens; append and splice recompute only what changes."""

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.e, self.text, self.tables = encoder, "", []  # tables: (piece, last tokens)
        self.append(text)

    def append(self, more: str) -> None:
        self.splice(len(self.text), len(self.text), more)

    def splice(self, a: int, b: int, new: str) -> None:
        """Replace text[a:b] by new. Pieces that end well before a are kept; the pieces after the edit are
        kept from where old and new cuts agree again."""
        old, tail = self.tables, self.text[b:]
        keep, at = 0, 0
        while keep < len(old) and at + len(old[keep][0]) < a:
            at += len(old[keep][0])
            keep += 1
        back = min(keep, 2)  # a cut may depend on the start of the next piece
        keep -= back
        at -= sum(len(p) for p, _ in old[keep : keep + back])
        text = self.text[:a] + new + tail
        by_piece = {p: t for p, t in old[keep:]}
        fresh = []
        for p in self.e.cut(text[at:]):
            if p in by_piece:
                fresh.append((p, by_piece[p]))
                continue
            raw, start, base = p.encode("utf-8", "surrogatepass"), 0, None
            if len(fresh) < len(old) - keep:  # same place: share the common prefix's entries
                q, t = old[keep + len(fresh)]
                qb = q.encode("utf-8", "surrogatepass")
                while start < min(len(qb), len(raw)) and qb[start] == raw[start]:
                    start += 1
                base = t
            fresh.append((p, self.e.last_tokens(raw, base, start)))
        self.tables = old[:keep] + fresh
        self.text = text

    def ids(self) -> list[int]:
        return [i for _, t in self.tables for i in self.e.read(t)]


@cache
def encoder(path: str) -> PrefixEncoder:
    """One per worker process."""
    return PrefixEncoder(path)


def encode(df: DataFrame, key: str, text: str, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """key BIGINT, ids ARRAY<INT>. Narrow: each partition is encoded where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strataform.llm.tokens import encoder as shared

        e = shared(ranks_path)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                ids = pa.array([e.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.record_batch([part.column(0), ids], names=["k", "ids"])

    ship(df.sparkSession)
    src = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    return src.mapInArrow(run, "k bigint, ids array<int>").select(F.col("k").alias(key), "ids")
