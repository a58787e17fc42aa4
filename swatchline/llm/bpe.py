"""Byte-level BPE encoding by backtracking over token matches, and decoding.

Bytes are mapped to Latin-1, so that pyahocorasick tells how far the tokens of the vocabulary reach from a place in a
piece of text. From the left the longest token is taken that is compatible with the token before it: that the merges of the
two tokens' bytes give just these two. A dead end gives up the last token for the next shorter; an end once given up
is never tried again, as the tokens that lead to a place are unique. The result is that of the merges.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import sys
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchline.llm.common import small_batches, table

#: Bounds of what a worker remembers: pieces of text (in each of two halves), and pairs of tokens.
PIECES, PAIRS = 300_000, 1_000_000
#: Tokens that are decoded at once.
BLOCK = 1 << 16


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token to rank, from lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Pieces(dict):
    """Ids of pieces of text by piece. When it is full, it is kept as the older half; what is met again moves back."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            tokens = self.encode(piece.encode("utf-8"))
            ids = struct.pack(f"<{len(tokens)}I", *tokens)
        if len(self) >= PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Bpe:
    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.most = max(map(len, ranks))
        self.size = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.size[list(self.bytes_of)] = [len(b) for b in self.bytes_of.values()]
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.bytes_of[i] for i in sorted(self.bytes_of)), np.uint8)
        self.pairs: dict[int, bool] = {}
        self.pieces = Pieces(self.encode_piece)

    def merged(self, data: bytes) -> list[int]:
        """Tokens by the merges themselves, lowest rank first, leftmost among equals."""
        rank, none = self.ranks.get, 1 << 40
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [rank(a + b, none) for a, b in pairwise(parts)]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            known = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, most, chars = len(data), self.most, data.decode("latin-1")
        prefix, rank, pairs = self.automaton.longest_prefix, self.ranks.get, self.pairs.get
        dead = bytearray(n + 1)
        tokens: list[int] = []
        starts: list[int] = []
        at, length = 0, prefix(chars[:most])
        while at < n:
            while length:
                if not dead[at + length] and (token := rank(data[at : at + length])) is not None:
                    if not tokens:
                        break
                    known = pairs(tokens[-1] << 32 | token)
                    if known or known is None and self.compatible(tokens[-1], token):
                        break
                length -= 1
            if length:
                tokens.append(token)
                starts.append(at)
                at += length
                length = prefix(chars[at : at + most])
            else:
                dead[at] = 1
                tokens.pop()
                at, length = starts[-1], at - starts.pop() - 1
        return tokens

    def encode(self, pieces: list[str]) -> bytes:
        """Ids of the pieces as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        out = []
        for at in range(0, len(ids), 4 * BLOCK):
            token = np.frombuffer(ids[at : at + 4 * BLOCK], "<u4")
            size = self.size[token]
            ends = np.cumsum(size)
            out.append(self.flat[np.arange(ends[-1]) + np.repeat(self.start[token] - (ends - size), size)].tobytes())
        return b"".join(out)


def worker_memory(name: str, make):
    """What a Python worker keeps from one task to the next."""
    kept = vars(sys).setdefault("_swatchline_memory", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def _encode(vocabulary, name: str, pattern: str):
    def run(batches):
        import regex

        bpe = worker_memory(name, lambda: Bpe(read_ranks(vocabulary.value)))
        split = regex.compile(pattern).findall
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                ids = bpe.encode(split(text or ""))
                out.append((i, len(ids) // 4, ids, bpe.decode(ids)))
            yield pd.DataFrame(out, columns=["id", "n_tokens", "ids", "decoded"])

    return run


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit), decoded bytes of every row; a null text counts as empty.

    The pattern must cover the text; each of its matches is encoded by itself. Rows stay apart, whatever their ids.
    The vocabulary file is read by the driver and sent to the workers; it has a fixed size.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        data = f.read()
    name = hashlib.sha256(data).hexdigest()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(_encode(spark.sparkContext.broadcast(data), name, pattern), "id string, n_tokens long, ids binary, decoded binary")
    return out.select(F.col("id").cast("long").alias("doc_id"), "n_tokens", "ids", "decoded")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
