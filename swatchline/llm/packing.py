"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document longer than a window gives full windows of its own; its rest, and shorter documents, are gathered into
groups that fill WINDOWS windows but for a little slack (the last piece is cut to fit). The last few documents of a
group are cut to small pieces, which even out what the large ones leave uneven. Each group is partitioned into
near-equal windows: every piece starts as a partial partition of its own, and the two partitions with the largest
differences are merged, the fullest windows of one with the emptiest of the other, until one is left. Where a window
would hold more than its capacity, the number of windows rises by one and the group is partitioned again.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchline.llm.bpe import worker_memory
from swatchline.llm.common import small_batches, table

CAPACITY, WINDOWS, SLACK = 2048, 64, 0.004
#: The last CRUMBED of a group's ids are cut to pieces of these lengths; small pieces even the windows out.
CRUMBED, CRUMBS = 0.06, (128, 64, 32, 16, 8)
END_ID = 1
#: Fixed value: how the byte-level pre-tokenizer of such files divides a text.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """k lists of places in sizes, with near-equal sums."""
    nodes: list[tuple[int, int]] = []  # a pair of places or nodes; places are negative: -1 - place
    order = itertools.count()
    heap = []
    for place, size in enumerate(sizes):
        sums, who = np.zeros(k, np.int64), np.full(k, 1 << 40, np.int64)
        sums[0], who[0] = size, -1 - place
        heap.append((-size, next(order), sums, who))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, sums, who = heapq.heappop(heap)
        _, _, other, more = heapq.heappop(heap)
        sums, more = sums + other[::-1], more[::-1]
        both = np.flatnonzero((who < 1 << 40) & (more < 1 << 40))
        who, more = np.where(who == 1 << 40, more, who), more
        if len(both):
            at = len(nodes)
            nodes += zip(who[both].tolist(), more[both].tolist(), strict=True)
            who[both] = np.arange(at, len(nodes))
        by = np.argsort(-sums, kind="stable")
        sums, who = sums[by], who[by]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), next(order), sums, who))
    out = []
    for top in heap[0][3].tolist() if heap else []:
        todo, places = [top] if top < 1 << 40 else [], []
        while todo:
            x = todo.pop()
            if x < 0:
                places.append(-1 - x)
            else:
                todo += nodes[x]
        out.append(places)
    return out + [[]] * (k - len(out))


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """As few windows as the differencing finds within capacity; sizes are at most capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = karmarkar_karp(sizes, k)
        if max(sum(sizes[p] for p in w) for w in found) <= capacity:
            return [w for w in found if w]
        k += 1


def encoder(data: bytes):
    """Text to ids as the tokenizers library gives them for a byte-level BPE file, by the fastest library that can.

    The rank of a token is its id where each merge makes the next id; tiktoken then gives the same ids. Texts with
    the name of a special token, texts that its pattern can't divide (a million blanks leave it no stack), and files
    with any other setting go to the tokenizers library itself.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(data.decode("utf-8"))
    plain = lambda text: np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)
    spec = json.loads(data)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    special = [t["content"] for t in spec.get("added_tokens", [])]
    merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
    vocab = model.get("vocab", {})
    ordered = [vocab.get(m.replace(" ", "")) for m in merges]
    other = [model.get("dropout"), model.get("unk_token"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("byte_fallback"), model.get("ignore_merges")]
    other += [pre.get("add_prefix_space"), not pre.get("use_regex", True), spec.get("normalizer"), spec.get("truncation"), spec.get("padding")]
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or any(other) or None in ordered or any(b <= a for a, b in itertools.pairwise(ordered)) or (ordered and ordered[0] < 256):
        return plain
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in such files
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
    fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return plain(text)
        try:
            return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
        except ValueError:  # the pattern's stack
            return plain(text)

    return encode


def _pack(vocabulary, name: str, capacity: int, count: int):
    room = int(capacity * count * (1 - SLACK))

    def run(batches):
        from pyspark import TaskContext

        encode = worker_memory(name, lambda: encoder(vocabulary.value))
        serial = itertools.count(TaskContext.get().partitionId() << 33)
        rows: list[tuple] = []
        held: list[tuple] = []
        total = 0

        def close():
            nonlocal held, total
            whole, crumbs, left, lengths = [], [], int(total * CRUMBED), itertools.cycle(CRUMBS)
            for doc, start, ids, n in reversed(held):
                at = max(0, len(ids) - left)
                left -= len(ids) - at
                if at:
                    whole.append((doc, start, ids[:at], n))
                while at < len(ids):
                    end = at + next(lengths)
                    crumbs.append((doc, start + at, ids[at:end], n))
                    at = end
            held = whole[::-1] + crumbs
            for w in windows([len(h[2]) for h in held], capacity) if held else []:
                seq, offset = next(serial), 0
                for p in sorted(w):
                    doc, start, ids, n = held[p]
                    rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, seq, offset))
                    offset += len(ids)
            held, total = [], 0

        for pdf in batches:
            for doc, text in zip(pdf["id"], pdf["text"], strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                n, full = len(ids), len(ids) // capacity * capacity
                for at in range(0, full, capacity):
                    rows.append((doc, at, capacity, zlib.crc32(ids[at : at + capacity].tobytes()), n, next(serial), 0))
                while full < n:
                    end = min(n, full + room - total)
                    held.append((doc, full, ids[full:end].copy(), n))
                    total += end - full
                    full = end
                    if total == room:
                        close()
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
                rows.clear()
        close()
        if rows:
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, count: int = WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids and END_ID; a null text counts as empty. Rows stay apart whatever their ids. Every
    partition packs its own documents, without a shuffle, in groups of `count` windows; a partition ends with one
    group that may be smaller. sequence_id holds the partition above 33 bits, so it is unique and not contiguous.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    kind = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInPandas(_pack(spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest(), capacity, count), kind).withColumn("doc_id", F.col("doc_id").cast("long"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
