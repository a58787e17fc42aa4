"""Alignment of the tokens of two tokenizers, and how sure the corpus is of it.

Each byte of a text has a label: whether no token ends there, one of A, one of B, or one of both. Regex scanning extracts
the spans up to each both-label; a span is a group, and its labels count the tokens of A and of B in it. All A-B pairs of
a group are linked. The number of documents that hold an id pair linked is counted over the whole corpus.

1. One pass tokenizes the texts and writes, for each document, its figures and its distinct pairs with how often each
   stands there, packed (PAIR bytes a pair before compression).
2. The packed pairs are counted over documents: in each task, then by pair. The highest count of each A id is joined.
3. A second pass over the packed pairs sums counts. Pairs that stand in at least 1 / FREQUENT of all (document, pair)
   rows are at most FREQUENT and are broadcast; the others move and are joined by pair, none of them being hot.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchline.llm.bpe import worker_memory
from swatchline.llm.common import cut, small_batches, table
from swatchline.llm.packing import encoder

#: Pairs whose counts may be broadcast; pairs that a task holds before it hands them on; links expanded at once.
FREQUENT, HELD, LINKS = 1 << 17, 1 << 21, 1 << 20
#: How a distinct pair of a document is packed: ids of A and B, and how often.
PAIR = [("a", "<u4"), ("b", "<u4"), ("n", "<u4")]
#: Spans whose counts a worker remembers between texts.
SPANS = 20_000


class ByteLevelTokens:
    """Ids of a byte-level file of the tokenizers library, names of special tokens being plain text; bytes of each id."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        special = {t["content"] for t in spec.get("added_tokens") or []}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in such files
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bytes_of = {i: bytes(map(byte_of.__getitem__, t)) for t, i in vocab.items()}
        # with a token for each byte, and no normaliser, no text can come out changed
        self.lossless = {bytes([x]) for x in range(256)} <= set(self.bytes_of.values()) and not spec.get("normalizer")
        # without their names the file has no special tokens at all
        spec["model"]["vocab"], spec["added_tokens"] = vocab, []
        self.encode = encoder(json.dumps(spec).encode())


class PieceTokens:
    """Ids of a sentencepiece model, and bytes of each id."""

    lossless = False

    def __init__(self, data: bytes):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=data)
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.bytes_of = {}
        for i, p in enumerate(map(own.id_to_piece, range(own.get_piece_size()))):
            told = byte.fullmatch(p)
            self.bytes_of[i] = bytes.fromhex(told[1]) if told else p.replace("▁", " ").encode("utf-8")
        self.encode = lambda text: np.array(own.encode(text), np.uint32)


class SpanCounts(dict):
    """Spans of labels, whose last is of both, by number; a and b have how many tokens of A and of B each number holds."""

    def __init__(self):
        self.a, self.b = [], []

    def __missing__(self, span: bytes) -> int:
        both = span.count(b"3")
        self.a.append(span.count(b"1") + both)
        self.b.append(span.count(b"2") + both)
        self[span] = len(self.a) - 1
        return len(self.a) - 1

    def counts(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > SPANS:
            self.clear()
            self.a, self.b = [], []
        which = np.fromiter(map(self.__getitem__, spans), np.int64, len(spans))
        return np.array(self.a, np.int64)[which], np.array(self.b, np.int64)[which]


class Aligner:
    def __init__(self, a: ByteLevelTokens, b: PieceTokens):
        self.a, self.b = a, b
        self.spans, self.scan = SpanCounts(), re.compile(rb"[^3]*3")
        sized = lambda t: np.array([len(t.bytes_of.get(i, b"")) for i in range(max(t.bytes_of) + 1)], np.int64)
        self.sizes = sized(a), sized(b)
        # an id's decimal digits and what follows it in a told group
        self.told = [f"{i}{end}".encode() for t, ends in ((self.sizes[0], ",|"), (self.sizes[1], ",;")) for end in ends for i in range(len(t))]
        self.at = np.cumsum([0, len(self.sizes[0]), len(self.sizes[0]), len(self.sizes[1])])

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B; None where the text is empty or either's bytes aren't those of a space and the text."""
        if not text:
            return None
        want = (" " + text).encode("utf-8", "surrogatepass")
        out = []
        for t, given in ((self.a, " " + text), (self.b, text)):
            ids = t.encode(given)
            if not t.lossless and b"".join(map(t.bytes_of.__getitem__, ids.tolist())) != want:
                return None
            out.append(ids.astype(np.int64))
        return out[0], out[1]

    def groups(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of A and of B each group holds."""
        ends = [np.cumsum(size[ids]) - 1 for size, ids in zip(self.sizes, (ids_a, ids_b), strict=True)]
        labels = np.full(int(ends[0][-1]) + 1, ord("0"), np.uint8)
        labels[ends[0]] += 1
        labels[ends[1]] += 2
        return self.spans.counts(self.scan.findall(labels.tobytes()))

    def digest(self, ids_a, ids_b, n_a, n_b) -> str:
        order = np.argsort(np.concatenate((2 * np.repeat(np.arange(len(n_a)), n_a), 2 * np.repeat(np.arange(len(n_b)), n_b) + 1)), kind="stable")
        sizes = np.stack((n_a, n_b), axis=1).ravel()
        last = np.zeros(len(order), np.int64)
        last[np.cumsum(sizes) - 1] = 1
        is_b = (order >= len(ids_a)).astype(np.int64)
        which = np.concatenate((ids_a, ids_b))[order] + self.at[2 * is_b + last]
        return hashlib.sha256(b"".join(map(self.told.__getitem__, which.tolist()))[:-1]).hexdigest()

    def pairs(self, ids_a, ids_b, n_a, n_b) -> np.ndarray:
        """The distinct pairs of a document, by ids, with how many links each has."""
        links = n_a * n_b
        start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        small = np.flatnonzero(links <= LINKS)
        ends = np.cumsum(links[small])
        at = 0
        while at < len(small):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LINKS, "right")))
            g = small[at:to]
            m, at = links[g], to
            i = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            width = np.repeat(n_b[g], m)
            a, b = ids_a[np.repeat(start_a[g], m) + i // width], ids_b[np.repeat(start_b[g], m) + i % width]
            found.append(np.unique(a << 32 | b, return_counts=True))
        for g in np.flatnonzero(links > LINKS).tolist():  # by distinct ids, not by occurrences
            a, times_a = np.unique(ids_a[start_a[g] : start_a[g] + n_a[g]], return_counts=True)
            b, times_b = np.unique(ids_b[start_b[g] : start_b[g] + n_b[g]], return_counts=True)
            found.append(((a[:, None] << 32 | b).ravel(), np.outer(times_a, times_b).ravel()))
        if len(found) > 2:
            key, of = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            found = [(key, np.bincount(of, np.concatenate([n for _, n in found]), len(key)).astype(np.int64))]
        key, n = found[-1]
        out = np.empty(len(key), PAIR)
        out["a"], out["b"], out["n"] = key >> 32, key & 0xFFFFFFFF, n
        return out

    def row(self, text: str | None) -> tuple:
        ids = self.tokens(text)
        if ids is None:
            return 0, 0, 0, 0, "", b""
        n_a, n_b = self.groups(*ids)
        pairs = self.pairs(*ids, n_a, n_b)
        return len(ids[0]), len(ids[1]), len(n_a), int((n_a * n_b).sum()), self.digest(*ids, n_a, n_b), zlib.compress(pack(pairs), 1)


def pack(pairs: np.ndarray) -> bytes:
    """By columns, and bytes of one weight together: then most are zeros or repeat."""
    columns = (np.diff(pairs["a"], prepend=np.uint32(0)), pairs["b"], pairs["n"])
    return b"".join(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(a << 32 | b, n) of packed pairs; a rises."""
    raw = np.frombuffer(zlib.decompress(data) if data else b"", np.uint8)
    a, b, n = (np.ascontiguousarray(c.T).view("<u4").ravel().astype(np.int64) for c in raw.reshape(3, 4, -1)) if len(raw) else np.zeros((3, 0), np.int64)
    return np.cumsum(a) << 32 | b, n


def _align(make):
    def run(batches):
        aligner = make()
        for pdf in batches:
            out = [(i, *aligner.row(text)) for i, text in zip(pdf["id"], pdf["text"], strict=True)]
            yield pd.DataFrame(out, columns=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return run


def _pair_docs(batches):
    """(pair, docs): the distinct pairs of a task's documents, and how many of these hold them."""
    held, size = [], 0

    def told():
        pair, docs = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"pair": pair, "docs": docs})

    for pdf in batches:
        for data in pdf["pairs"]:
            held.append(unpack(data)[0])
            size += len(held[-1])
            if size >= HELD:
                yield told()
                held, size = [], 0
    if held:
        yield told()


def _sums(frequent):
    """The columns of a document, what its frequent pairs sum up to, and its other pairs."""

    def run(batches):
        known, docs, best = frequent.value
        for pdf in batches:
            total, top, rest = [], [], []
            for data in pdf["pairs"]:
                pair, n = unpack(data)
                at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
                has = known[at] == pair if len(known) else np.zeros(len(pair), bool)
                at, times = at[has], n[has]
                total.append(int((docs[at] * times).sum()))
                top.append(int(times[best[at]].sum()))
                rest.append([{"pair": p, "n": m} for p, m in zip(pair[~has].tolist(), n[~has].tolist(), strict=True)])
            yield pdf.drop(columns="pairs").assign(known=total, top=top, rest=rest)

    return run


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A is a byte-level file of the tokenizers library (.json), which gets a space and the text; B is a sentencepiece
    model, which adds the space itself. Both are read by the driver and sent to the workers. Texts that are null or
    empty, or whose tokens' bytes aren't the text's, have no tokens: zeros and ''. Rows stay apart whatever their
    ids and each counts as a document; other columns are not read. What is held for one document is its tokens and
    distinct pairs.
    """
    spark = docs.sparkSession
    small_batches(spark)
    files = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            files.append(f.read())
    sent, name = spark.sparkContext.broadcast(files), "align " + hashlib.sha256(b"".join(files)).hexdigest()

    def make():
        return worker_memory(name, lambda: Aligner(ByteLevelTokens(sent.value[0]), PieceTokens(sent.value[1])))

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    kept = "id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    aligned = cut(rows.mapInPandas(_align(make), f"{kept}, pairs binary").withColumn("key", F.monotonically_increasing_id()))

    # packed pairs are small, so that batches of them may hold more documents than those of texts
    counts = aligned.select("pairs").mapInPandas(_pair_docs, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = cut(counts, batch=10_000)
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most"))
    counts = cut(counts.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))
    total = counts.agg(F.sum("docs")).first()[0] or 0
    often = F.col("docs") * frequent >= total
    head = sorted(map(tuple, counts.where(often).toLocalIterator()))  # `frequent` rows at most
    columns = np.array([p for p, _, _ in head], np.int64), np.array([n for _, n, _ in head], np.int64), np.array([b for _, _, b in head], bool)

    summed = aligned.mapInPandas(_sums(spark.sparkContext.broadcast(columns)), f"{kept}, key long, known long, top long, rest array<struct<pair: long, n: long>>")
    summed = cut(summed)
    n = F.col("n")
    rest = summed.select("key", F.inline("rest")).join(counts.where(~often), "pair")
    rest = rest.groupBy("key").agg(F.sum(n * F.col("docs")).alias("more"), F.sum(F.when(F.col("best"), n).otherwise(0)).alias("more_top"))
    plus = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).cast("long")
    out = summed.drop("rest").join(rest, "key", "left")
    return out.select(F.col("id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", plus("top", "more_top").alias("n_best"), plus("known", "more").alias("count_sum"), "groups_sha256")


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
